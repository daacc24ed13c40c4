"""What a search reads, written once for a folder of tables: passages, their postings, their vectors' norms.

The tables lie in the shared folder as long as the application lives, and are written anew when
the folder's documents or embeddings have changed. Postings are dealt to files by a hash of their term
and sorted, so that a search for a few terms reads the row groups that may hold them.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import io
from ..corpus import Corpus
from ..functions.vectors import norm
from ..operators import retrieval
from ..operators.nearest import VectorBlocks
from . import tables

#: So many files at most have a term's postings.
SPREAD = 8

_made: dict[tuple[str, str], tuple[str, Index]] = {}


class Index:
    """The tables of passages (chunk_id, source_id, content, owner, duplicate_of, embedding, ...), each written when it is first asked for."""

    def __init__(self, plan: DataFrame):
        self._plan = plan

    @functools.cached_property
    def chunks(self) -> DataFrame:
        return io.written(self._plan.withColumn("norm", norm(F.col("embedding"))), "chunks")

    @functools.cached_property
    def postings(self) -> DataFrame:
        """Dealt by a hash of the term, a frequent one to several files: no pass over the texts to find ranges."""
        posts = retrieval.postings(self.chunks)
        return io.written(posts.repartition("term", F.pmod("chunk_id", F.lit(SPREAD))).sortWithinPartitions("term"), "postings")


def stamp(spark: SparkSession, path: str) -> str:
    """Size, number of files and time of change of a path, which tell whether it is still the same."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    known = fs.getContentSummary(p)
    return f"{known.getLength()}:{known.getFileCount()}:{fs.getFileStatus(p).getModificationTime()}"


def build(chunks: DataFrame) -> Index:
    return Index(chunks)


def of(spark: SparkSession, folder: str) -> Index:
    """The folder's index, from its documents and embeddings."""
    key, now = (spark.sparkContext.applicationId, folder), "|".join(stamp(spark, f"{folder}/{t}.parquet") for t in ("documents", "embeddings"))
    if key not in _made or _made[key][0] != now:
        _made[key] = (now, build(tables.chunks(spark, folder)))
    return _made[key][1]


_blocks: dict[tuple[str, str], tuple[str, VectorBlocks]] = {}


def blocks(spark: SparkSession, folder: str) -> VectorBlocks:
    """The folder's vectors in blocks for exact searches that read a part of them."""
    key, chunks = (spark.sparkContext.applicationId, folder), of(spark, folder).chunks
    now = _made[key][0]
    if key not in _blocks or _blocks[key][0] != now:
        _blocks[key] = (now, VectorBlocks.build(chunks))
    return _blocks[key][1]


_stored: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, folder: str) -> Corpus:
    """The folder's documents as a stored corpus, in two commits, once an application: French ones first had another ending.

    What the second commit leaves must be what the documents alone give.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stored:
        docs = tables.unflagged(tables.table(spark, folder, "documents")).select("id", "url", "owner", "kind", "title", "lang", "raw_text")
        held = Corpus(spark, io.scratch(spark, "corpus"))
        ending = F.when(F.col("lang") == "fr", F.concat("raw_text", F.lit(" Superseded ending of a former version."))).otherwise(F.col("raw_text"))
        held.ingest(docs.withColumn("raw_text", ending), flag=False)
        held.ingest(docs, flag=False)
        held.store.vacuum()
        _stored[key] = held
    return _stored[key]
