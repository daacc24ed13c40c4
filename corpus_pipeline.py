"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in
the shared folder and reads again for the next. All but the last return the columns of documents:

* ``quality_rules`` drops what the rules reject;
* ``exact_dedup`` keeps of equal texts (but for ASCII case) the row with the largest doc_id;
* ``near_dedup`` keeps one document of each class of texts that chains of links join;
* ``mixing`` takes documents as often as the mix says, so rows may repeat or go;
* ``packing`` returns the pieces of the packed sequences.

A stage's own tables in the shared folder are removed when the next stage of its chain begins, as
its result has been written by then; so a chain holds one stage's tables at a time. Each call of
``run`` is a chain of its own, whose last tables stay until the application ends, so that any
number of results can be held; stages that are called one by one form one chain.

Nulls, empty tables and repeated rows are handled as each operator's docstring says. Columns
beside those of documents are carried by all stages but the last.
"""

from __future__ import annotations

import contextvars
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import exact_dedup as exact
from sediment.llm import mixing as mix
from sediment.llm import ngram_join, packing
from sediment.llm import quality_rules as rules
from sediment.llm.common import drop_written, n_words, named, owned, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_chain: contextvars.ContextVar[str] = contextvars.ContextVar("chain", default="pipeline")


def stage(function: Stage) -> Stage:
    """The function, with its own tables in place of those of the stage before."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with owned(spark, _chain.get()):
            return function(spark, docs, sf_dir)

    return run


USED = ["doc_id", "text", "lang", "source"]


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that stages use, and all others in one, whose names can't clash with any result."""
    others = [named(c) for c in docs.columns if c not in USED]
    return docs.select(*USED, F.struct(F.lit(0).alias("__"), *others).alias("carried"))


def _unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in USED else F.col("carried").getField(c).alias(c) for c in columns])


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(rules.quality_rules(_packed(docs)).where("kept"), docs.columns)


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(exact.exact_dedup(_packed(docs), keep="largest").where("kept"), docs.columns)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(ngram_join.ngram_join(_packed(docs)).where("kept"), docs.columns)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = _packed(docs).withColumn("size", n_words(F.col("text")))
    chosen = mix.choose(sized, mix.source_targets(sized), [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")))])
    return _unpacked(mix.repeated(chosen), docs.columns)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packed),
]

#: Digests by MapInArrow, minimum hashes and tokenizers are not SQL; tests hold the rows against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    chain = _chain.set(f"pipeline-{uuid.uuid4().hex[:12]}")
    try:
        for name, function in STAGES[:-1]:
            docs = written(function(spark, docs, sf_dir), name)
            if before is not None:
                drop_written(before)
            before = docs
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _chain.reset(chain)
