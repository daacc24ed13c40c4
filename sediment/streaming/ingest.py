"""Continuous ingestion: a stream of sources, each micro-batch merged into the stored passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunker, merge


def merge_batch(stored: DataFrame, sources: DataFrame, **options) -> DataFrame:
    """The passages after a batch of sources (id, raw_text, raw_segments): rewritten only where their hash changed."""
    fresh = chunker.chunk_sources(sources, **options).drop("cues", "tokenizer")
    return merge.replaced(stored, merge.merge_chunks(stored, fresh))


def ingest_stream(spark: SparkSession, path: str, schema: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Merges new Parquet files of ``path`` as they come, until none is left.

    ``read`` gives the stored passages, ``write`` stores the new version of a batch; a batch that
    is repeated after a failure finds equal hashes and changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        write(merge_batch(read(), batch, **options), number)

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
