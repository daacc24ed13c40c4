"""Rules that a database would enforce, as queries for the rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("talk", "book", "blog", "repo", "thread", "docs")
TRANSCRIPTS = ("manual", "auto")


def _broken(df: DataFrame, rule: str, where, key: str) -> DataFrame:
    return df.where(where).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("row_key"))


def source_violations(sources: DataFrame) -> DataFrame:
    """(rule, row_key) of sources: kinds, transcripts, cues of talks, unique (owner, url), no self-duplicates."""
    out = _broken(sources, "kind", ~F.col("kind").isin(*KINDS), "id")
    out = out.unionByName(_broken(sources, "self_duplicate", F.col("duplicate_of") == F.col("id"), "id"))
    if "transcript_kind" in sources.columns:
        out = out.unionByName(_broken(sources, "transcript_kind", ~F.col("transcript_kind").isin(*TRANSCRIPTS), "id"))
    if "raw_segments" in sources.columns:
        out = out.unionByName(_broken(sources, "talk_needs_segments", (F.col("kind") == "talk") & F.col("raw_segments").isNull(), "id"))
    twice = sources.groupBy("owner", "url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("k", F.concat_ws(" ", "owner", "url"))
    return out.unionByName(twice.select(F.lit("unique_owner_url").alias("rule"), F.col("k").alias("row_key")))


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """(rule, row_key) of passages: unique and nonnegative places, ordered spans, embedding and model together."""
    c = chunks.withColumn("k", F.concat_ws(":", F.col("source_id").cast("string"), F.col("chunk_index").cast("string")))
    out = _broken(c, "chunk_index", F.col("chunk_index") < 0, "k")
    out = out.unionByName(_broken(c, "span_order", F.col("start_ts") > F.col("end_ts"), "k"))
    if "embedding" in chunks.columns:
        out = out.unionByName(_broken(c, "embedding_pair", F.col("embedding").isNull() != F.col("embedding_model").isNull(), "k"))
    twice = c.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out.unionByName(twice.select(F.lit("unique_chunk").alias("rule"), F.col("k").alias("row_key")))
