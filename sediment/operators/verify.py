"""Checks of a corpus from outside: do its links still hold, do answers cite what they may, do recordings agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def verified(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """``sources`` (url, kind, ...) with ok, status and detail from ``fetched`` (url, http_status, text, error); a url that was not fetched has failed.

    A repository may be thin; all else must have a page's worth of text.
    """
    got = fetched.select(F.col("url").alias("__u"), "http_status", F.col("text").alias("__t"), F.col("error").alias("__e"))
    out = sources.join(got, F.col("url") == F.col("__u"), "left")
    page = X.page_status(F.coalesce("__t", F.lit("")), F.coalesce("http_status", F.lit(599)), F.col("kind") == "repo")
    status = F.when(F.col("__u").isNull(), "not fetched").when(F.col("__e").isNotNull(), "error").otherwise(page)
    out = out.withColumn("status", status).withColumn("ok", F.col("status") == "ok")
    return out.withColumn("detail", F.coalesce("__e", F.col("http_status").cast("string"))).drop("__u", "__t", "__e", "http_status")


def by_kind(checked: DataFrame) -> DataFrame:
    """(place, kind, n): sources that hold, by kind, the most frequent first."""
    counts = checked.where("ok").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.expr("row_number() OVER (ORDER BY n DESC, kind)").alias("place"), "kind", "n")


def citation_violations(cited: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(rule, row_key) of citations (answer_id, chunk_id, at): a time outside its passage, a flagged duplicate, no such passage."""
    c = cited.join(chunks.select("chunk_id", F.col("source_id").alias("id"), "start_ts", "end_ts"), "chunk_id", "left")
    c = c.join(sources.select("id", "duplicate_of"), "id", "left")
    rules = {
        "no_passage": F.col("id").isNull(),
        "outside_span": F.col("at").isNotNull() & ~F.coalesce(F.col("at").between(F.col("start_ts"), F.col("end_ts")), F.lit(False)) & F.col("id").isNotNull(),
        "cites_duplicate": F.col("duplicate_of").isNotNull(),
    }
    broken = c.select(F.concat_ws(":", F.col("answer_id").cast("string"), F.col("chunk_id").cast("string")).alias("row_key"), F.explode(F.array_compact(F.array(*[F.when(w, F.lit(r)) for r, w in rules.items()]))).alias("rule"))
    return broken.select("rule", "row_key")


def recording_differences(recorded: DataFrame, again: DataFrame, *columns: str) -> DataFrame:
    """(question, user, column) where a recording and the answer given now (both with question, user) differ, or one is missing."""
    a = recorded.select(X.question_key(F.col("question")).alias("question"), "user", *[F.col(c).cast("string").alias(f"__a_{c}") for c in columns], F.lit(True).alias("__a"))
    b = again.select(X.question_key(F.col("question")).alias("__q"), F.col("user").alias("__w"), *[F.col(c).cast("string").alias(f"__b_{c}") for c in columns], F.lit(True).alias("__b"))
    both = a.join(b, (F.col("question") == F.col("__q")) & F.col("user").eqNullSafe(F.col("__w")), "full_outer")
    missing = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.lit("(missing)"))
    differ = [F.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in columns]
    found = F.array_compact(F.when(missing.isNotNull(), F.array(missing)).otherwise(F.array(*differ)))
    return both.select(F.coalesce("question", "__q").alias("question"), F.coalesce("user", "__w").alias("user"), F.explode(found).alias("column"))
