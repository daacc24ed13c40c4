"""Cost and latency of model calls, and counts of the stored corpus."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with ``cost_usd`` from prices per million tokens (model, price_in, price_out); null without a price."""
    priced = calls.join(prices, "model", "left")
    return priced.withColumn("cost_usd", (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1_000_000).drop("price_in", "price_out")


def spend_today(calls: DataFrame, now: Column) -> DataFrame:
    """One row: what the calls since the start of ``now``'s day cost; unpriced calls count as nothing."""
    return calls.where(F.col("created_at") >= F.date_trunc("day", now)).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spend_usd"))


def latency(calls: DataFrame, now: Column, operation: str | None = None) -> DataFrame:
    """One row: the median and 95th percentile of the 24 hours before ``now``; zero without calls."""
    recent = calls.where(F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS"))
    if operation is not None:
        recent = recent.where(F.col("operation") == operation)
    part = lambda p: F.coalesce(F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY latency_ms)"), F.lit(0.0))
    return recent.agg(part(0.5).alias("p50_ms"), part(0.95).alias("p95_ms"))


def record(call: DataFrame, path: str) -> None:
    """Appends calls; a failure to do so never reaches the caller."""
    import logging

    try:
        call.write.mode("append").parquet(path)
    except Exception:
        logging.getLogger("sediment.telemetry").exception("a call could not be recorded")


CALL = "created_at timestamp, model string, operation string, tokens_in int, tokens_out int, latency_ms int, error string"


@contextlib.contextmanager
def timed(spark: SparkSession, path: str, model: str, operation: str) -> Iterator[dict]:
    """Times a call and records it, whether it returns or raises; the caller sets tokens_in and tokens_out."""
    import datetime

    facts: dict = {"tokens_in": 0, "tokens_out": 0, "error": None}
    at, began = datetime.datetime.now(), time.perf_counter()
    try:
        yield facts
    except Exception as e:
        facts["error"] = f"{type(e).__name__}: {e}"
        raise
    finally:
        took = round(1000 * (time.perf_counter() - began))
        record(spark.createDataFrame([(at, model, operation, facts["tokens_in"], facts["tokens_out"], took, facts["error"])], CALL), path)


def corpus_stats(sources: DataFrame, chunks: DataFrame, tokens: Column) -> DataFrame:
    """One row over all owners and duplicates: sources, chunks, pending embeddings, tokens."""
    held = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("pending"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
    return sources.agg(F.count(F.lit(1)).alias("sources")).join(held, F.lit(True), "left")


def ingest_report(outcomes: DataFrame) -> DataFrame:
    """(outcome, n) of sources by what became of them."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
