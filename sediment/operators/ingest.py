"""Ingestion of a manifest's sources as one set: what becomes of each, and the passages of those that are let in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U


def _held(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def rejection(df: DataFrame) -> Column:
    """Why a source (url, kind, raw_text, raw_segments, error) is turned away; null if it is let in.

    In this order: the policy's hosts, a failed fetch, a page that asks whether one is human, and a
    talk without cues.
    """
    cues = F.coalesce(F.size(_held(df, "raw_segments", "array<struct<text:string>>")), F.lit(0))
    return (
        F.when(U.is_denied(F.col("url")), "denied")
        .when(_held(df, "error", "string").isNotNull(), "failed")
        .when(X.challenge_marker(F.coalesce(_held(df, "raw_text", "string"), F.lit(""))).isNotNull(), "bot wall")
        .when((_held(df, "kind", "string") == "talk") & (cues == 0), "talk without cues")
    )


def judged(sources: DataFrame) -> DataFrame:
    return sources.withColumn("outcome", rejection(sources))


def outcomes(judged_: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, outcome) of every source: its rejection, else whether passages came of it."""
    some = passages.select(F.col("source_id").alias("id"), F.lit(True).alias("__some")).distinct()
    out = judged_.select("id", "outcome").join(some, "id", "left")
    return out.select("id", F.coalesce("outcome", F.when(F.col("__some"), "ingested").otherwise("no content")).alias("outcome"))


def report(decided: DataFrame, merged: DataFrame, flags: DataFrame | None) -> DataFrame:
    """(outcome, n): sources by outcome, passages written and deleted, and duplicates flagged, if they were sought."""
    changed = merged.select(F.when(F.col("action") == "delete", "passages deleted").when(F.col("action") != "keep", "passages written").alias("outcome")).where("outcome is not null")
    rows = decided.select("outcome").unionByName(changed)
    if flags is not None:
        rows = rows.unionByName(flags.select(F.lit("duplicates flagged").alias("outcome")))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
