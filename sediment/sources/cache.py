"""Raw responses kept as they came, so that a page is fetched once: a table keyed by the url's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import cache_key


def missing(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Sources whose response is not kept yet."""
    return wanted.withColumn("cache_key", cache_key(F.col("url"))).join(cached.select("cache_key"), "cache_key", "left_anti")


def split(cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejects): responses, and those that are errors, with their reason."""
    failed = F.col("error").isNotNull()
    return cached.where(~failed).drop("error"), cached.where(failed).select("cache_key", F.col("error").alias("reason"))
