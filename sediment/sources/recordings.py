"""Recorded answers: JSON files, one for each question and tenant, that are served as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import question_key


def read(spark: SparkSession, path: str) -> DataFrame:
    """Recordings with their lookup key."""
    out = spark.read.json(path, multiLine=True)
    if "recorded_for_user" not in out.columns:
        out = out.withColumn("recorded_for_user", F.lit(None).cast("string"))
    return out.withColumn("key", question_key(F.col("question")))


def lookup(recordings: DataFrame, questions: DataFrame) -> DataFrame:
    """``questions`` (question, user) with the recording of exactly that question and tenant, or nulls."""
    right = recordings.select(F.col("key").alias("__k"), F.col("recorded_for_user").alias("__u"), F.struct(*[c for c in recordings.columns if c != "key"]).alias("recorded"))
    on = (question_key(F.col("question")) == F.col("__k")) & F.col("user").eqNullSafe(F.col("__u"))
    return questions.join(right, on, "left").drop("__k", "__u")


def entries(recordings: DataFrame) -> DataFrame:
    return recordings.select("question", F.col("recorded_for_user").alias("user"))


def write(answers: DataFrame, path: str, user: str | None) -> None:
    """Answers as recordings for a tenant."""
    answers.withColumn("cached", F.lit(True)).withColumn("recorded_for_user", F.lit(user).cast("string")).write.mode("append").json(path)
