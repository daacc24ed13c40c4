"""Changes to stored tables as joins: what a merge would insert, update, keep or delete, and the table after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a second ingestion of a source leaves as they are.
STICKY = ("id", "owner", "added_by", "created_at", "duplicate_of")


def merge_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """The passages of ``new``'s sources after replacement, with ``action``; deleted rows are listed too.

    A passage is rewritten, and loses its embedding, only if its hash changed; else the stored row
    stays, times and all. Stored passages beyond a source's new last one go.
    """
    keys = ["source_id", "chunk_index"]
    touched = new.select("source_id").distinct()
    held = old.join(touched, "source_id", "left_semi").withColumn("__old", F.lit(True))
    fresh = new.withColumn("__new", F.lit(True))
    both = held.alias("o").join(fresh.alias("n"), keys, "full_outer")
    same = F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(same, "keep").otherwise("update")
    both = both.withColumn("action", action)
    stays = F.col("action").isin("keep", "delete")
    value = []
    for c in old.columns:
        if c in keys:
            continue
        if c in new.columns:
            value.append(F.when(stays, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:  # the embedding and its model go with a rewrite
            value.append(F.when(stays, F.col(f"o.{c}")).alias(c))
    return both.select(*keys, *value, "action")


def replaced(old: DataFrame, merged: DataFrame) -> DataFrame:
    """The whole table after the merge."""
    rest = old.join(merged.select("source_id").distinct(), "source_id", "left_anti")
    return rest.unionByName(merged.where("action <> 'delete'").select(*old.columns))


def counts(merged: DataFrame) -> DataFrame:
    """One row: passages written and deleted."""
    return merged.agg(F.count_if(F.col("action").isin("insert", "update")).alias("written"), F.count_if(F.col("action") == "delete").alias("deleted"))


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources after an upsert by (owner, url): new values win, but for the sticky columns of rows that were there."""
    keys = ["owner", "url"]
    both = old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), keys, "full_outer")
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "keep").otherwise("update")
    value = []
    for c in old.columns:
        if c in keys:
            continue
        if c not in new.columns:
            value.append(F.col(f"o.{c}").alias(c))
        elif c in STICKY:
            value.append(F.when(F.col("__old").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            value.append(F.when(F.col("__new").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    out = both.select(*keys, *value, action.alias("action"))
    if "id" in old.columns and "id" not in new.columns:
        out = out.withColumn("id", F.coalesce("id", F.xxhash64("owner", "url")))
    return out


def mark_duplicates(sources: DataFrame, flags: DataFrame) -> DataFrame:
    """``duplicate_of`` as ``flags`` (id, duplicate_of) has it; sources without a flag lose theirs."""
    return sources.drop("duplicate_of").join(flags.select("id", "duplicate_of"), "id", "left").select(sources.columns)


def delete_sources(sources: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without ``gone`` (id): its passages go too, and flags that point to it become null."""
    left = sources.join(gone.select("id"), "id", "left_anti")
    lost = gone.select(F.col("id").alias("duplicate_of"), F.lit(True).alias("__gone"))
    flagged = left.join(lost, "duplicate_of", "left").withColumn("duplicate_of", F.when(F.col("__gone").isNull(), F.col("duplicate_of")))
    return flagged.select(sources.columns), chunks.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def write_embeddings(chunks: DataFrame, computed: DataFrame, keys: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Chunks with computed (``keys``, embedding, embedding_model) where there was none: both columns together."""
    right = computed.select(*keys, F.col("embedding").alias("__e"), F.col("embedding_model").alias("__m"))
    out = chunks.join(right, list(keys), "left")
    pending = F.col("embedding").isNull()
    out = out.withColumn("embedding_model", F.when(pending, F.col("__m")).otherwise(F.col("embedding_model")))
    return out.withColumn("embedding", F.when(pending, F.col("__e")).otherwise(F.col("embedding"))).select(chunks.columns)
