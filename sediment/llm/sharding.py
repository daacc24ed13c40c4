"""Shards that all match the corpus's mixture: proportional stratified interleaving.

Method. Rows are shuffled by a seeded hash and ranked within their source; row i of n gets the
fractional rank (i + 1/2) / n. In order of fractional rank the sources interleave in proportion,
so equal cuts of that order give shards of at most one row's difference (the law ``rows``), each
with its share of every source.

Both ranks are taken by ``ordered_index``: rows are sorted only within buckets of the hash or the
fractional rank, about the square root of all rows in each, and the buckets' counts give the
first positions. A source with a third of all rows is spread over its buckets. Rows are dealt one
by one: equal texts are not kept together, which a law of equal counts excludes for large groups.

Defined cases: null sources are one source; null texts have size 16; equal rows are ordered among
themselves by size and are interchangeable; an empty table gives an empty result; with fewer rows
than shards some shards are empty; extra columns pass through, but one that
has the name of a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside_groups, ordered_index, root_buckets, seeded, with_room

SHARDS = 40
SEED = 29


def interleaved_shards(df: DataFrame, order: list[Column], key: list[Column], source: str = "source", n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds ``shard`` and ``slot``. ``df`` must be stable (a table); ``order`` breaks ties of the hash."""
    df = with_room(df, [source], ["shard", "slot"])
    n = df.count()
    buckets = root_buckets(n)
    rows = df.withColumn("__h", seeded(seed, *key)).withColumn("__hb", F.floor(F.col("__h") / F.lit(float(1 << 60) / buckets)).cast("long"))
    rows = ordered_index(rows, [source], "__hb", [F.col("__h"), *order], "__rank")
    # A key that is never null: the sources' sizes are sent if they are few, else hot sources are salted.
    label = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    sizes = df.groupBy(label.alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    rows = beside_groups(rows.withColumn("__label", label), "__label", sizes, "__s", "__n", F.col("__h"), n, "sizes").drop("__s", "__label")
    frac = (2 * F.col("__rank") + 1) / (2 * F.col("__n"))
    rows = rows.withColumn("__f", frac).withColumn("__fb", F.floor(F.col("__f") * buckets).cast("long"))
    rows = ordered_index(rows, [], "__fb", [F.col("__f"), F.col(source).asc_nulls_last(), F.col("__rank")], "__pos")
    # Shard s holds the positions p with floor(p * shards / n) = s; the first is ceil(s * n / shards).
    rows = rows.withColumn("shard", F.expr(f"(__pos * {n_shards}L) div {max(n, 1)}L").cast("int"))
    first = F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    rows = rows.withColumn("slot", (F.col("__pos") - first).cast("long"))
    return rows.drop("__h", "__hb", "__rank", "__n", "__f", "__fb", "__pos")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows by slot."""
    sharded.repartition(F.col("shard")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
