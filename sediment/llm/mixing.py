"""Mixing sources to target weights by capped water-filling. Native DataFrame operations only.

Method. Sources ask for shares of a budget by weight. A source whose share exceeds ``max_epochs``
times its size is clamped there, and what it leaves goes to the others by weight, until none is
above: with sources in order of cap by weight, the clamped ones are a prefix, and each other's
target is its weight's part of what the prefix leaves. Then every document of a source is taken
as often as the whole part of target / size says, and the fraction that is left is taken from
the documents in seeded order, up to the first that would go beyond it. What that one leaves open
is filled with the shortest documents not yet taken, in order of size, then hash, the last of them
if its middle is below the target. So a source misses its target by half of its shortest
document not taken at most, however long the document at which the seeded order ends.

Neither order is ever sorted as one. Documents fall in buckets by the leading bits of their hash,
about as many as the square root of all rows; the buckets' sums find the one in which an order
ends, and the sums of its hashes the hash. A source's distinct sizes are fewer than the square root of twice its
words. So what is chosen of a source is stated by a few numbers, and equal rows are added up
before they meet; only if the last hash is one of several rows, these are numbered.

Defined cases: a null text counts as empty; null sources come last and are one source; a document
without words is taken like the others in seeded order and adds none; a source without words has
target 0 and is not taken; equal rows share a hash, are interchangeable, and in seeded order are
taken all or none; an empty table gives an empty result; extra columns pass through, but one that
has the name of a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import beside_groups, root_buckets, row_hash, seeded, with_room, written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 17


def _group(source: str) -> Column:
    """A key of the source that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))


def source_targets(sized: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): one row per source, of which there may be many but each is small."""
    s = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(source).asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", max_epochs * F.col("source_size"))
    # Source i is clamped if the shares, with it and all before it clamped, still leave it above its cap.
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(budget)))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(after))
    clamped = F.col("left") * F.col("weight") >= F.col("cap").cast("double") * F.col("open")
    s = s.withColumn("clamped", clamped)
    top = F.max(F.when(~F.col("clamped"), F.col("open"))).over(Window.partitionBy(F.lit(0)))
    rest = F.max(F.when(~F.col("clamped") & (F.col("open") == F.col("top")), F.col("left"))).over(Window.partitionBy(F.lit(0)))
    s = s.withColumn("top", top).withColumn("rest", rest)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("rest") * F.col("weight") / F.col("top"))
    return s.select(source, "source_size", target.alias("target"))


def _ends(rows: DataFrame, t: DataFrame, at: str, value: Column, limit: str, end: str, left: str) -> DataFrame:
    """``t`` with ``end``, the first ``at`` of a source by which its rows' sum of ``value`` exceeds ``limit``, and what the sum before leaves of it.

    Both are null where the sum never exceeds it.
    """
    sums = rows.groupBy("__sk", at).agg(F.sum(value).alias("__v"))
    upto = Window.partitionBy("__sk").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__v").over(upto), F.lit(0)))
    over = sums.join(t.select("__s", F.col(limit).alias("__limit")), F.col("__sk") == F.col("__s")).where(F.col("__before") + F.col("__v") > F.col("__limit"))
    first = over.groupBy("__s").agg(F.min(F.struct(F.col(at).alias("at"), (F.col("__limit") - F.col("__before")).alias("left"))).alias("__e"))
    return t.join(first, "__s", "left").withColumn(end, F.col("__e.at")).withColumn(left, F.col("__e.left")).drop("__e")


def _limits(thin: DataFrame, t: DataFrame, total: int) -> DataFrame:
    """``t`` with what states the choice of each source's fraction ``extra``.

    Rows with a hash below ``h1`` are taken (all, if it is null), of the others up to twice ``gap`` those shorter than
    ``s2`` (all, if it is null), of those as long as ``s2`` the ones with a hash below ``h3`` (all, if it is null), and ``k3`` with ``h3``.
    """
    beside = lambda t: beside_groups(thin, "__sk", t, "__s", "__rows", F.col("__h"), total, "shares")
    size, one = F.col("size"), F.lit(1)
    t = written(_ends(thin, t, "__b", size, "extra", "b1", "left1"), "shares")
    t = _ends(beside(t).where(F.col("__b") == F.col("b1")), t, "__h", size, "left1", "h1", "gap")
    t = written(t, "shares")
    behind = lambda t: beside(t).where((F.col("__h") >= F.col("h1")) & (size > 0) & (size <= 2 * F.col("gap")))
    t = _ends(behind(t), t, "size", size, "gap", "s2", "left2")
    t = written(t.withColumn("k", F.ceil(F.col("left2") / F.col("s2") - 0.5)), "shares")
    t = written(_ends(behind(t).where(size == F.col("s2")), t, "__b", one, "k", "b3", "left3"), "shares")
    t = _ends(behind(t).where((size == F.col("s2")) & (F.col("__b") == F.col("b3"))), t, "__h", one, "left3", "h3", "k3")
    return t.drop("b1", "left1", "left2", "k", "b3", "left3")


def choose(sized: DataFrame, targets: DataFrame, key: list[Column], source: str = "source", seed: int = SEED) -> DataFrame:
    """Adds source_size, target and ``copies`` to rows with ``size``.

    ``sized`` must be stable (a written table): its sizes and hashes are written for the choice, to
    which it is joined then. ``key`` tells rows apart as far as they can be: its hash is the seeded order.
    """
    made = ["source_size", "target", "copies", "whole", "extra", "h1", "gap", "s2", "h3", "k3"]
    sized = with_room(sized, [source, "size"], made)
    rows = sized.withColumn("__sk", _group(source)).withColumn("__h", seeded(seed, *key)).withColumn("__by", row_hash(sized))
    thin = written(rows.select("__sk", "__h", "size"), "mix-sizes")
    total = thin.count()
    thin = thin.withColumn("__b", F.shiftright("__h", 60 - root_buckets(total).bit_length()).cast("int"))
    counted = thin.groupBy("__sk").agg(F.count(F.lit(1)).alias("__rows"))
    t = targets.select(_group(source).alias("__s"), "source_size", "target").join(counted, F.col("__s") == F.col("__sk")).drop("__sk")
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("extra", F.when(F.col("source_size") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    t = _limits(thin, t, total)
    joined = beside_groups(rows, "__sk", t, "__s", "__rows", F.col("__by"), total, "choice")
    h, size = F.col("__h"), F.col("size")
    first = F.col("h1").isNull() | (h < F.col("h1"))
    filler = ~first & (size > 0) & (size <= 2 * F.col("gap"))
    exact = filler & (size == F.col("s2"))
    shorter = filler & (F.col("s2").isNull() | (size < F.col("s2")) | (exact & (F.col("h3").isNull() | (h < F.col("h3")))))
    last = F.coalesce((F.col("extra") > 0) & exact & (h == F.col("h3")), F.lit(False))
    taken = (F.col("extra") > 0) & F.coalesce(first | shorter, F.lit(False))
    rest = joined.where(~last).withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0))
    turn = F.row_number().over(Window.partitionBy("__sk").orderBy(*key))
    edge = joined.where(last & (F.col("k3") > 0)).withColumn("copies", F.col("whole") + F.when(turn <= F.col("k3"), 1).otherwise(0))
    none = joined.where(last & (F.col("k3") <= 0)).withColumn("copies", F.col("whole"))
    both = rest.unionByName(none).unionByName(edge)
    return both.drop("__sk", "__s", "__h", "__by", "__rows", *[c for c in made if c not in ("source_size", "target", "copies")])


def repeated(chosen: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says."""
    n = F.col("copies").cast("int")
    return chosen.withColumn("__c", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))).drop("__c")
