"""Dominance counting: for each row, the rows of a smaller slot and a strictly larger level, counted and weighted.

Method. Rows of one slot and level are one cell with their number and their weight. Cells lie in
slot order, which is cut into shards of about ``shard_cells`` cells at slots' bounds; levels are cut
into blocks alike, at levels' bounds. A shard is a weighted wavelet matrix over the ranks of its
levels in slot order, with the prefix sums of both weights on each bit plane. A cell's answer is the
sum of three prefix greater-than queries:

* in its own shard, over the slots before its own;
* in its level block, again a wavelet matrix in slot order, over the shards before its own;
* over the earlier shards' cells of all higher blocks, by the shards' sums for each block.

So a query is routed to two matrices, however many shards its prefix covers, and all the work is
cells times bit planes. A slot (a level) with more cells than a shard holds is a shard (a block)
by itself: no cell of it is below another of it, so it needs no matrix and is dealt to several
tasks. Shards grow as the 0.6th power of the cells, so their sums for the blocks, a row for each
shard and block, stay fewer than the cells. Prefix sums over slots and levels are taken by ranges;
nothing is broadcast but the keys that joins salt, and what one task reads alone is a row for each
100,000 slots or levels.

Defined cases: a row with a null slot or level is above none and gets nulls; a null weight counts
as 0; repeated rows count each; ties in slot or level are not above each other; an empty table
gives an empty result; other columns pass through, but one that has a result's name, or begins
with two underscores, gives way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_spread, named, running, with_room, written

SHARD_CELLS = 1 << 10


def prefix_above(order: np.ndarray, level: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each element and each of ``weights``, the sum over elements of a smaller ``order`` and a larger ``level``.

    A wavelet matrix over level ranks in the order given, built one bit plane at a time; all
    queries go down it together. ``order`` must be ascending.
    """
    ranks = np.unique(level, return_inverse=True)[1]
    prefix = np.searchsorted(order, order, "left")
    low, high, plane = np.zeros(len(order), np.int64), prefix.astype(np.int64), ranks
    held, out = list(weights), [np.zeros(len(order), np.int64) for _ in weights]
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        ones = (plane >> bit) & 1
        upto = np.concatenate([[0], np.cumsum(ones)])
        goes_up = (ranks >> bit) & 1 == 1
        for i, w in enumerate(held):
            sums = np.concatenate([[0], np.cumsum(w * ones)])
            out[i] += np.where(goes_up, 0, sums[high] - sums[low])
        zeros = len(plane) - int(upto[-1])
        low = np.where(goes_up, zeros + upto[low], low - upto[low])
        high = np.where(goes_up, zeros + upto[high], high - upto[high])
        turn = np.argsort(ones, kind="stable")
        plane, held = plane[turn], [w[turn] for w in held]
    return out


_CELL = "slot bigint, level bigint, n bigint, w bigint, shard bigint, block bigint, block_piece bigint, heavy_block boolean, above_n bigint, above_w bigint"


def _long(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64)


def _in_shard(table: pa.Table) -> pa.Table:
    """A shard's cells with what is above them in it, and for each block the sums of its cells in higher blocks (slot null)."""
    table = table.sort_by([("slot", "ascending"), ("level", "ascending")])
    slot, level, n, w, block = (_long(table, c) for c in ("slot", "level", "n", "w", "block"))
    size = len(slot)
    if table["heavy_shard"][0].as_py():
        above = [np.zeros(size, np.int64)] * 2
    else:
        above = prefix_above(slot, level, [n, w])
    cells = table.select(["slot", "level", "n", "w", "shard", "block", "block_piece", "heavy_block"])
    cells = cells.append_column("above_n", pa.array(above[0])).append_column("above_w", pa.array(above[1]))
    blocks = int(block.max())  # below the highest block there are this many
    tails = [np.bincount(block, x, blocks + 1)[::-1].cumsum()[::-1][1:].astype(np.int64) for x in (n, w)]
    none = pa.nulls(blocks, pa.int64())
    sums = pa.table({"slot": none, "level": none, "n": none, "w": none, "shard": pa.array(np.full(blocks, table["shard"][0].as_py())), "block": pa.array(np.arange(blocks)),
                     "block_piece": none, "heavy_block": pa.nulls(blocks, pa.bool_()), "above_n": pa.array(tails[0]), "above_w": pa.array(tails[1])})
    return pa.concat_tables([cells.cast(sums.schema), sums])


def _in_block(table: pa.Table) -> pa.Table:
    """A level block's cells with all that is above them: in their shard, in earlier shards of the block, and of higher blocks."""
    sums = table.filter(pc.is_null(table["slot"])).sort_by("shard")
    cells = table.filter(pc.is_valid(table["slot"])).sort_by([("shard", "ascending"), ("slot", "ascending"), ("level", "ascending")])
    shard, level, n, w = (_long(cells, c) for c in ("shard", "level", "n", "w"))
    here = [_long(cells, c) for c in ("above_n", "above_w")]
    if len(shard) and not cells["heavy_block"][0].as_py():
        here = [a + b for a, b in zip(here, prefix_above(shard, level, [n, w]), strict=True)]
    before = np.searchsorted(_long(sums, "shard"), shard, "left")
    for i, c in enumerate(("above_n", "above_w")):
        here[i] = here[i] + np.concatenate([[0], np.cumsum(_long(sums, c))])[before]
    return pa.table({"slot": cells["slot"], "level": cells["level"], "n": cells["n"], "n_above": pa.array(here[0]), "w_above": pa.array(here[1])})


def _grouped(cells: DataFrame, key: str, size: int, group: str) -> DataFrame:
    """(k, c, group, heavy, pieces) of each distinct ``key``: c cells, and groups of about ``size`` cells in the key's order."""
    counted = written(cells.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("c")), f"{group}-counts")
    laid = running(counted, [F.col("k").asc()], F.col("c"), "start", counted.count())
    heavy = F.col("c") > size
    at = 2 * F.floor(F.col("start") / size) + F.when(heavy, 1).otherwise(0)
    pieces = F.when(heavy, F.ceil(F.col("c") / size)).otherwise(1)
    return written(laid.select("k", "c", at.cast("long").alias(group), heavy.alias(f"heavy_{group}"), pieces.cast("long").alias(f"{group}_pieces")), group)


def cells_above(cells: DataFrame, shard_cells: int | None = None) -> DataFrame:
    """(slot, level, n, n_above, w_above) of written cells (slot, level, n, w), each slot and level once."""
    total = cells.count()
    size = shard_cells or max(SHARD_CELLS, math.ceil(total**0.6))
    shards, blocks = _grouped(cells, "slot", size, "shard"), _grouped(cells, "level", size, "block")
    at = join_spread(cells, "slot", shards, "k", "c", F.col("level"), total).drop("k", "c")
    at = join_spread(at, "level", blocks, "k", "c", F.col("slot"), total).drop("k", "c")
    at = at.withColumn("shard_piece", F.pmod(F.xxhash64("level"), F.col("shard_pieces"))).withColumn("block_piece", F.pmod(F.xxhash64("slot"), F.col("block_pieces")))
    part = written(at.groupBy("shard", "shard_piece").applyInArrow(_in_shard, _CELL), "in-shard")
    # The shards' sums go to each piece of their block.
    sums = part.where("slot is null").groupBy("shard", "block").agg(F.sum("above_n").alias("above_n"), F.sum("above_w").alias("above_w"))
    pieces = blocks.groupBy("block").agg(F.max("block_pieces").alias("p")).hint("merge")
    sums = sums.join(pieces, "block").withColumn("block_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
    both = part.where("slot is not null").unionByName(sums.drop("p"), allowMissingColumns=True)
    return both.groupBy("block", "block_piece").applyInArrow(_in_block, "slot bigint, level bigint, n bigint, n_above bigint, w_above bigint")


def dominance(df: DataFrame, slot: str = "slot", level: str = "level", weight: str = "weight", *, shard_cells: int | None = None) -> DataFrame:
    """``df`` with ``n_above`` and ``w_above``; slot, level and weight are whole numbers. ``df`` is read twice."""
    whole = {c: named(c).cast("long") for c in (slot, level, weight)}
    known = whole[slot].isNotNull() & whole[level].isNotNull()
    cells = df.where(known).groupBy(whole[slot].alias("slot"), whole[level].alias("level"))
    cells = written(cells.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(whole[weight]), F.lit(0)).cast("long").alias("w")), "cells")
    found = cells_above(cells, shard_cells)
    cell = lambda s, l: F.struct(s.alias("s"), l.alias("l"))
    found = written(found.select(cell(F.col("slot"), F.col("level")).alias("__c"), F.col("n").alias("__n"), "n_above", "w_above"), "above")
    rows = with_room(df, [slot, level, weight], ["n_above", "w_above"])
    rows = rows.withColumn("__cell", F.when(known, cell(whole[slot], whole[level]))).withColumn("__rid", F.monotonically_increasing_id())
    total = found.agg(F.sum("__n")).first()[0] or 0
    return join_spread(rows, "__cell", found, "__c", "__n", F.col("__rid"), total, how="left").drop("__cell", "__rid", "__c", "__n")


def day_slot(df: DataFrame, at: str) -> Column:
    """Days since 1970 of a timestamp in UTC; one without a zone is taken as UTC, whatever the session's zone."""
    if isinstance(df.schema[at].dataType, T.TimestampType):
        return F.floor(F.unix_micros(named(at)) / 86_400_000_000).cast("long")
    return F.unix_date(named(at).cast("date")).cast("long")


def cents_level(total: Column) -> Column:
    """floor(floor(100 * total + 0.5) / 1000) in doubles; one that is not a number has none."""
    total = total.cast("double")
    return F.when(~F.isnan(total), F.floor(F.floor(100 * total + 0.5) / 1000)).cast("long")
