"""Exact nearest vectors with pruning: vectors lie in blocks, and blocks that can't hold a hit are not read.

Cells are the clusters of a spherical k-means, and a cell is cut into shells by the angle between
a vector and the cell's centre. A block is one shell of one cell; it has its centre and the least
and the largest angle in it. By the triangle inequality of angles no vector of a block is closer
to a question than the angle to the centre less the largest, or the least less it. A search reads
the blocks with the best bounds first, takes the similarity of the k-th hit in them, and then all
blocks whose bound reaches it: two reads, whatever the data, and the result of a full scan.

Cells are folders and shells are sorted within files, so both reads are pruned by Parquet's
partitions and statistics. A cell of any size is dealt to files by ranges; no task holds a block
as a whole. Only k-means sees a sample, of about ``fit_rows`` rows, which sets where blocks lie
and never what a search returns. How much is pruned depends on the data: where all vectors are
about as far from each other, everything is read.

Defined cases: rows without a vector are left out, as by ``retrieval.semantic``; vectors of no, of
infinite or of extreme length, with null or NaN parts, or of another number of dimensions than
most lie in a cell of their own, which every search reads; a question of such a kind, or one for
more rows than there are, reads everything. Ties go to the smaller identifier. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import io
from ..functions.vectors import dot, norm
from . import retrieval

FIT_ROWS = 20_000
MOST_CELLS = 1024
SHELLS_PER_RADIAN = 32
#: A search's first read: blocks that hold this many times the rows asked for.
FIRST_READ = 4
#: What rounded cosines and angles may be off, together.
SLACK = 1e-6
ODD = -1


def _regular(embedding: Column, length: Column, dims: int) -> Column:
    return F.coalesce((F.size(embedding) == dims) & ~F.isnan(length) & (length > 1e-100) & (length < 1e100), F.lit(False))


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


class VectorBlocks:
    """Blocks in a folder: the vectors by cell, and one short row for each block."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = spark.read.parquet(f"{self.path}/rows")
        self.blocks = spark.read.parquet(f"{self.path}/blocks")

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None, *, cells: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 7) -> VectorBlocks:
        """Lays the vectors of ``chunks`` (chunk_id, source_id, owner, duplicate_of, embedding) in blocks.

        There are about half the root of all rows in cells, at most MOST_CELLS, unless ``cells`` says otherwise.
        """
        spark, path = chunks.sparkSession, (path or io.scratch(chunks.sparkSession, "vectors")).rstrip("/")
        held = chunks.where(F.col("embedding").isNotNull()).select(*retrieval.CARRIED, "embedding", norm(F.col("embedding")).alias("norm"))
        sizes = held.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
        dims = sizes["dims"] if sizes else 0
        held = held.withColumn("__regular", _regular(F.col("embedding"), F.col("norm"), dims))
        regular = held.where("__regular")
        n = regular.count()
        laid = held.where(~F.col("__regular")).withColumn("cell", F.lit(ODD)).withColumn("shell", F.lit(0)).withColumn("angle", F.lit(0.0))
        centres = spark.createDataFrame([], "cell int, centre array<double>")
        if n:
            units = regular.withColumn("__unit", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))))
            sample = units.where(F.pmod(F.xxhash64("chunk_id", "embedding"), F.lit(n)) < fit_rows).select("__unit")
            if sample.limit(1).count() == 0:
                sample = units.select("__unit").limit(fit_rows)
            wanted = cells or min(MOST_CELLS, max(1, math.isqrt(n) // 2))
            model = KMeans(k=max(2, wanted), featuresCol="__unit", predictionCol="cell", distanceMeasure="cosine", seed=seed, maxIter=10).fit(sample)
            centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], centres.schema)
            near = model.transform(units).drop("__unit").join(F.broadcast(centres), "cell")  # at most MOST_CELLS rows
            near = near.withColumn("angle", _angle(F.col("embedding"), F.col("centre"))).drop("centre")
            laid = near.withColumn("shell", F.floor(F.col("angle") * SHELLS_PER_RADIAN).cast("int")).unionByName(laid)
        laid = laid.drop("__regular").repartitionByRange("cell", "shell", F.xxhash64("chunk_id")).sortWithinPartitions("cell", "shell", "chunk_id")
        laid.write.option("compression", "zstd").partitionBy("cell").parquet(f"{path}/rows") if n or sizes else laid.write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        found = rows.groupBy("cell", "shell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
        found.join(F.broadcast(centres), "cell", "left").withColumn("dims", F.lit(dims)).coalesce(1).write.parquet(f"{path}/blocks")
        return cls(spark, path)

    def bounds(self, vector: list[float]) -> list[tuple[int, int, int, float]]:
        """(cell, shell, rows, best similarity that it can hold) of each block, best first: a few numbers for at most 102 shells of each cell."""
        asked = F.array(*[F.lit(float(x)) for x in vector])
        length = math.sqrt(sum(float(x) * float(x) for x in vector))
        fit = 1e-100 < length < 1e100
        away = _angle(F.col("centre"), asked)
        gap = F.greatest(F.lit(0.0), away - F.col("high"), F.col("low") - away)
        known = F.lit(fit) & (F.col("cell") != ODD) & (F.col("dims") == len(vector)) & (dot(F.col("centre"), F.col("centre")) > 0)
        best = F.when(known, F.cos(gap) + SLACK).otherwise(F.lit(math.inf))
        return [tuple(r) for r in self.blocks.select("cell", "shell", "n", F.coalesce(best, F.lit(math.inf)).alias("best")).orderBy(F.desc("best"), "cell", "shell").collect()]

    def _read(self, blocks: list[tuple[int, int, int, float]]) -> DataFrame:
        """The vectors of some blocks: their cells' folders, and in them the shells."""
        by_cell: dict[int, list[int]] = {}
        for cell, shell, *_ in blocks:
            by_cell.setdefault(cell, []).append(shell)
        # Cells with the same shells share a condition, so that it stays short.
        alike: dict[tuple[int, ...], list[int]] = {}
        for cell, shells in by_cell.items():
            alike.setdefault(tuple(sorted(shells)), []).append(cell)
        wanted = F.lit(False)
        for shells, cells in sorted(alike.items()):
            wanted = wanted | (F.col("cell").isin(cells) & F.col("shell").isin(list(shells)))
        return self.rows.where(F.col("cell").isin(sorted(by_cell))).where(wanted)

    def nearest(self, vector: list[float], k: int, user: str | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, dict]:
        """The ``k`` passages nearest to a vector among those the tenant sees (or ``keep`` keeps), and what was read of the blocks.

        The rows are (chunk_id, source_id, similarity), the same as ``top(semantic(visible(chunks)), "similarity", k)`` gives.
        """
        keep = keep or (lambda rows: retrieval.visible(rows, user))
        ranked = self.bounds(vector)
        first, rows = 0, 0
        while first < len(ranked) and (rows < FIRST_READ * k or ranked[first][3] == math.inf):
            rows += ranked[first][2]
            first += 1
        wanted = first
        if first < len(ranked):
            tried = retrieval.top(retrieval.semantic(keep(self._read(ranked[:first])), vector), "similarity", k)
            sure = tried.agg(F.count("similarity").alias("n"), F.min("similarity").alias("least")).first()
            least = sure["least"] if sure["n"] == k and k > 0 else -math.inf
            # NaN ranks above all numbers, and whatever can give it has been read.
            least = math.inf if math.isnan(least) else least
            wanted = max(first, sum(not b[3] < least for b in ranked))
        report = {"blocks": len(ranked), "blocks_read": wanted, "rows": sum(b[2] for b in ranked), "rows_read": sum(b[2] for b in ranked[:wanted])}
        return retrieval.top(retrieval.semantic(keep(self._read(ranked[:wanted])), vector), "similarity", k), report
