"""Exact duplicates through a log-structured merge index of text digests.

Method. Texts are normalised to bytes and hashed. Each task collects digests in a memtable, a map
from digest to the best identifier so far and a count, and flushes it as a run: entries sorted by
digest. Runs are written to the shared folder (level 0). Compaction deals the entries of all runs
to ranges of digests of about ``RUN_ROWS`` entries and merges each range in one pass over its
sorted entries: equal digests are neighbours, of which the best identifier (the largest or the
smallest) and the summed count stay. So each range is one sorted run of level 1, whose filter, a
Bloom filter of the digests that occur more than once, is flushed with it. Documents then probe:
a digest's range names its run, whose filter tells nearly all unique texts apart without their
texts leaving the task. Hits meet their digest's entry, and each is compared byte by byte with the
text that stays; hits whose bytes differ (a collision) are grouped anew by their whole bytes.

A copy group of any size is one entry per memtable, so no task sees a group as a whole; a digest
of many rows is salted where rows meet its entry and its kept text. The runs' filters are sent to
the executors only if they have at most ``filter_bytes`` together, ten bits for each repeated
digest; beyond that every row takes the way of a hit, which gives the same result.

Defined cases: null counts as the empty text; only A-Z are lowered; among rows with one identifier
and one text exactly one is kept, and they are interchangeable; null identifiers lose to all
others and a group of nulls keeps one row, whose keep_id is null; an empty table gives an empty
result; extra columns pass through, but one that has the name of a result gives way to it.
Identifiers are whole numbers.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop_written, in_arrow, join_spread, map_beside, named, with_room, written

MEMTABLE = 100_000
RUN_ROWS = 1_000_000
MOST_RUNS = 1 << 20
FILTER_BYTES = 32 << 20
BITS_PER_KEY, HASHES = 10, 4


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lowered: bytes.lower touches only these."""
    return b"" if text is None else text.encode().lower()


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


class Bloom:
    """A Bloom filter over digests, whose own bytes serve as the hash values."""

    def __init__(self, n: int, bits: np.ndarray | None = None):
        self.m = max(64, n * BITS_PER_KEY)
        self.bits = np.zeros((self.m + 7) // 8, np.uint8) if bits is None else bits

    @staticmethod
    def _words(digests: list[bytes]) -> np.ndarray:
        """HASHES 64-bit values of each digest; short ones are hashed first."""
        full = [d if len(d) == 32 else hashlib.sha256(d).digest() for d in digests]
        return np.frombuffer(b"".join(full), "<u8").reshape(-1, 4)[:, :HASHES]

    def add(self, digests: list[bytes]) -> None:
        if digests:
            at = (self._words(digests) % np.uint64(self.m)).ravel()
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))

    def has(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        at = self._words(digests) % np.uint64(self.m)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def better(a: int | None, b: int | None, largest: bool) -> int | None:
    """The identifier that stays; null loses to all others."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


def run_of(digest: bytes, runs: int) -> int:
    """The run of level 1 whose range a digest is in, by its first four bytes."""
    return int.from_bytes(digest[:4].ljust(4, b"\0"), "big") * runs >> 32


RUNS = "run int, digest binary, id bigint, n bigint, filter binary"
_NAMES = ["run", "digest", "id", "n", "filter"]


def _entries(run: int, keys: list[bytes], values: list[tuple[int | None, int]]) -> pa.RecordBatch:
    ids, counts = zip(*values, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([run] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.nulls(len(keys), pa.binary())], _NAMES)


def _runs(normal: Callable, digest: Callable, largest: bool, memtable: int) -> Callable:
    """(text, id) batches to runs of level 0: entries sorted by digest."""

    def flush(table: dict, run: int) -> pa.RecordBatch:
        keys = sorted(table)
        return _entries(run, keys, [table[k] for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, tuple[int | None, int]] = {}
        number = 0
        for batch in batches:
            for text, i in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                d = digest(normal(text.as_py()))
                entry = table.get(d)
                table[d] = (i, 1) if entry is None else (better(entry[0], i, largest), entry[1] + 1)
            if len(table) >= memtable:
                yield flush(table, number)
                table, number = {}, number + 1
        if table:
            yield flush(table, number)

    return run


def _merge(largest: bool) -> Callable:
    """Entries sorted by range and digest to runs of level 1: merged entries, then the run's filter and what it holds."""

    def sealed(run: int, repeated: list[bytes]) -> pa.RecordBatch:
        bloom = Bloom(len(repeated))
        bloom.add(repeated)
        return pa.RecordBatch.from_arrays(
            [pa.array([run], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([len(repeated)], pa.int64()), pa.array([bloom.bits.tobytes()], pa.binary())], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, best, total = None, None, None, 0
        keys: list[bytes] = []
        values: list[tuple[int | None, int]] = []
        repeated: list[bytes] = []

        def close() -> None:
            if last is not None:
                keys.append(last)
                values.append((best, total))
                if total > 1:
                    repeated.append(last)

        for batch in batches:
            for r, d, i, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if d == last:
                    best, total = better(best, i, largest), total + n
                    continue
                close()
                if r != current:
                    if keys:
                        yield _entries(current, keys, values)
                        keys, values = [], []
                    if repeated:
                        yield sealed(current, repeated)
                        repeated = []
                    current = r
                last, best, total = d, i, n
            if len(keys) > 10_000:
                yield _entries(current, keys, values)
                keys, values = [], []
        close()
        if keys:
            yield _entries(current, keys, values)
        if repeated:
            yield sealed(current, repeated)

    return run


def _probe(normal: Callable, digest: Callable, sent, runs: int) -> Callable:
    """Adds the digest to (text, row) batches, a number that no other row has, and for hits alone the normalised bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {r: Bloom(n, np.frombuffer(bits, np.uint8)) for r, (n, bits) in sent.value.items()} if sent is not None else None
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            digests, keep = [], []
            for text in batch.column(0):
                data = normal(text.as_py())
                digests.append(digest(data))
                keep.append(data)
            if filters is not None:
                by_run: dict[int, list[int]] = {}
                for k, d in enumerate(digests):
                    by_run.setdefault(run_of(d, runs), []).append(k)
                for r, places in by_run.items():
                    hit = filters[r].has([digests[k] for k in places]) if r in filters else np.zeros(len(places), bool)
                    for k in np.array(places)[~hit].tolist():
                        keep[k] = None
            n = len(digests)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(digests, pa.binary()), pa.array(range(at, at + n), pa.int64()), pa.array(keep, pa.binary())], ["__row", "__digest", "__at", "__bytes"])
            at += n

    return run


class DigestIndex:
    """The index of one identifier and text column in the shared folder."""

    def __init__(self, spark, *, keep: str = "largest", normal: Callable = ascii_lower, digest: Callable = sha256, memtable: int = MEMTABLE, filter_bytes: int = FILTER_BYTES):
        self.spark, self.largest, self.normal, self.digest = spark, keep == "largest", normal, digest
        self.memtable, self.filter_bytes = memtable, filter_bytes
        self.level0: list[DataFrame] = []
        self.level1: DataFrame | None = None
        self.runs = 1

    def insert(self, df: DataFrame, id_col: str, text_col: str) -> None:
        """Flushes the documents' digests as runs of level 0."""
        rows = df.select(F.col(text_col), F.col(id_col).cast("long"))
        self.level0.append(written(in_arrow(rows, _runs(self.normal, self.digest, self.largest, self.memtable), RUNS), "runs"))

    def compact(self) -> DataFrame:
        """Merges the runs of both levels into level 1, whose entries are (digest, keep_id, group_size) by digest."""
        entries = functools.reduce(DataFrame.unionByName, [*self.level0, *([self.level1] if self.level1 is not None else [])])
        entries = entries.where(F.col("digest").isNotNull())
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs = min(MOST_RUNS, max(tasks, -(-entries.count() // RUN_ROWS)))
        first = F.conv(F.rpad(F.hex(F.substring("digest", 1, 4)), 8, "0"), 16, 10).cast("long")
        dealt = entries.withColumn("run", F.shiftright(first * self.runs, 32).cast("int")).select("run", "digest", "id", "n")
        dealt = dealt.repartition(F.col("run"))
        old, self.level1 = [*self.level0, self.level1], written(in_arrow(dealt.sortWithinPartitions("run", "digest"), _merge(self.largest), RUNS), "level1")
        for run in old:
            if run is not None:
                drop_written(run)
        self.level0 = []
        return self.level1

    def entries(self) -> DataFrame:
        """(digest, keep_id, group_size) of level 1."""
        return self.level1.where(F.col("digest").isNotNull()).select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))

    def filters(self) -> object:
        """The runs' filters as a broadcast variable {run: (digests in it, bits)}; none if they would be too large together."""
        kept = self.level1.where(F.col("filter").isNotNull()).select("run", "n", "filter")
        if (kept.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) > self.filter_bytes:
            return None
        return self.spark.sparkContext.broadcast({r: (n, bytes(bits)) for r, n, bits in kept.toLocalIterator()})

    def resolve(self, df: DataFrame, id_col: str, text_col: str, carry_text: bool = True) -> DataFrame:
        """``df`` with keep_id, group_size, kept and text_sha256 (the digest in hexadecimal)."""
        if self.level1 is None or self.level0:
            self.compact()
        df = with_room(df, [id_col, text_col], ["keep_id", "group_size", "kept", "text_sha256"])
        carried = [c for c in df.columns if carry_text or c != text_col]
        added = [T.StructField("__digest", T.BinaryType()), T.StructField("__at", T.LongType()), T.StructField("__bytes", T.BinaryType())]
        probed = map_beside(df, text_col, carried, _probe(self.normal, self.digest, self.filters(), self.runs), added)
        repeated = self.entries().where(F.col("group_size") > 1).withColumnRenamed("digest", "__d")
        total = self.level1.where(F.col("digest").isNotNull()).agg(F.sum("n")).first()[0] or 0
        probed = join_spread(probed, "__digest", repeated, "__d", "group_size", F.col("__at"), total, how="left").drop("__d")
        probed = written(probed.withColumn("__hit", F.col("group_size").isNotNull()), "probed")

        unique = probed.where(~F.col("__hit")).drop("__bytes", "__hit", "__at")
        unique = unique.withColumn("keep_id", F.col(id_col).cast("long")).withColumn("group_size", F.lit(1).cast("long")).withColumn("kept", F.lit(True))

        hits = probed.where("__hit")
        own = F.col(id_col).cast("long").eqNullSafe(F.col("keep_id"))
        # The row that stays: the first by its bytes, where there are several that carry the identifier.
        first = hits.where(own).groupBy(F.col("__digest").alias("__kd")).agg(
            F.min(F.struct(F.crc32("__bytes").alias("c"), F.col("__bytes").alias("b"), F.col("__at").alias("at"))).alias("__k"), F.first("group_size").alias("__n"))
        kept = first.select("__kd", F.col("__k.b").alias("__kb"), F.col("__k.at").alias("__ka"), "__n")
        checked = join_spread(hits, "__digest", kept, "__kd", "__n", F.col("__at"), total, hot=repeated.select(F.col("__d").alias("__kd"), F.col("group_size").alias("__n")), how="left")
        checked = checked.withColumn("__same", F.col("__bytes").eqNullSafe(F.col("__kb"))).withColumn("__first", F.col("__at") == F.col("__ka"))
        checked = written(checked.drop("__kd", "__kb", "__ka", "__n", "__at"), "checked")

        # Hits whose bytes differ from the kept text's share its digest by chance: their groups are made anew.
        if checked.where(~F.col("__same")).limit(1).count():
            clash = checked.where(~F.col("__same")).select("__digest").distinct()
            clean = checked.join(clash, "__digest", "left_anti")
            group = Window.partitionBy("__digest", "__bytes")
            best = (F.max if self.largest else F.min)(F.col(id_col).cast("long"))
            again = checked.join(clash, "__digest", "left_semi")
            again = again.withColumn("keep_id", best.over(group)).withColumn("group_size", F.count(F.lit(1)).over(group))
            place = Window.partitionBy("__digest", "__bytes").orderBy(own.desc(), F.col(id_col))
            again = again.withColumn("__first", F.row_number().over(place) == 1)
            checked = clean.unionByName(again.select(*map(named, clean.columns)))
        copies = checked.drop("__bytes", "__hit", "__same").withColumnRenamed("__first", "kept")
        out = unique.unionByName(copies.select(*map(named, unique.columns)))
        return out.withColumn("text_sha256", F.lower(F.hex("__digest"))).drop("__digest")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "largest", carry_text: bool = True, **options) -> DataFrame:
    """All rows of ``df`` with keep_id, group_size, kept and text_sha256."""
    index = DigestIndex(df.sparkSession, keep=keep, **options)
    index.insert(df, id_col, text_col)
    index.compact()
    return index.resolve(df, id_col, text_col, carry_text)
