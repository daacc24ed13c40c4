"""A store of token ids: concatenated id arrays with Elias-Fano coded document boundaries.

Format. Documents in ascending order of identifier fall in parts (ranges of identifiers) and
these in segments of about ``segment_ids`` ids. A segment is one row of a Parquet table, so that
Spark's committer makes writing safe and any store that Spark reads can hold it:
``part, segment, before`` (ids of the part before it), ``n_docs, n_nulls, first_doc``, ``ids`` (all ids, little-endian,
16 bits if the vocabulary allows, else 32), ``ends`` (where documents end) and ``docs`` (their
identifiers less the first), both Elias-Fano coded: log2(u / n) + 2 bits an entry, no 64-bit table.
The i-th entry is found through select samples without decoding the others: ``read_store`` takes
each boundary from there, and ``lookup`` finds single documents by bisection and their offsets.

Defined cases: null identifiers come first, as nulls; equal identifiers are ordered by their
text's CRC; a null or empty text is the end id alone; a text of any length is in one segment; an
empty table gives an empty store; only the two named columns are read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow
from .tokens import encoder

SEGMENT_IDS = 1 << 20
SAMPLE = 64


class EliasFano:
    """A nondecreasing list of whole numbers: low bits packed, high bits as unary gaps, select samples."""

    HEAD = struct.Struct("<QQB")

    def __init__(self, data: bytes):
        self.n, self.universe, self.low_bits = self.HEAD.unpack_from(data)
        at = self.HEAD.size
        n_low, n_high = (self.n * self.low_bits + 7) // 8, (self.n + (self.universe >> self.low_bits) + 8) // 8
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        self.samples = np.frombuffer(data, "<u4", offset=at + n_low + n_high)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(8 * ((n + (universe >> low_bits) + 8) // 8), np.uint8)
        high[ones] = 1
        samples = ones[::SAMPLE].astype("<u4").tobytes()
        return cls.HEAD.pack(n, universe, low_bits) + low + np.packbits(high, bitorder="little").tobytes() + samples

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        window = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8 + 1].tobytes(), "little")
        return (window >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, scan the high bits for the (i mod SAMPLE)-th one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            block = np.unpackbits(self.high[byte : byte + 64], bitorder="little")[skip:]
            ones = np.flatnonzero(block)
            if left < len(ones):
                place = 8 * byte + skip + int(ones[left])
                return ((place - i) << self.low_bits) | self._low(i)
            left, byte, skip = left - len(ones), byte + 64, 0

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the i-th of the stretches that end at the values starts and ends."""
        return self.select(i - 1) if i else 0, self.select(i)

    def first_at_least(self, value: int) -> int:
        """The place of the first entry that is not below the value, by bisection."""
        return bisect_left(range(self.n), value, key=self.select)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        values = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            values |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return values


SCHEMA = "part int, segment int, before bigint, n_docs bigint, n_nulls bigint, first_doc bigint, n_ids bigint, width int, ids binary, ends binary, docs binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]


def _segments(path: str, end_id: int, segment_ids: int) -> callable:
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = 2 if max(enc.vocabulary, end_id + 1) <= 1 << 16 else 4
        part, number, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        lengths: list[int] = []
        chunks: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            known = np.array([d for d in docs if d is not None], np.int64)
            first = int(known[0]) if len(known) else 0
            ids = np.frombuffer(b"".join(chunks), "<u4").astype(f"<u{width}").tobytes()
            values = (part, number, before, len(docs), len(docs) - len(known), first, size, width, ids,
                      EliasFano.encode(np.cumsum(np.array(lengths, np.uint64))), EliasFano.encode((known - first).astype(np.uint64)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], _NAMES)

        for batch in batches:
            ids_of = (ids for part in enc.slices(batch.column(1)) for ids in part)
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids += end
                docs.append(doc)
                lengths.append(len(ids) // 4)
                chunks.append(ids)
                size += len(ids) // 4
                if size >= segment_ids:
                    yield row()
                    number, before, size = number + 1, before + size, 0
                    docs, lengths, chunks = [], [], []
        if docs:
            yield row()

    return run


def write_store(df: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes every text and writes the store to ``path``."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.crc32("text"))
    segments = in_arrow(rows, _segments(tokenizer, end_id, segment_ids), SCHEMA)
    # Small row groups bound what a reader holds at once.
    segments.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def part_offsets(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part: one number for each range of the write, however large the parts."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    out, total = {}, 0
    for part, n in sums:
        out[part], total = total, total + n
    return out


def _documents(offsets: dict[int, int], carry_ids: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                coded = EliasFano(s["ends"])
                ends = np.array([coded.select(i) for i in range(coded.n)], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(s["ids"], f"<u{s['width']}").astype("<u4").tobytes()
                docs = [None] * s["n_nulls"] + (EliasFano(s["docs"]).all().astype(np.int64) + s["first_doc"]).tolist()
                views = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts + offsets[s["part"]] + s["before"], pa.int64()), pa.array(ends - starts, pa.int64()),
                     pa.array([zlib.crc32(v) for v in views], pa.int64()), pa.array(views if carry_ids else [None] * len(views), pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_store(spark: SparkSession, path: str, *, carry_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    out = in_arrow(spark.read.parquet(path), _documents(part_offsets(spark, path), carry_ids), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return out if carry_ids else out.drop("ids")


def _found(offsets: dict[int, int], wanted: list[int | None], carry_ids: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                ends, docs, rows = EliasFano(s["ends"]), EliasFano(s["docs"]), []
                for doc in wanted:
                    if doc is None:
                        places = range(s["n_nulls"])
                    elif docs.n and s["first_doc"] <= doc <= s["first_doc"] + docs.universe:
                        first, behind = (docs.first_at_least(doc - s["first_doc"] + k) for k in (0, 1))
                        places = range(s["n_nulls"] + first, s["n_nulls"] + behind)
                    else:
                        continue
                    for a, b in map(ends.bounds, places):
                        w = s["width"]
                        ids = np.frombuffer(s["ids"], f"<u{w}", b - a, a * w).astype("<u4").tobytes() if carry_ids else None
                        rows.append((doc, a + offsets[s["part"]] + s["before"], b - a, ids))
                if rows:
                    columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["doc_id", "start", "n_tokens", "ids"])

    return run


def lookup(spark: SparkSession, path: str, docs: Iterable[int | None], *, carry_ids: bool = False) -> DataFrame:
    """One row for each document of these identifiers: doc_id, start, n_tokens and, if asked for, ids; no other is decoded."""
    segments = spark.read.parquet(path).drop(*[] if carry_ids else ["ids"])
    out = in_arrow(segments, _found(part_offsets(spark, path), list(dict.fromkeys(docs)), carry_ids), "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    return out if carry_ids else out.drop("ids")
