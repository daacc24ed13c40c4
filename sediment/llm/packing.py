"""Packing token ids into sequences of fixed size with a bounded number of open windows.

Method. Each partition keeps ``n_open`` windows. A document's ids, with the end id, are cut into
whole sequences and a rest; the rest goes to the window that it fills best. If it fits in none,
the fullest is completed with the head of the rest, where neither part would be shorter than
``min_piece``, and emitted, else emitted as it is; the tail or the rest opens a new one. What is
open at the end of a partition is written with its ids, dealt to few tasks of ``merge_ids`` ids
each, packed once more, and the windows still open there are joined end to end. So a task holds
``n_open`` windows at most, and at most one sequence per merging task is short of ids.

Defined cases: a null or empty text is the end id alone; null and repeated identifiers are carried
as they are; a text of any length is cut; an empty table gives an empty result; only the two
named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, written
from .tokens import encoder

SIZE = 4096
OPEN = 24
MIN_PIECE = 32
MERGE_IDS = 1 << 18
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.binary() if x.endswith("binary") else pa.int64() for x in SCHEMA.split(", ")]


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, first: int, size: int = SIZE, n_open: int = OPEN, min_piece: int = MIN_PIECE, carry: bool = False):
        self.next, self.size, self.n_open, self.min_piece, self.carry = first, size, n_open, min_piece, carry
        self.windows: list[list] = []  # [ids in it, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset, bytes(ids) if self.carry else None))
            offset += n
        self.next += 1

    def place(self, piece: tuple) -> None:
        doc, start, ids, total = piece
        size = self.size
        whole = len(ids) // (4 * size) * size
        if whole:
            view = memoryview(ids)
            for at in range(0, whole, size):
                self.emit([(doc, start + at, view[4 * at : 4 * (at + size)], total)])
            start, ids = start + whole, bytes(view[4 * whole :])  # the rest alone, so that a window never holds the document
        if not ids:
            return
        n = len(ids) // 4
        fits = [w for w in self.windows if w[0] + n <= size]
        if not fits and len(self.windows) >= self.n_open:
            full = max(self.windows, key=lambda w: w[0])
            self.windows.remove(full)
            room = size - full[0]
            if room >= self.min_piece and n - room >= self.min_piece:
                full[1].append((doc, start, ids[: 4 * room], total))
                start, ids, n = start + room, ids[4 * room :], n - room
            self.emit(full[1])
        if fits:
            best = max(fits, key=lambda w: w[0])
        else:
            self.windows.append(best := [0, []])
        best[0] += n
        best[1].append((doc, start, ids, total))
        if best[0] == size:
            self.windows.remove(best)
            self.emit(best[1])

    def join_open(self) -> None:
        """Ends with the open windows' pieces joined end to end, cut where a sequence is full."""
        pieces, fill = [], 0
        for doc, start, ids, total in (p for w in self.windows for p in w[1]):
            while ids:
                part = ids[: 4 * (self.size - fill)]
                pieces.append((doc, start, part, total))
                fill, start, ids = fill + len(part) // 4, start + len(part) // 4, ids[len(part) :]
                if fill == self.size:
                    self.emit(pieces)
                    pieces, fill = [], 0
        if pieces:
            self.emit(pieces)
        self.windows = []

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _first_id(stage: int) -> int:
    return (stage << 56) + (TaskContext.get().partitionId() << 28)


def _encode_and_pack(path: str, end_id: int, options: dict) -> callable:
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), Packer(_first_id(0), **options)
        for batch in batches:
            ids_of = (ids for part in enc.slices(batch.column(1)) for ids in part)
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids += end
                packer.place((doc, 0, ids, len(ids) // 4))
                if len(packer.rows) >= 20_000:
                    yield packer.taken()
        # The open windows, with their ids; no sequence yet.
        for piece in (p for w in packer.windows for p in w[1]):
            packer.rows.append((piece[0], piece[1], len(piece[2]) // 4, zlib.crc32(piece[2]), piece[3], None, None, piece[2]))
        if packer.rows:
            yield packer.taken()

    return run


def _merge(options: dict) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_first_id(1), **options)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                packer.place(row)
            if packer.rows:
                yield packer.taken()
        packer.join_open()
        if packer.rows:
            yield packer.taken()

    return run


def pack(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, size: int = SIZE, n_open: int = OPEN, min_piece: int = MIN_PIECE, merge_ids: int = MERGE_IDS, carry_ids: bool = False) -> DataFrame:
    """One row per piece; with ``carry_ids`` its ids are in ``ids``, else that column is left out."""
    options = {"size": size, "n_open": n_open, "min_piece": min_piece, "carry": carry_ids}
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col))
    packed = written(in_arrow(rows, _encode_and_pack(tokenizer, end_id, options), SCHEMA), "packed")
    left = packed.where(F.col("sequence_id").isNull())
    n = left.agg(F.sum("length")).first()[0] or 0
    merged = in_arrow(left.repartition(max(1, -(-n // merge_ids))), _merge(options), SCHEMA)
    out = packed.where(F.col("sequence_id").isNotNull()).unionByName(merged)
    return out if carry_ids else out.drop("ids")
