"""SentencePiece encoding with the span of the text's own bytes for each piece, and decoding.

Method. The model's file is read as it is. Its compiled character map is a double-array trie; a text
is normalised by the longest prefix that the trie knows, else one character at a time, and each
byte of the result records the byte of the text that it came from. The normalised text is cut
before each run of word marks, and between Latin letters and the rest of ASCII, as no piece of the
model lies across (this is checked); each distinct part is segmented once by the library, with a
copy of the model that does not normalise, and remembered. The pieces' bounds in the
normalised text then project to byte spans of the original: they are in order, and from the first
character that is kept to the last they leave no byte out.

A map that changes nothing needs no walk: the alignment is counted from the text's spaces.

Defined cases: a null or empty text has no piece but the end id; a text that is not kept at all
(white space, where the model drops it) likewise; nulls and repeated identifiers are carried; a
character of several byte pieces has its span at the last of them, as in the library, the others
are empty there; a text of any length is encoded whole; an empty table gives an empty result; all other
columns are carried, but one that has the name of a result gives way to it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_beside, with_room

MARK = "▁"
LIMIT, REMEMBERED_CHARS = 200_000, 64
GROUP_BYTES = 1 << 20
#: Latin letters, and the rest of ASCII: no piece of the usual vocabularies holds one beside the other, which is checked.
LETTER, OTHER = r"[A-Za-zÀ-ÖØ-öø-ɏ]", r"[\x00-\x40\[-`{-\x7F]"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte, at = data[at], at + 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, encoded) of a protocol buffer's fields."""
    at = 0
    while at < len(data):
        start = at
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({5: 4, 1: 8}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value, data[start:at]


class CharMap:
    """The compiled character map: the size of a double-array trie, its units, and the replacements, each ended by NUL."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = array("I", blob[4 : 4 + size])
        self.texts = blob[4 + size :]

    def longest(self, key: bytes, at: int) -> tuple[int, int]:
        """(length, place of the replacement) of the longest prefix known at ``at``; length 0 if there is none."""
        units, best = self.units, (0, 0)
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(key)):
            node ^= key[i]
            unit = units[node] if node < len(units) else 0x80000000
            if unit & 0x800000FF != key[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        return best

    def replacement(self, place: int) -> bytes:
        return self.texts[place : self.texts.index(b"\0", place)]


class Normaliser:
    """A model's normalisation, with the alignment of each byte."""

    def __init__(self, spec: bytes):
        held = {number: value for number, value, _ in fields(spec)}
        self.map = CharMap(held[2]) if held.get(2) else None
        self.dummy, self.squeeze, self.escape = (bool(held.get(k, 1)) for k in (3, 4, 5))

    def align(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, where in the text's bytes that begins."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if self.map is None and self.escape and not self.squeeze:
            kept = np.frombuffer(raw, np.uint8)
            # A place within a character is that of its first byte.
            origin = np.maximum.accumulate(np.where(kept & 0xC0 == 0x80, 0, np.arange(len(raw))))
            origin = np.repeat(origin, np.where(kept == 32, 3, 1))
            lead = np.zeros(3 * self.dummy, np.int64)
            return MARK * self.dummy + text.replace(" ", MARK), np.concatenate([lead, origin, [len(raw)]])
        return self._walk(raw)

    def prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """What the text at ``at`` becomes, and how many bytes of it."""
        if self.map is not None:
            length, place = self.map.longest(raw, at)
            if length:
                return self.map.replacement(place), length
        first = raw[at]
        length = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return raw[at : at + length], length

    def _walk(self, raw: bytes) -> tuple[str, np.ndarray]:
        space = MARK.encode() if self.escape else b" "
        out, origin, at = bytearray(), array("q"), 0
        if self.squeeze:  # leading white space goes
            while at < len(raw) and (step := self.prefix(raw, at))[0] == b" ":
                at += step[1]
        if at == len(raw):
            return "", np.zeros(1, np.int64)
        if self.dummy:
            out += space
            origin.extend([at] * len(space))
        after_space = self.squeeze
        while at < len(raw):
            made, length = self.prefix(raw, at)
            if after_space:
                made = made.lstrip(b" ")
            if made:
                shown = made.replace(b" ", space)
                out += shown
                origin.extend([at] * len(shown))
                after_space = self.squeeze and made.endswith(b" ")
            at += length
        if self.squeeze:  # and so does trailing
            while out.endswith(space):
                del out[-len(space) :]
                at = origin[len(out)]
                del origin[len(out) :]
        origin.append(at)
        return out.decode(), np.array(origin)


class Encoder:
    """One model file. ``encode_all`` gives texts' ids and the byte span of each."""

    def __init__(self, path: str, limit: int = LIMIT):
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        spec = b"".join(value for number, value, _ in fields(model) if number == 3)
        self.normaliser, self.limit = Normaliser(spec), limit
        # The same model but for its normalisation: none, no mark in front, no white space dropped or escaped.
        bare = b"".join(whole for number, _, whole in fields(model) if number != 3) + b"\x1a\x06\x18\x00\x20\x00\x28\x00"
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=bare)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.bare.get_piece_size())
        shown = {i: self.bare.id_to_piece(i) for i in ids if not (self.bare.is_byte(i) or self.bare.is_control(i) or self.bare.is_unknown(i))}
        #: Bytes of the text that a piece stands for; an unknown one stands for what the library says.
        self.sizes = np.array([len(shown[i].encode()) if i in shown else 1 for i in ids], np.int64)
        self.falls_back = any(map(self.bare.is_byte, ids))
        # Without bytes to fall back on, the library joins what it doesn't know into one piece over any bound.
        across = lambda x, y: any(re.search(x + y, p) for p in shown.values())
        self.parts = self.finer = None
        if self.falls_back and not across(f"[^{MARK}]", MARK):
            self.parts = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
            if not across(LETTER, OTHER) and not across(OTHER, LETTER):
                self.finer = re.compile(f"{MARK}*(?:{LETTER}+|{OTHER}+)|{MARK}+")
        self.foreign = re.compile(f"(?!{LETTER}|{OTHER}|{MARK}).", re.DOTALL)
        self.memo: dict[str, np.ndarray] = {}

    def cut(self, shown: str) -> list[str]:
        """The parts of a normalised text over whose bounds no piece goes."""
        if self.parts is None:
            return [shown] if shown else []
        return (self.finer if self.finer and not self.foreign.search(shown) else self.parts).findall(shown)

    def _ids(self, parts: list[str]) -> list[np.ndarray]:
        memo = self.memo
        new = [p for p in parts if p not in memo]
        made = dict(zip(new, (np.array(x, np.int32) for x in self.bare.encode(new)), strict=True)) if new else {}
        found = [made[p] if p in made else memo[p] for p in parts]
        for part in new:
            if len(memo) >= self.limit:
                break
            if len(part) <= REMEMBERED_CHARS:
                memo[part] = made[part]
        return found

    def _gathered(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in order, and how many each has; parts that recur are looked up once."""
        coded = pa.array(parts, pa.large_string()).dictionary_encode()
        distinct = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        pool = np.concatenate([*distinct, np.zeros(0, np.int32)])
        codes = coded.indices.to_numpy()
        counts = sizes[codes]
        upto = np.cumsum(counts)
        return pool[np.repeat((np.cumsum(sizes) - sizes)[codes] - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)], counts

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends, bounds) without end ids: text i has bounds[i] to bounds[i + 1] of them. Starts and ends are bytes of its text."""
        aligned = [self.normaliser.align(t or "") for t in texts]
        lists = [self.cut(shown) for shown, _ in aligned]
        ids, counts = self._gathered([p for parts in lists for p in parts])
        if self.falls_back:
            sizes = self.sizes[ids]
        else:
            made = [p for parts in lists for x in parts for p in self.bare.encode(x, return_type="proto").pieces]
            sizes = np.array([p.end - p.begin for p in made], np.int64)
        of_text = np.cumsum([0, *map(len, lists)])
        bounds = np.concatenate([[0], np.cumsum(counts)])[of_text]
        # All texts' alignments in one: each begins where the one before ends, and has a place more than it has bytes.
        begins = np.cumsum([0, *(len(o) for _, o in aligned)])[:-1]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        within = np.repeat(begins - upto[bounds[:-1]], np.diff(bounds))
        origin = np.concatenate([*(o for _, o in aligned), np.zeros(0, np.int64)])
        return ids, origin[within + upto[:-1]], origin[within + upto[1:]], bounds

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends) of one text."""
        return self.encode_all([text])[:3]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file: what it remembers lasts over tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _ended(values: np.ndarray, bounds: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The texts' values with one more at the end of each."""
    return np.insert(values, bounds[1:], last)


def _encoding(path: str, end_id: int | None, spans: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(size) - size) // GROUP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for first, after in zip(cuts, cuts[1:], strict=False):
                ids, starts, ends, bounds = enc.encode_all(batch.column(0).slice(first, after - first).to_pylist())
                if end_id is not None:  # it stands for nothing, at the end of what the pieces stand for
                    at = np.where(np.diff(bounds) > 0, ends[bounds[1:] - 1] if len(ends) else 0, 0)
                    ids, starts, ends = _ended(ids, bounds, np.full(len(at), end_id)), _ended(starts, bounds, at), _ended(ends, bounds, at)
                    bounds = bounds + np.arange(len(bounds))
                offsets = pa.array(bounds.astype(np.int32))
                columns = [pa.ListArray.from_arrays(offsets, pa.array(c, k)) for c, k in ((ids, pa.int32()), (starts, pa.int64()), (ends, pa.int64()))][: 3 if spans else 1]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, after - first), *columns], [batch.schema.names[1], "ids", "starts", "ends"][: 1 + len(columns)])

    return run


def encode(df: DataFrame, model: str, *, text_col: str = "text", end_id: int | None = 2, spans: bool = True, carry_text: bool = True) -> DataFrame:
    """``df`` with ``ids`` and, unless they are not wanted, ``starts`` and ``ends``: each piece's bytes in the text, end exclusive."""
    results = ["ids", "starts", "ends"] if spans else ["ids"]
    rows = with_room(df, [text_col], results)
    kinds = [T.StructField("ids", T.ArrayType(T.IntegerType())), *(T.StructField(c, T.ArrayType(T.LongType())) for c in results[1:])]
    carried = [c for c in rows.columns if carry_text or c != text_col]
    return map_beside(rows, text_col, carried, _encoding(model, end_id, spans), kinds)


def _decoding(path: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        for batch in batches:
            texts = [library.decode(ids.values.to_numpy()) if ids.is_valid else None for ids in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], [batch.schema.names[1], "decoded"])

    return run


def decode(df: DataFrame, model: str, *, ids_col: str = "ids", carried: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``carried``) with ``decoded``: the text that the model gives back for ``ids``; null for null."""
    rows = with_room(df, [ids_col], ["decoded"])
    return map_beside(rows, ids_col, rows.columns if carried is None else carried, _decoding(model), [T.StructField("decoded", T.StringType())])
