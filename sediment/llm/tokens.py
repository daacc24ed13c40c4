"""Token ids of whole texts with a public tokenizer, as little-endian unsigned 32-bit bytes.

A text's ids are its pieces' ids in order, and each distinct piece is encoded once by the library
and remembered, up to ``limit`` pieces per worker. Pieces are cut where these tokenizers' own
splitting always cuts: at a single space or line feed beside characters that are not white space.
A text in which white space meets white space, or that holds other white space or controls on
which definitions differ, is encoded whole. Within a piece, letters and the ASCII punctuation
that follows them are pieces of their own, and letters alone go straight to the library's model.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space other than space and line feed, then controls that only some definitions count.
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0                　" + "\x00\x1c\x1d\x1e\x1f"
#: The letter whose lower case holds a mark, which joins what follows.
MARKED = "İ"
ASCII_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LIMIT = 200_000
SLICE_BYTES = 2 << 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class _Memo(dict):
    def __init__(self, tokenizer, limit: int):
        self.tokenizer, self.model, self.limit = tokenizer, tokenizer.model, limit
        spec = json.loads(tokenizer.to_str())
        kinds = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"] or {"type": ""}])]
        norms = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])]
        #: Whether letters alone may skip the library's normaliser and splitter: with the space kept, or dropped and lowered.
        self.spaced = kinds == ["ByteLevel"] and not norms
        self.lowered = kinds == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]
        self.letters = str.maketrans({b: c for b, c in enumerate(byte_letters())})

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, text: str) -> bytes:
        """The ids of letters with or without a space before them."""
        bare = text.lstrip(" ")
        # Up to U+024F the lower case of a letter is a matter of that letter alone, and mostly letters again.
        if self.lowered and (bare.isascii() or max(bare) < "ɐ" and bare.lower().isalpha() and unicodedata.is_normalized("NFC", bare)):
            text = bare.lower()
        elif not self.spaced:
            return self.encode(text)
        if text.isascii():
            text = text.replace(" ", self.letters[32])
        else:
            text = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def __missing__(self, key: str) -> bytes:
        # A leading NUL marks a piece that no space precedes; a line feed stands for itself.
        text = key[1:] if key[:1] == "\0" else key if key == "\n" else " " + key
        body = key.rstrip(ASCII_PUNCTUATION)
        bare = body[1:] if key[:1] == "\0" else body
        if not text:
            ids = b""
        elif bare.isalpha() and len(body) < len(key):
            return self[body] + self["\0" + key[len(body) :]]
        elif bare.isalpha():
            ids = self._word(text)
        else:
            ids = self.encode(text)
        if len(self) < self.limit:
            self[key] = ids
        return ids


class Encoder:
    """One tokenizer file. ``slices`` encodes an array of texts, ``ids`` one text."""

    def __init__(self, path: str, limit: int = LIMIT):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.vocabulary = tokenizer.get_vocab_size()
        self.memo = _Memo(tokenizer, limit)
        self.whole = f"[{OTHER_SPACE}{MARKED}]|[ \n][ \n]"

    def slices(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """The texts' ids in order, a list of texts at a time; a null has none.

        A slice holds about SLICE_BYTES of text; its words become codes of a dictionary, the
        dictionary's words become ids, and the texts' ids are gathered by code.
        """
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        slice_of = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), len(slice_of)]
        for first, after in zip(cuts, cuts[1:], strict=False):
            yield self._slice(pc.fill_null(texts.slice(first, after - first), ""))

    def _slice(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, self.whole)
        cut = pc.if_else(odd, "", texts)
        # A stop or comma after a letter and before white space is a piece of its own.
        cut = pc.replace_substring_regex(cut, r"(\pL)([.,])( |\n|$)", "\\1 \0\\2\\3")
        lists = pc.split_pattern(pc.binary_join_element_wise("\0", pc.replace_substring(cut, "\n", " \n \0"), ""), " ")
        coded = lists.flatten().dictionary_encode()
        words = list(map(self.memo.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        pool = np.frombuffer(b"".join(words), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words)) // 4
        starts = np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy()
        counts = lengths[codes]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(starts[codes] - upto[:-1], counts) + np.arange(upto[-1])].tobytes()
        bounds = (4 * upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.memo.encode(texts[i].as_py())
        return out

    def ids(self, text: str | None) -> bytes:
        return next(self.slices(pa.array([text], pa.string())))[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file: its memory of pieces lasts over tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
