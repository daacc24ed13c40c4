"""Secrets in whole texts: three base patterns, and structures confirmed by decoding.

Method. The base patterns find assignments, access keys and long hexadecimal runs. Beside them,
runs of base64, base64url or hexadecimal characters are candidates, which are decoded and parsed
before they are reported. A run may be broken into lines (also by escaped line ends), a structure
may begin anywhere in it, and must end with it or with a line:

* ``jwt``: three base64url parts in a line, the first a JSON object with a text ``alg``, the second JSON;
* ``pem``: a private-key armour whose body decodes to a key encoding, or, behind headers that name a
  cipher and its first block, to whole blocks of that cipher; its line ends may be escaped, as in
  JSON, and the whole may be in base64 or hexadecimal;
* ``der``: a DER sequence whose length is that of the data, in which every nested length closes
  exactly, and whose content is a PKCS#1, PKCS#8, SEC1 or encrypted PKCS#8 private key;
* ``ssh``: an OpenSSH private key: its magic, then length-prefixed strings that end with the data.

Positions are code points, ends exclusive. A key in an armour is both ``pem`` and, by its body,
``der`` or ``ssh``. A text is scanned whole, in one pass for each pattern,
and nothing of it leaves its task but spans. Rows are independent, so no row is ever moved.

Defined cases: null and empty texts have no spans; repeated rows are scanned alike; ties of start
are in the order of ``KINDS``; an empty table gives an empty result; extra columns pass through,
but one that has the name of a result gives way to it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_beside, with_room

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run of 20 or more from the first AKIA on, as a shorter run holds no longer one.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CLAIMS = re.compile(r"\.([A-Za-z0-9_-]{2,}+)(?=\.)")
PART = re.compile(r"[A-Za-z0-9_-]*")
PART_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
SPACE = re.compile(r"[ \t\r\n]*")
OBJECT = re.compile(r'\{[ \t\r\n]*"')
#: What tells where JSON values nest: brackets, and quotes with the escapes before them.
MARKS = re.compile(r'\\*"|[{}\[\]]')
ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
#: What may stand between the characters of a body: white space, line ends as JSON and .env files escape them, the escape of a slash.
BETWEEN = re.compile(r"\s+|\\+[nrt]|\\+(?=/)")
LINE_ENDS = re.compile(r"\\+r\\+n|\\+[nr]|\r\n?")
HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*): ?(.*)")
CIPHER = re.compile(r"[A-Z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})")
#: Line ends, as they are or escaped, and the indentation behind; the first character is a set, for which re looks fast.
_END = r"(?:(?<!\\)\\++[nr\r\n]|[\r\n])"
BREAK = re.compile(rf"[\\\r\n](?:(?<=[\r\n])|(?<!\\\\)\\*+[nr\r\n])(?:[ \t]*+{_END})*+[ \t]*+")
#: The smallest structure, a SEC1 key of 128 bits, has 23 bytes.
RUN = re.compile(r"[A-Za-z0-9+/_-]{31,}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{46,}")
#: DER sequences begin with byte 0x30, then at most 0x84, and SSH keys with "openssh-key-v1".
STARTS = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjE")
HEX_STARTS = re.compile(r"(?=30|6f70656e7373682d6b65792d7631)", re.IGNORECASE)
#: "-----BEGIN " at each of the three places of a byte in base64, without the characters that it shares.
ARMOURED = re.compile(r"LS0tLS1CRUdJTi|0tLS0tQkVHSU4g|tLS0tLUJFR0lOI")
HEX_ARMOURED = re.compile(r"2d2d2d2d2d424547494e20", re.IGNORECASE)
MAGIC = b"openssh-key-v1\0"


def from_base64(text: str) -> bytes | None:
    """Decodes either alphabet, with or without padding; None if it is neither."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes | memoryview, depth: int = 0) -> list[tuple[int, memoryview]] | None:
    """(tag, content) of consecutive DER values that fill ``data`` exactly, nested ones checked; else None. Contents are views, not copies."""
    data = memoryview(data)
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + length > len(data):
            return None
        content = data[at : at + length]
        if tag & 0x20 and (depth > 16 or der_items(content, depth + 1) is None):
            return None
        items.append((tag, content))
        at += length
    return items


def der_length(head: bytes) -> int | None:
    """Bytes of the DER sequence that begins so, by its own length; None if its first value is neither number nor sequence."""
    if len(head) < 3 or head[0] != 0x30:
        return None
    length, at = head[1], 2
    if length >= 0x80:
        at += length & 0x7F
        if not 3 <= at <= 6:
            return None
        length = int.from_bytes(head[2:at], "big")
    return at + length if len(head) > at and head[at] in (0x02, 0x30) else None


def is_private_der(data: bytes | memoryview | None) -> bool:
    """Whether the data is one DER private key, to the last byte."""
    outer = der_items(data) if data else None
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1]) or []
    tags, first = [t for t, _ in inner], inner[0][1] if inner else b""
    if tags[:9] == [0x02] * 9 and first in (b"\0", b"\1"):
        return True  # PKCS#1: version and eight integers
    if tags[:3] == [0x02, 0x30, 0x04] and first in (b"\0", b"\1"):
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06  # PKCS#8: version, algorithm with its identifier, key
    if tags[:2] == [0x02, 0x04] and first == b"\1":
        return len(inner[1][1]) in range(16, 67)  # SEC1: version 1, the number
    if tags == [0x30, 0x04]:
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(inner[1][1]) >= 32  # encrypted PKCS#8
    return tags[:6] == [0x02] * 6 and first == b"\0"  # DSA


def ssh_length(data: bytes, at: int = 0) -> int | None:
    """Bytes of the OpenSSH private key that begins at ``at``: its last length-prefixed string ends it; else None."""
    first = at
    if not data.startswith(MAGIC, at):
        return None
    at += len(MAGIC)

    def string() -> bool:
        nonlocal at
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return False
        at = end
        return True

    cipher = at + 4
    if not string() or not data[cipher:at].isascii() or not string() or not string() or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at - first if 1 <= keys <= 64 and all(string() for _ in range(keys + 1)) else None


def is_private_ssh(data: bytes | None) -> bool:
    """Whether the data is an OpenSSH private key: every length-prefixed string lies within it, the last ends it."""
    return bool(data) and ssh_length(data) == len(data)


def is_jwt(token: str) -> bool:
    head, body, _ = token.split(".")
    try:
        header, claims = (json.loads(from_base64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def object_at(text: str) -> int | None:
    """Where the JSON object that ends the text begins: at the bracket that matches its last one, found from the end."""
    depth, inside = 0, False
    for m in reversed(list(MARKS.finditer(text))):
        if m[0][-1] == '"':
            inside ^= len(m[0]) % 2 == 1
        elif not inside:
            depth += 1 if m[0] in "}]" else -1
            if depth == 0:
                return m.start()
    return None


def header_at(head: str) -> int | None:
    """Where the JWT header that ends ``head`` begins: the first place from which it is a JSON object with a text ``alg``."""
    found = []
    for a in range(min(4, len(head))):
        text = (from_base64(head[a:]) or b"").decode("latin-1").rstrip(" \t\r\n")
        if not text.endswith("}") or (at := object_at(text)) is None or not OBJECT.match(text, at):
            continue
        i = at
        while i % 3 and text[i - 1] in " \t\r\n":
            i -= 1
        try:
            if i % 3 == 0 and isinstance(json.loads(text[at:]).get("alg"), str):
                found.append(a + i // 3 * 4)
        except (ValueError, RecursionError):
            continue
    return min(found, default=None)


def is_object(part: str) -> bool:
    data = from_base64(part) or b""
    try:
        return data.lstrip()[:1] == b"{" and isinstance(json.loads(data), dict)
    except (ValueError, RecursionError):
        return False


def jwt_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens, found by their middle parts."""
    out, done = [], 0
    for m in CLAIMS.finditer(text):
        if m.start() < done or not is_object(m[1]):
            continue
        first = m.start()
        while first > done and text[first - 1] in PART_CHARS:
            first -= 1
        start, end = header_at(text[first : m.start()]), PART.match(text, m.end() + 1).end()
        if start is not None and is_jwt(text[first + start : end]):
            out.append((first + start, end))
            done = end
    return out


def is_pem(kind: str, body: str) -> bool:
    headers, at = {}, 0
    if ":" in body:
        body = LINE_ENDS.sub("\n", body).strip()
        while m := HEADER.match(body, at):
            headers[m[1]] = m[2].strip()
            at = SPACE.match(body, m.end()).end()
    data = from_base64(BETWEEN.sub("", body[at:]))
    if headers:
        cipher = CIPHER.fullmatch(headers.get("DEK-Info", ""))
        # The cipher's first block is as long as all others; the smallest key fills two of them.
        return bool(data and cipher) and headers.get("Proc-Type") == "4,ENCRYPTED" and len(data) >= 24 and len(data) % (len(cipher[1]) // 2) == 0
    return is_private_ssh(data) if kind.startswith("OPENSSH") else is_private_der(data)


def pem_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the armoured keys: each END with the last BEGIN before it, so that one without its END hides no other."""
    out, begin = [], None
    for m in ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin and begin[2] == m[2]:
            if is_pem(m[2], text[begin.end() : m.start()]):
                out.append((begin.start(), m.end()))
            begin = None
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def squeezed(text: str) -> tuple[str, list[int], list[int]]:
    """The text without line ends, the places in it where they were, and the characters that are missing from each on."""
    parts, cuts, missing, at, gone = [], [], [], 0, 0
    for m in BREAK.finditer(text):
        parts.append(text[at : m.start()].rstrip(" \t"))
        first = at + len(parts[-1])
        cuts.append(first - gone)
        gone += m.end() - first
        missing.append(gone)
        at = m.end()
    return "".join([*parts, text[at:]]), cuts, missing


def from_hex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def from_run(text: str) -> bytes:
    return from_base64(text[:-1] if len(text) % 4 == 1 else text) or b""


def coded_keys(run: str, starts: re.Pattern, armoured: re.Pattern, decode: Callable[[str], bytes], chars: int, octets: int, ends: Callable[[int], bool]) -> Iterator[tuple[int, int, int]]:
    """(start, kind's number, end) of the keys in a run that has ``chars`` characters for each ``octets`` bytes.

    DER and SSH keys have their own length, so that a run may go on behind the line that ends one.
    """
    held: dict[int, bytes] = {}

    def decoded(shift: int) -> bytes:
        if shift not in held:
            held[shift] = decode(run[shift:])
        return held[shift]

    done = 0
    for m in starts.finditer(run):
        k = m.start()
        if k < done:
            continue
        head, at = decode(run[k : k + 4 * chars]), k // chars * octets
        length = der_length(head) if head[:1] == b"0" else ssh_length(decoded(k % chars), at)
        if length is None:
            continue
        end = k - (-length * chars // octets)
        if end > len(run) or not ends(end):
            continue
        if head[:1] != b"0":
            yield k, 6, end
        elif is_private_der(memoryview(decoded(k % chars))[at : at + length]):
            yield k, 5, end
        else:
            continue
        done = end
    if armoured.search(run):
        for shift in range(chars):
            text = decoded(shift).decode("latin-1")
            for a, b in pem_spans(text):
                end, last = (shift - (-x * chars // octets) for x in (b, SPACE.match(text, b).end()))
                yield shift + a * chars // octets, 4, last if ends(last) else end


def coded_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the keys in base64 and hexadecimal runs."""
    flat, cuts, missing = squeezed(text)
    out = []

    def place(at: int) -> int:
        i = bisect_right(cuts, at)
        return at + (missing[i - 1] if i else 0)

    def spans(first: int, run: str, *how, pad: int = 0) -> None:
        def ends(at: int) -> bool:
            i = bisect_left(cuts, first + at)
            return at == len(run) or (i < len(cuts) and cuts[i] == first + at)

        for a, kind, b in coded_keys(run, *how, ends):
            out.append((place(first + a), kind, place(first + b + (pad if b == len(run) else 0) - 1) + 1))

    for m in RUN.finditer(flat):
        pad = 2 if flat.startswith("==", m.end()) else int(flat.startswith("=", m.end()))
        spans(m.start(), m[0], STARTS, ARMOURED, from_run, 4, 3, pad=pad)
        for h in HEX_RUN.finditer(m[0]):
            spans(m.start() + h.start(), h[0], HEX_STARTS, HEX_ARMOURED, from_hex, 2, 1)
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the candidates whose structure holds."""
    out = [(a, 3, b) for a, b in jwt_spans(text)]
    if "PRIVATE KEY-----" in text:
        out += [(a, 4, b) for a, b in pem_spans(text)]
    return out + coded_spans(text)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(set(spans)))


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return *counts, joined(base), joined(base + confirmed_spans(text))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan(t.as_py()) for t in batch.column(0)]
        columns = [list(c) for c in zip(*found, strict=True)] if found else [[], [], [], [], []]
        columns[3] = [hashlib.sha256(x.encode()).hexdigest() for x in columns[3]]
        arrays = [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column(1), *arrays], ["__row", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_scan(df: DataFrame, text: str = "text", *, carry_text: bool = False) -> DataFrame:
    """``df`` with the base counts, the digest of the base spans, and all spans."""
    df = with_room(df, [text], ["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    carried = [c for c in df.columns if carry_text or c != text]
    added = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    return map_beside(df, text, carried, _scan, added)
