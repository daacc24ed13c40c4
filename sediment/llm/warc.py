"""Derivatives of web archives: metadata and plain-text records that refer to their responses.

Method. A capture becomes a WARC ``response`` record: an identifier derived from its url and
content, the HTTP head as fetched, SHA-1 digests of the block and of the payload. The builder
reads a response record's bytes and derives from it

* a ``metadata`` record: JSON with the HTTP status and headers, title, language (of the first
  ``html`` tag that has one, outside comments, scripts and styles), links and sizes;
* a ``conversion`` record: the page's plain text, without comments, scripts, styles and the
  elements ``noscript``, ``template``, ``svg``, ``nav``, ``footer`` and ``aside``.

Both carry the response's WARC-Target-URI, WARC-Date and payload digest on, and its identifier in
WARC-Refers-To; their own identifiers derive from it, so a rerun after a lost executor writes the
same records. Each response is handled alone where it is read: nothing is shuffled.

Records of other makers are read as they come: names of any case and spacing, folded and repeated
fields, line ends without carriage return, no identifier or digest (both are then computed), chunked,
gzip and deflate bodies, declared charsets, and files of many records, also gzip members. A record
that can't be read gives one row of kind ``broken`` with the reason, and ends no task.

Defined cases: a null page is an empty payload, whose text is empty; a null url is the empty
target; repeated rows give equal records; malformed markup is read as far as it goes, where only a
comment, script or style without its end takes the rest of the page along; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
#: A comment, script or style that nothing ends runs to the end of the page, as in a browser.
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
ASIDES = re.compile(r"<(/?)(noscript|template|svg|nav|footer|aside)(?=[\s/>])[^>]*>", re.IGNORECASE)
BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|title|blockquote|pre)\b[^>]*>", re.IGNORECASE)
TAGS = re.compile(r"<[^>]*>")
TITLE = re.compile(r"<title[^>]*>", re.IGNORECASE)
TITLE_END = re.compile(r"</title", re.IGNORECASE)
HTML_TAG = re.compile(rf"{RAW.pattern}|(<html)(?=[\s/>])", RAW.flags)
LANG = re.compile(r"\blang=[\"']?([A-Za-z-]+)", re.IGNORECASE)
LINK_TAG = re.compile(r"<(a|img|link|script)\b", re.IGNORECASE)
LINK = re.compile(r"\b(?:href|src)=(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Fixed values of the formats: where a head and a line end, a chunk's length, and how a charset is declared.
HEAD_END, LINE_END, NOT_LINE_END = re.compile(rb"\r?\n\r?\n"), re.compile(r"\r?\n"), re.compile(rb"[^\r\n]")
CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]+)[^\r\n]*\r?\n")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.IGNORECASE)
META_CHARSET = re.compile(rb"<meta[^>]{0,400}?charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", re.IGNORECASE)
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: A body that decompresses to more is a broken record, as no page is so long and a task's memory is bounded.
MAX_BODY = 1 << 28
#: References by number whose digits are too many for a character, or that begin with zeros.
ZEROS, LONG_REFERENCE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(parts))}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """The bytes of one record: head, block and the two closing line ends."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Broken(ValueError):
    """A record that can't be read; its text says why."""


class Headers(dict):
    """Header fields by name, whatever its case; the first of a name counts. ``pairs`` has all, as they came."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs
        super().__init__((name.lower(), value) for name, value in reversed(pairs))

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)

    def listed(self) -> dict[str, str | list[str]]:
        """All fields as they came; a name that is repeated has a list."""
        out: dict[str, list[str]] = {}
        for name, value in self.pairs:
            out.setdefault(name, []).append(value)
        return {name: values[0] if len(values) == 1 else values for name, values in out.items()}


def read_fields(lines: list[str]) -> Headers:
    """Fields of any spacing; a line that begins with white space goes on the one before, and one without a colon is passed over."""
    pairs: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and pairs:
            pairs[-1] = (pairs[-1][0], f"{pairs[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, value = line.split(":", 1)
            pairs.append((name.strip(), value.strip()))
    return Headers(pairs)


def split_head(data: bytes, at: int = 0) -> tuple[list[str], int]:
    """The lines of a head that begins at ``at``, and where its block begins; line ends may lack their carriage return."""
    end = HEAD_END.search(data, at)
    stop, begin = end.span() if end else (len(data), len(data))
    head = data[at:stop]
    try:
        text = head.decode()
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    return LINE_END.split(text), begin


def _record_at(data: bytes, at: int) -> tuple[Headers, bytes, int]:
    """The headers and the block of the record at ``at``, and where it ends."""
    if not data.startswith(b"WARC/", at):
        raise Broken("not a WARC record")
    lines, begin = split_head(data, at)
    headers = read_fields(lines[1:])
    length = headers.get("Content-Length") or ""
    if not (length.isascii() and length.isdigit()):
        raise Broken("no Content-Length")
    return headers, data[begin : begin + int(length)], begin + int(length)


def parse(data: bytes) -> tuple[Headers, bytes]:
    """A record's headers and its block, as long as Content-Length says, or as there is."""
    return _record_at(data, 0)[:2]


def members(data: bytes) -> bytes:
    """The content of a file: as it is, or of its gzip members one after the other; a member that is cut off counts as far as it goes."""
    out = []
    while data[:2] == b"\x1f\x8b":
        reader = zlib.decompressobj(31)
        try:
            out.append(reader.decompress(data))
        except zlib.error:
            break
        data = reader.unused_data
    return b"".join(out) if out else data


def read_records(data: bytes) -> Iterator[tuple[Headers, bytes] | Broken]:
    """All records of a file; a broken one in its place, after which the next begin of a record is sought."""
    data, at = members(data), 0
    while (at := NOT_LINE_END.search(data, at).start() if NOT_LINE_END.search(data, at) else len(data)) < len(data):
        try:
            headers, block, at = _record_at(data, at)
            yield headers, block
        except Broken as e:
            yield e
            following = data.find(b"\nWARC/", at)
            at = len(data) if following < 0 else following + 1


def _unchunked(body: bytes) -> bytes:
    """A body without the lengths of its chunks; as far as they can be read."""
    out, at = [], 0
    while m := CHUNK.match(body, at):
        size = int(m[1], 16)
        if size == 0:
            break
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if body.startswith(b"\r\n", at) else 1 if body.startswith(b"\n", at) else 0
    return b"".join(out) if out or CHUNK.match(body) else body


def _inflated(body: bytes, windows: tuple[int, ...]) -> bytes:
    for window in windows:
        reader = zlib.decompressobj(window)
        try:
            out = reader.decompress(body, MAX_BODY)
        except zlib.error:
            continue
        if reader.unconsumed_tail:
            raise Broken(f"a body of more than {MAX_BODY} bytes")
        return out
    raise Broken("a body that can't be decompressed")


def decoded_body(http: Headers, body: bytes) -> bytes:
    """The body without transfer and content coding; other codings than chunked, gzip and deflate make a record broken."""
    if "chunked" in (http.get("Transfer-Encoding") or "").lower():
        body = _unchunked(body)
    for coding in reversed([c.strip().lower() for c in (http.get("Content-Encoding") or "").split(",")]):
        if coding in ("gzip", "x-gzip"):
            body = _inflated(body, (31,)) if body[:2] == b"\x1f\x8b" else body  # some archives store it decoded
        elif coding == "deflate":
            body = _inflated(body, (15, -15))
        elif coding not in ("", "identity"):
            raise Broken(f"content coding {coding}")
    return body


def page_of(http: Headers, body: bytes) -> str:
    """The body as text: by the charset that the head declares, a byte order mark, the page's own declaration, else UTF-8."""
    declared = CHARSET.search(http.get("Content-Type") or "")
    name = declared[1] if declared else None
    if name is None:
        name = next((c for mark, c in MARKS if body.startswith(mark)), None)
    if name is None and (own := META_CHARSET.search(body, 0, 4096)):
        name = own[1].decode("ascii", "replace")
    try:
        codecs.lookup(name or "utf-8")
        return body.decode(name or "utf-8", "replace")
    except (LookupError, ValueError, UnicodeError):
        return body.decode("utf-8", "replace")


def response(url: str | None, page: str | None, date: str = DATE) -> bytes:
    """The response record of a capture."""
    # A line end in a url would begin another header.
    url, payload = (url or "").replace("\r", "%0D").replace("\n", "%0A"), (page or "").encode()
    block, seal = HEAD.format(n=len(payload)).encode() + payload, digest(payload)
    headers = {"WARC-Record-ID": record_id("response", url, seal), "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": seal,
               "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response"}
    return record("response", headers, block)


def unescape(text: str) -> str:
    """html.unescape, whose cost is each reference's: the most common one is set aside as a private character."""
    if "&#" in text:
        text = LONG_REFERENCE.sub("\ufffd", ZEROS.sub("&#", text))
    if "&" not in text or "\ue000" in text:
        return entities.unescape(text)
    text = text.replace("&amp;", "\ue000")
    return (entities.unescape(text) if "&" in text else text).replace("\ue000", "&")


def without_asides(page: str) -> str:
    """The page without its asides, each from its tag to the end tag that matches; a tag without one takes nothing along."""
    opened: list[tuple[str, int]] = []
    counts, spans = Counter(), []
    for m in ASIDES.finditer(page, 0, page.rfind(">") + 1):
        name = m[2].lower()
        if not m[1]:
            if not m[0].endswith("/>"):
                opened.append((name, m.start()))
                counts[name] += 1
        elif counts[name]:
            while True:
                inner, start = opened.pop()
                counts[inner] -= 1
                if inner == name:
                    break
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, m.end()))
    kept, at = [], 0
    for start, end in spans:
        kept.append(page[at:start])
        at = end
    return " ".join([*kept, page[at:]])


def plain_text(page: str) -> str:
    """Text of a page: lines at block elements, entities decoded, white space in a line collapsed."""
    page = without_asides(RAW.sub(" ", page))
    # Behind the last > no tag can end, and a search for it there would be in vain from every <.
    last = page.rfind(">") + 1
    text = unescape(TAGS.sub(" ", BREAKS.sub("\n", page[:last])) + page[last:])
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def page_title(page: str) -> str | None:
    """What stands between the first title tag and the end tag behind it."""
    first = TITLE.search(page, 0, page.rfind(">") + 1)
    last = first and TITLE_END.search(page, first.end())
    return " ".join(unescape(page[first.end() : last.start()]).split()) if last else None


def page_lang(page: str) -> str | None:
    """The language of the first html tag that has one, outside comments, scripts and styles."""
    at, end = 0, -1
    while m := HTML_TAG.search(page, at):
        at = m.end()
        if m[2] and at > end:  # else the same tag's end has been searched from further left
            end = page.find(">", at)
            end = len(page) if end < 0 else end
            found = LANG.findall(page, at, end)
            if found:
                return found[-1].lower()
    return None


def page_links(page: str) -> list[dict]:
    """The first reference of each tag that may have one. Both searches only go forward, so a page is read once by each."""
    out, at, found = [], 0, LINK.search(page)
    end = -1
    while found and (m := LINK_TAG.search(page, at)):
        at = m.end()
        if found.start() < at:
            found = LINK.search(page, at)
        if at > end:
            end = page.find(">", at)
            end = len(page) if end < 0 else end
        if found and found.start() < end:
            out.append({"tag": m[1].lower(), "url": unescape(found[1] or found[2] or found[3] or "")})
            at = found.end()
    return out


def describe(status: str, http: dict[str, str], page: str, text: str) -> dict:
    return {"http": {"status": status, "headers": http}, "title": page_title(page), "lang": page_lang(page),
            "links": page_links(page), "payload_chars": len(page), "text_chars": len(text)}


def derive(data: bytes) -> tuple[bytes, bytes]:
    """The metadata and the conversion record of a response record."""
    return derive_from(*parse(data))


def derive_from(source: Headers, block: bytes) -> tuple[bytes, bytes]:
    """The same of a record that has been read. What it lacks is computed: its identifier and digest from its content."""
    lines, begin = split_head(block)
    if (source.get("WARC-Type") or "response").lower() != "response" or not lines[0].startswith("HTTP/"):
        raise Broken("not a response")
    payload, http = block[begin:], read_fields(lines[1:])
    page = page_of(http, decoded_body(http, payload))
    text = plain_text(page)
    refers = source.get("WARC-Record-ID") or record_id("response", source.get("WARC-Target-URI") or "", digest(block))
    seal = source.get("WARC-Payload-Digest") or digest(payload)

    def linked(kind: str, content: str, body: bytes) -> bytes:
        headers = {"WARC-Record-ID": record_id(kind, refers), "WARC-Refers-To": refers, "WARC-Target-URI": source.get("WARC-Target-URI") or "", "WARC-Date": source.get("WARC-Date") or "",
                   "WARC-Source-Payload-Digest": seal, "WARC-Block-Digest": digest(body), "Content-Type": content}
        return record(kind, headers, body)

    meta = json.dumps(describe(lines[0], http.listed(), page, text), ensure_ascii=False, sort_keys=True)
    return linked("metadata", "application/json", meta.encode()), linked("conversion", "text/plain", text.encode())


SCHEMA = "page_id bigint, kind string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, block_bytes bigint, record binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]


def _build(carry: bool, date: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part, rows = batch.slice(first, 500), []
                for page_id, url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    for data in derive(response(url, page.as_py(), date)):
                        h, block = parse(data)
                        rows.append((page_id, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"],
                                     h["WARC-Source-Payload-Digest"], h["WARC-Block-Digest"], len(block), data if carry else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return run


def derivatives(df: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html", *, carry_records: bool = True, date: str = DATE) -> DataFrame:
    """Two rows for each page: its metadata and conversion records, with their bytes if asked for."""
    rows = df.select(F.col(id_col).cast("long"), F.col(url), F.col(page))
    out = in_arrow(rows, _build(carry_records, date), SCHEMA)
    return out if carry_records else out.drop("record")


FILE_SCHEMA = "file string, place bigint, kind string, record_id string, refers_to string, target_uri string, source_digest string, record binary, reason string"


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FILE_SCHEMA.split(", ")]
    types = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in FILE_SCHEMA.split(", ")]
    for batch in batches:
        for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for place, held in enumerate(read_records(data.as_py() or b"")):
                rows, reason = [], str(held) if isinstance(held, Broken) else None
                if reason is None and (held[0].get("WARC-Type") or "").lower() != "response":
                    continue  # requests, notes and other derivatives have none of their own
                try:
                    made = () if reason else derive_from(*held)
                    for h, data_ in ((parse(d)[0], d) for d in made):
                        rows.append((file, place, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Source-Payload-Digest"], data_, None))
                except Broken as e:
                    reason = str(e)
                if reason is not None:
                    rows = [(file, place, "broken", *[None] * 5, reason)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def file_derivatives(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """The derivatives of all responses in archive files (name, content), such as ``spark.read.format("binaryFile")`` gives; ``place`` counts a file's records."""
    return in_arrow(files.select(F.col(name), F.col(content)), _from_files, FILE_SCHEMA)
