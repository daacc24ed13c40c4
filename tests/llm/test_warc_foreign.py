"""Records that other tools write: each case gives its derivatives or a broken row, and none ends a task."""

import gzip
import json
import zlib

import pytest

from sediment.llm import warc


def made(http: bytes, body: bytes, head: str = "WARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://a.org/\r\nWARC-Date: 2024-05-05T00:00:00Z", eol: str = "\r\n") -> bytes:
    block = http + b"\r\n\r\n" + body
    lines = f"WARC/1.0\r\nWARC-Type: response\r\n{head}\r\nContent-Length: {len(block)}".replace("\r\n", eol)
    return lines.encode() + (eol * 2).encode() + block + b"\r\n\r\n"


def texts(data: bytes) -> tuple[dict, str, warc.Headers]:
    meta, conversion = warc.derive(data)
    h, block = warc.parse(conversion)
    return json.loads(warc.parse(meta)[1]), block.decode(), h


PAGE = "<html><title>Café</title><p>Prix: 5 € pour un café</p></html>"
OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def test_no_digest_no_identifier_and_odd_heads():
    _, text, h = texts(made(OK, PAGE.encode()))
    assert text == "Café\nPrix: 5 € pour un café" and h["warc-source-payload-digest"] == warc.digest(PAGE.encode()) and h["WARC-Refers-To"] == "<urn:x>"
    one = texts(made(OK, PAGE.encode(), head="warc-target-uri:http://a.org/"))[2]
    two = texts(made(OK, PAGE.encode(), head="warc-target-uri:http://a.org/"))[2]
    assert one["WARC-Refers-To"] == two["WARC-Refers-To"] and one["WARC-Target-URI"] == "http://a.org/" and one["WARC-Date"] == ""
    data = made(OK, PAGE.encode()).replace(b"Content-Length: ", b"CONTENT-length:")
    assert texts(data)[1].startswith("Café") and texts(made(OK, PAGE.encode(), eol="\n"))[1].startswith("Café")


def test_folded_and_repeated_fields():
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nContent-Type: text/html;\r\n charset=iso-8859-1\r\nno colon here"
    meta, text, _ = texts(made(http, PAGE.replace("€", "e").encode("latin-1")))
    assert meta["http"]["headers"] == {"Set-Cookie": ["a=1", "b=2"], "Content-Type": "text/html; charset=iso-8859-1"} and "café" in text


@pytest.mark.parametrize("coding", ["gzip", "x-gzip", "deflate", "raw deflate", "gzip, identity", "stored"])
def test_coded_bodies(coding):
    raw = zlib.compressobj(wbits=-15)
    body = {"deflate": zlib.compress(PAGE.encode()), "raw deflate": raw.compress(PAGE.encode()) + raw.flush(), "stored": PAGE.encode()}.get(coding, gzip.compress(PAGE.encode()))
    name = {"raw deflate": "deflate", "stored": "gzip"}.get(coding, coding)
    assert "café" in texts(made(OK + f"\r\nContent-Encoding: {name}".encode(), body))[1]


def test_chunked_bodies():
    raw = gzip.compress(PAGE.encode())
    body = b"".join(f"{len(raw[i : i + 20]):x};q=1\r\n".encode() + raw[i : i + 20] + b"\r\n" for i in range(0, len(raw), 20)) + b"0\r\n\r\n"
    assert "café" in texts(made(OK + b"\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip", body))[1]
    assert "café" in texts(made(OK + b"\r\nTransfer-Encoding: chunked", PAGE.encode()))[1]


@pytest.mark.parametrize(("page", "codec"), [("<meta charset='windows-1252'>" + PAGE, "cp1252"), (PAGE, "utf-16"), ("\ufeff" + PAGE, "utf-8"), ("<meta http-equiv=x content='text/html; charset=koi8-r'><p>слово café", "koi8-r"), ("<meta charset=nonsense>" + PAGE, "utf-8")])
def test_charsets(page, codec):
    text = texts(made(b"HTTP/1.0 200 OK\r\nContent-Type: text/html", page.encode(codec, "replace")))[1]
    assert ("слово" if codec == "koi8-r" else "café") in text


def test_broken_records_have_their_row(spark):
    whole, more = made(OK, PAGE.encode()), made(OK, b"<p>second")
    bad = [b"WARC/1.0\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n", made(OK + b"\r\nContent-Encoding: br", b"x"), made(OK + b"\r\nContent-Encoding: gzip", b"\x1f\x8bnot"), made(b"gopher", b"x")]
    note = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nnote\r\n\r\n"
    files = {
        "plain": note + whole + b"".join(bad) + more, "members": gzip.compress(note) + gzip.compress(whole) + gzip.compress(more), "cut": whole + more[:-20], "half member": gzip.compress(whole) + gzip.compress(more)[:30],
        "rubbish": b"\x00\xff rubbish", "empty": b"", "none": None,
    }
    rows = warc.file_derivatives(spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "path string, content binary")).collect()
    kinds = {f: [r.kind for r in rows if r.file == f] for f in files}
    pair = ["metadata", "conversion"]
    assert kinds == {"plain": pair + ["broken"] * 4 + pair, "members": pair * 2, "cut": pair * 2, "half member": kinds["half member"], "rubbish": ["broken"], "empty": [], "none": []}
    assert kinds["half member"][:2] == pair and [r.reason for r in rows if r.file == "plain" and r.reason] == ["no Content-Length", "content coding br", "a body that can't be decompressed", "not a response"]
    assert {r.refers_to for r in rows if r.file == "plain" and r.kind != "broken"} == {"<urn:x>"}
