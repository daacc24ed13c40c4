"""SentencePiece spans, dominance counting and importance resampling: hard rows, and plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sediment.llm import dominance, pieces, queries, resampling
from sediment.llm.common import running, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(st.one_of(st.sampled_from(" ▁\t\n 　ab́éＡﬁẛ̣­​<s>中😀\0"), st.characters(codec="utf-8")), max_size=40)


def tagged(number, data):
    size, out = len(data), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes([*out, size]) + data


def with_spec(spec):
    """The model's bytes with another normaliser."""
    with open(MODEL, "rb") as f:
        return b"".join(whole for number, _, whole in pieces.fields(f.read()) if number != 3) + tagged(3, spec)


def rule_spec(rule):
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    return b"".join(value for number, value, _ in pieces.fields(normaliser.serialized_model_proto()) if number == 3)


@pytest.fixture(scope="module")
def models(tmp_path_factory):
    """The model as it is, and with character maps and white space rules of other models."""
    folder, out = tmp_path_factory.mktemp("models"), [MODEL]
    specs = [rule_spec("nmt_nfkc") + b"\x18\x01\x20\x01\x28\x01", rule_spec("nfkc_cf") + b"\x18\x00\x20\x00\x28\x01", b"\x18\x01\x20\x01\x28\x01", b"\x18\x01\x20\x00\x28\x00"]
    for i, spec in enumerate(specs):
        (folder / f"{i}.model").write_bytes(with_spec(spec))
        out.append(str(folder / f"{i}.model"))
    return out


def plain_encoding(library, text):
    """The library's ids and its spans, which are bytes of the text."""
    found = library.encode(text, return_type="proto").pieces
    return [p.id for p in found], [p.begin for p in found], [p.end for p in found]


@pytest.mark.parametrize("which", range(5))
def test_spans_equal_the_librarys(models, which):
    ours = pieces.Encoder(models[which])

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def holds(text):
        ids, starts, ends = ours.encode(text)
        assert (ids.tolist(), starts.tolist(), ends.tolist()) == plain_encoding(ours.library, text)

    holds()
    for text in ("", " ", "  a  b ", "▁x ▁", "é ﬁx　y", "a" * 5000, "中" * 300 + " " * 50, "x\ty\r\nz", "</s> <0x41>"):
        ids, starts, ends = ours.encode(text)
        assert (ids.tolist(), starts.tolist(), ends.tolist()) == plain_encoding(ours.library, text)


def test_memory_is_bounded_and_changes_nothing():
    few, many = pieces.Encoder(MODEL, limit=3), pieces.Encoder(MODEL)
    text = " ".join(f"word{i % 17} {'y' * (i % 90)}" for i in range(500))
    assert few.encode(text)[0].tolist() == many.encode(text)[0].tolist()
    assert few.encode(text)[0].tolist() == many.encode(text)[0].tolist() and len(few.memo) == 3


def test_encode_and_decode_hard_rows(hard, empty, hard_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pieces.decode(pieces.encode(hard, MODEL), MODEL).collect()
    assert len(rows) == len(hard_rows) and "a b.c" in rows[0].asDict()
    for r in rows:
        want = library.encode(r.text or "") + [2]
        assert r.ids == want and r.decoded == library.decode(want)
        raw = (r.text or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == raw
    assert pieces.decode(pieces.encode(empty, MODEL, spans=False), MODEL).count() == 0


def test_op11_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = library.encode(d.text or "") + [2]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[d.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((d.text or "").encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.end_byte) for r in queries.op11_sentencepiece(spark, folder).collect()}
    assert got == want


# ------------------------------------------------------------------ dominance


def plain_above(rows):
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    sums = [([x for x in known if x[0] < s and x[1] > v] if s is not None and v is not None else None) for s, v, *_ in rows]
    return [(None, None) if x is None else (len(x), sum(r[2] or 0 for r in x)) for x in sums]


def test_wavelet_prefix_queries():
    rng = np.random.default_rng(5)
    for size, levels in ((0, 3), (1, 1), (50, 1), (200, 7), (300, 1000)):
        order, level, w = np.sort(rng.integers(0, 20, size)), rng.integers(-5, levels, size), rng.integers(0, 9, size)
        got = dominance.prefix_above(order, level, [np.ones(size, np.int64), w])
        above = (order[None, :] < order[:, None]) & (level[None, :] > level[:, None])
        assert got[0].tolist() == above.sum(1).tolist() and got[1].tolist() == (above * w[None, :]).sum(1).tolist()


@pytest.mark.parametrize("shape", ["even", "hot slot", "hot level", "hot cell", "nulls"])
def test_dominance_against_plain(spark, shape):
    rng = random.Random(shape)
    slot = {"hot slot": lambda: rng.choice([7, 7, rng.randrange(40)])}.get(shape, lambda: rng.randrange(60))
    level = {"hot level": lambda: rng.choice([5, 5, rng.randrange(40)])}.get(shape, lambda: rng.randrange(300))
    rows = [(slot(), level(), rng.choice([1, 2, 3, None])) for _ in range(900)]
    if shape == "hot cell":
        rows += [(30, 150, 1)] * 500
    if shape == "nulls":
        rows += [(None, 3, 1)] * 40 + [(3, None, 1)] * 40 + [(None, None, None)] * 20
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "id int, slot int, level long, weight int, n_above string")
    # Shards of 20 cells: many of them, and slots and levels with more cells than one holds.
    got = sorted((r.id, r.n_above, r.w_above) for r in dominance.dominance(df, shard_cells=20).collect())
    assert got == [(i, *x) for i, x in enumerate(plain_above(rows))]


def test_dominance_of_nothing(spark):
    empty = spark.createDataFrame([], "slot int, level int, weight int")
    assert dominance.dominance(empty).count() == 0
    lone = spark.createDataFrame([(None, 1, 1), (1, None, 1)], "slot int, level int, weight int")
    assert [(r.n_above, r.w_above) for r in dominance.dominance(lone).collect()] == [(None, None)] * 2


def test_slots_and_levels_of_odd_values(spark):
    rows = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59.5' AS a, timestamp'1970-01-02 00:00:00Z' AS b, double('NaN') AS t, -0.05D AS u, 1234.565D AS v")
    got = rows.select(dominance.day_slot(rows, "a"), dominance.day_slot(rows, "b"), dominance.cents_level(F.col("t")), dominance.cents_level(F.col("u")), dominance.cents_level(F.col("v"))).first()
    assert tuple(got) == (-1, 1, None, -1, math.floor(math.floor(100 * 1234.565 + 0.5) / 1000))


def test_running_sums(spark):
    df = spark.createDataFrame([(i % 7, i, i % 3) for i in range(1000)], "k int, id int, v int").repartition(5)
    rows = running(df, [F.desc("k"), F.col("id")], F.col("v"), "before", 450_000).orderBy(F.desc("k"), "id").collect()
    assert [r.before for r in rows] == [0, *np.cumsum([r.v for r in rows])[:-1].tolist()]


# ------------------------------------------------------------------ resampling

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n):
    words = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def plain_resample(docs, target, n, buckets, share, least):
    cut = lambda f: zlib.crc32(f.encode()) % buckets
    held = [plain_features(t, n) for _, t in docs]
    s = collections.Counter(cut(f) for _, fs in held for f in fs)
    t = collections.Counter(cut(f) for x in target for f in plain_features(x, n)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (words, fs) in zip(docs, held, strict=True):
        weight = sum(gain[cut(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: share * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resample_against_plain(spark, hard, hard_rows, n):
    rng = random.Random(n)
    more = [(100 + i, " ".join(rng.choice(["Alpha", "beta", "ÉCOLE", "x1", "中"]) for _ in range(rng.randrange(90)))) for i in range(80)]
    docs = [(r[0], r[1]) for r in hard_rows] + more
    target = ["beta x1 beta", None, "Gamma alpha école"]
    df = hard.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    df = written(df, "docs")
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    # Chunks of 7 words: every text over 40 bytes is cut, and the n-grams over the bounds are carried.
    got = resampling.resample(df, aim, n=n, buckets=50, share=30, chunk_words=7, long_bytes=40)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_resample(docs, target, n, 50, 30, 20)


def test_resample_of_nothing(hard, empty):
    aim = empty.select("text")
    assert resampling.resample(empty, aim).count() == 0
    out = resampling.resample(hard, aim).collect()
    assert sum(r.rank is not None for r in out) == len([r for r in out if r.n_words >= 20]) // 10


def test_copies_take_neighbouring_ranks(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text)] * 50 + [(None, text)] * 50, "doc_id long, text string")
    out = resampling.resample(written(df, "copies"), df.select("text"), share=70).collect()
    assert sorted(r.rank for r in out if r.rank) == list(range(1, 71))
