"""The pipeline, stage by stage, on hard rows, and against plain rules on the small table."""

import collections
import hashlib
import itertools
import os
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sediment.llm import exact_dedup
from sediment.llm.common import written


def through(spark, docs):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, ""), name)
        out[name] = (before, docs)
    return out


def test_hard_rows_and_an_empty_table_go_through(spark, hard, empty):
    for docs in (hard, empty):
        stages = through(spark, docs)
        for name, (before, after) in list(stages.items())[:-1]:
            assert after.columns == docs.columns, name
            if name != "mixing":
                assert after.exceptAll(before).count() == 0, name
    kept = through(spark, hard)["quality_rules"][1]
    assert {r.doc_id for r in kept.collect()} & {4, 5, 6, 7} == set() and {r["__h"] for r in kept.collect()} == {"h"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = through(spark, docs)
    exact = stages["exact_dedup"]
    low = lambda df: [exact_dedup.ascii_lower(r.text) for r in df.select("text").collect()]
    assert sorted(low(exact[1])) == sorted(set(low(exact[0])))
    mixed = stages["mixing"]
    assert mixed[1].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = stages["packing"][1]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert packed.select("doc_id").distinct().count() == mixed[1].select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == packed.count()


def brute_classes(texts: dict) -> set:
    """The smallest identifier of each class of texts that chains of links at 0.8 or more join."""
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        common = len(sets[a] & sets[b])
        if common and 5 * common >= 4 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {root(i) for i in texts}


def test_every_stage_equals_a_plain_version(spark, tmp_path):
    """Each stage's rows over sf0.001, against SQL, dictionaries, all pairs and a sorted list."""
    from sediment.llm.sql import OP1
    from test_ops import plain_targets

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        after[name] = docs.collect()
    ids = lambda name: sorted(r.doc_id for r in after[name])

    assert ids("quality_rules") == sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({OP1}) WHERE kept").fetchall())
    best = {}
    for r in after["quality_rules"]:
        best[(r.text or "").encode().lower()] = max(r.doc_id, best.get((r.text or "").encode().lower(), r.doc_id))
    assert ids("exact_dedup") == sorted(best.values())
    assert ids("near_dedup") == sorted(brute_classes({r.doc_id: r.text for r in after["exact_dedup"]}))

    rows = [(r.source, r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), zlib.crc32((r.text or "").encode())) for r in after["near_dedup"]]
    sizes = collections.Counter()
    for source, _, size, _ in rows:
        sizes[source] += size
    targets, want = plain_targets(dict(sizes)), collections.Counter()
    for source, total in sizes.items():
        whole = int(targets[source] // total) if total else 0
        extra = targets[source] - whole * total if total else 0
        mine = sorted((int(hashlib.md5(f"17:{i}:{crc}".encode()).hexdigest()[:15], 16), i, size) for s, i, size, crc in rows if s == source)
        want.update({i: whole for _, i, _ in mine})
        while extra > 0 and mine and mine[0][2] <= extra:
            _, i, size = mine.pop(0)
            want[i], extra = want[i] + 1, extra - size
        for size, _, i in sorted((size, h, i) for h, i, size in mine if size):
            if extra > 0 and size / 2 < extra:
                want[i], extra = want[i] + 1, extra - size
    assert collections.Counter(ids("mixing")) == +want

    # Every copy's ids lie in pieces, each once: starts and lengths tile as many documents as there are copies.
    covered = collections.Counter()
    for r in after["packing"]:
        covered.update((r.doc_id, at) for at in range(r.start, r.start + r.length))
    tokens = {r.doc_id: r.doc_tokens for r in after["packing"]}
    assert covered == collections.Counter({(i, at): n for i, n in (+want).items() for at in range(tokens[i])})
    by_sequence = collections.defaultdict(list)
    for r in after["packing"]:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_two_results_can_be_held(spark):
    first = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    n = first.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == n == first.count()
