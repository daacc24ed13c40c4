"""Passages of prose and postings are made row by row: no shuffle, and the same as by groups."""

import collections
import re

from pyspark.sql import functions as F

from sediment.functions import text as X
from sediment.operators import chunker, dedupe, retrieval
from sediment.sources import index

CHUNKS = "chunk_id long, source_id string, content string, owner string, duplicate_of long, embedding array<float>"


def test_prose_needs_no_shuffle_and_equals_groups(spark):
    texts = [None, "", " \n ", "one", *[". ".join(f"Word{i} is number {j}" for j in range(i * 37)) + "\n[Music] a line" for i in range(1, 30)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, raw_text string")
    made = chunker.chunk_prose(rows)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, chunker.chunk_cues(chunker.prose_cues(rows), timed=False).collect()))
    small = chunker.chunk_prose(rows, target=20, overlap=0)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, chunker.chunk_cues(chunker.prose_cues(rows), timed=False, target=20, overlap=0).collect()))


def test_postings_need_no_shuffle_and_equal_counts(spark):
    texts = [None, "", "é ! ?", "a", "b a B c++ A b", "x " * 1000, *[" ".join(f"w{j % i}" for j in range(50)) for i in range(1, 20)]]
    chunks = spark.createDataFrame([(i, "s", x, "public", None, None) for i, x in enumerate(texts)], CHUNKS)
    posts = retrieval.postings(chunks)
    assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()
    want = collections.Counter((i, w.lower()) for i, x in enumerate(texts) for w in re.findall("[A-Za-z0-9_+#-]+", x or ""))
    assert {(r.chunk_id, r.term): r.tf for r in posts.collect()} == want
    some = retrieval.postings(chunks, ["a", "w1", "none"])
    assert {(r.chunk_id, r.term): r.tf for r in some.collect()} == {k: n for k, n in want.items() if k[1] in ("a", "w1")}
    assert retrieval.postings(chunks, []).count() == 0
    made = index.build(chunks)
    assert "postings" not in vars(made) and made.chunks.count() == len(texts) and "postings" not in vars(made)  # written when asked for
    assert {(r.chunk_id, r.term): r.tf for r in made.postings.collect()} == want


def test_sketches_equal_those_of_expressions(spark):
    texts = [None, "", "é", "one", "One two, THREE", " ".join(f"w{i % 40}" for i in range(300)), " ".join(f"w{i}" for i in range(900)), "a b c d e f g h", "a b c d e f g h i"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, raw_text string")
    words = rows.select("id", F.split(X.normalise(F.coalesce("raw_text", F.lit(""))), " ").alias("w"))
    hashed = words.select("id", X.shingles(F.col("w")).alias("h"))
    want = {r.id: (r.s, r.n) for r in hashed.select("id", X.bottom_k(F.col("h")).alias("s"), F.size("h").alias("n")).collect()}
    assert {r.id: (r.sketch, r.n) for r in dedupe.sketches(rows).collect()} == want


def test_a_segment_is_computed_once(spark, tmp_path):
    from sediment.store import Store

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    change = Store(spark, f"file://{tmp_path}/s").begin()
    assert change.append("log", spark.range(0, 1000, 1, 4).selectExpr("id % 7 AS h", "id").mapInArrow(counted, "h long, id long"), ["h", "id"]) == 1000
    assert seen.value == 1000
