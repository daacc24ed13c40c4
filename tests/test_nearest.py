"""Nearest vectors by blocks against the full scan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sediment.operators import retrieval
from sediment.operators.nearest import VectorBlocks

CHUNKS = "chunk_id long, source_id long, owner string, duplicate_of long, embedding array<float>"


def scanned(chunks, vector, k, user=None):
    return [tuple(r) for r in retrieval.top(retrieval.semantic(retrieval.visible(chunks, user), vector), "similarity", k).collect()]


def clustered(rng, n, middles):
    out = []
    for i in range(n):
        middle = middles[i % len(middles)]
        owner = rng.choice(["public", "public", "ann", "bob"])
        out.append((i, i % 40, owner, 3 if i % 29 == 4 else None, [m + rng.gauss(0, 0.08) for m in middle]))
    return out


@pytest.fixture(scope="module")
def built(spark):
    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(16)]
    rows = clustered(rng, 3000, middles)
    rows += [(5000 + i, 1, "public", None, list(middles[0])) for i in range(40)]  # ties
    rows += [(6000 + i, 2, "public", None, v) for i, v in enumerate(
        [[0.0] * 12, [1.0] * 5, [math.nan] * 12, [math.inf] + [0.0] * 11, [None] + [1.0] * 11, [], [1e-44] * 12])]
    rows += [(7000, 3, "public", None, None)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    return chunks, middles, VectorBlocks.build(chunks)


@pytest.mark.parametrize("k", [1, 10, 60])
def test_same_rows_as_the_scan_and_less_than_half_is_read(built, k):
    chunks, middles, blocks = built
    rng = random.Random(k)
    for user, middle in ((None, middles[0]), ("ann", middles[3]), ("bob", middles[9])):
        asked = [m + rng.gauss(0, 0.05) for m in middle]
        hits, report = blocks.nearest(asked, k, user)
        got = [tuple(r) for r in hits.collect()]
        # NaN is the largest value for both; repr makes it comparable.
        assert repr(got) == repr(scanned(chunks, asked, k, user))
        assert report["blocks_read"] < report["blocks"] / 2 and report["rows_read"] < report["rows"] / 2 and report["rows"] == 3047


def test_far_and_odd_questions(built):
    chunks, middles, blocks = built
    everything = [[-m for m in middles[0]], [0.0] * 12, [1.0] * 5, [math.nan] * 12]
    for asked in everything:
        hits, _ = blocks.nearest(asked, 9)
        assert repr([tuple(r) for r in hits.collect()]) == repr(scanned(chunks, asked, 9))
    hits, report = blocks.nearest(middles[1], 100_000)
    assert report["blocks_read"] == report["blocks"] and hits.count() == len(scanned(chunks, middles[1], 100_000))


def test_a_filter_that_leaves_few_rows_reads_on(built):
    chunks, middles, blocks = built
    keep = lambda df: df.where("source_id = 1 and chunk_id < 5000")
    hits, report = blocks.nearest(middles[2], 20, keep=keep)
    want = retrieval.top(retrieval.semantic(keep(chunks), middles[2]), "similarity", 20)
    assert [tuple(r) for r in hits.collect()] == [tuple(r) for r in want.collect()] and report["rows_read"] > 0


def test_empty_one_and_equal_vectors(spark):
    none = spark.createDataFrame([], CHUNKS)
    hits, report = VectorBlocks.build(none).nearest([1.0, 2.0], 3)
    assert hits.count() == 0 and report["rows"] == 0
    for n in (1, 300):
        same = spark.createDataFrame([(i, i, "public", None, [0.5, 0.5]) for i in range(n)], CHUNKS)
        hits, _ = VectorBlocks.build(same).nearest([1.0, 2.0], 3)
        assert [r.chunk_id for r in hits.collect()] == list(range(min(n, 3)))


def test_it_is_read_again_from_its_folder(built, spark):
    chunks, middles, blocks = built
    again = VectorBlocks(spark, blocks.path)
    assert repr(again.nearest(middles[4], 5)[0].collect()) == repr(blocks.nearest(middles[4], 5)[0].collect())


def test_a_search_through_blocks_is_the_search(built, spark):
    chunks, middles, blocks = built
    told = chunks.withColumn("content", F.concat(F.lit("word w"), F.col("chunk_id").cast("string")))
    near = lambda vector, k: blocks.nearest(vector, k, "ann")[0]
    plain = retrieval.search(told, "w17 w40", middles[5], 6, user="ann")
    pruned = retrieval.search(told, "w17 w40", middles[5], 6, user="ann", near=near)
    order = lambda df: repr(df.orderBy("marker").collect())
    assert order(plain) == order(pruned.select(*plain.columns)) and plain.count() == 6
