"""What a write and an ingestion leave on disk, and rewriting a table's buckets in rounds."""

import glob
import time

from pyspark.sql import functions as F

from sediment import io
from sediment.corpus import POSTINGS, Corpus
from sediment.store import Store

NEW = "id long, url string, owner string, kind string, title string, raw_text string"


def shuffle_blocks(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for i in range(blocks.size()) if (b := blocks.apply(i).name()).startswith("shuffle")}


def left_of(spark, before):
    """Shuffle blocks that have come and stay."""
    for _ in range(20):
        if not (more := shuffle_blocks(spark) - before):
            break
        time.sleep(0.5)
    return more


def test_a_written_table_leaves_no_shuffle_files(spark):
    kept = spark.conf.get(io.CLEANUP)
    before = shuffle_blocks(spark)
    dealt = spark.range(10_000).repartition(4, "id")  # held, so that no garbage collector frees its files
    out = io.written(dealt.groupBy((F.col("id") % 7).alias("k")).count().join(dealt.withColumnRenamed("id", "k"), "k"), "joined")
    assert not left_of(spark, before)
    assert out.count() == 7 and spark.conf.get(io.CLEANUP) == kept
    io.discard(out)
    assert not glob.glob(f"{io._written_at[out].removeprefix('file://')}*")


def corpus_rows(spark, n, last="one"):
    rows = [(i, f"https://a.org/{i}", "public", "blog", f"T{i}", f"Words number{i} of source{i % 7} are here. " * 9 + (last if i % 3 == 0 else "same")) for i in range(n)]
    return spark.createDataFrame(rows, NEW)


def test_an_ingestion_keeps_nothing_but_what_it_commits(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/store", buckets=8)
    root = io.scratch(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    before = set(glob.glob(f"{root}/*"))
    corpus.ingest(corpus_rows(spark, 60), flag=False)
    report = {r.outcome: r.n for r in corpus.ingest(corpus_rows(spark, 60, "two"), flag=False).collect()}
    assert report == {"ingested": 60, "passages written": 20}
    names = {p.split("/")[-1].rsplit("-", 1)[0] for p in set(glob.glob(f"{root}/*")) - before}
    assert not names & {"judged", "passages", "merged", "after", "prints"}


def test_a_segment_stays_where_it_was_made(spark, tmp_path):
    """Postings go to as many files as passages came in, each sorted; none is dealt by its term."""
    store = Store(spark, f"file://{tmp_path}/s")
    change = store.begin()
    rows = spark.range(0, 4000, 1, 3).select(F.concat(F.lit("t"), F.col("id") % 11).alias("term"), F.col("id").alias("chunk_id"))
    assert change.append("log", rows, ["term", "chunk_id"]) == 4000
    change.commit()
    files = glob.glob(f"{tmp_path}/s/log/*/*.parquet")
    held = [[(r.term, r.chunk_id) for r in spark.read.parquet(f"file://{f}").coalesce(1).collect()] for f in files]
    assert all(rows == sorted(rows) for rows in held)
    assert sorted((min(c for _, c in rows), len(rows)) for rows in held) == [(0, 1333), (1333, 1333), (2666, 1334)]


def test_rounds_give_what_one_write_gives(spark, tmp_path, monkeypatch):
    from sediment import corpus as module

    held = []
    for rounds in (1, 5):
        monkeypatch.setattr(module, "ROUNDS", rounds)
        monkeypatch.setattr(module, "ROUND_BYTES", 1)
        corpus = Corpus(spark, f"file://{tmp_path}/store{rounds}", buckets=8)
        corpus.ingest(corpus_rows(spark, 30))
        corpus.ingest(corpus_rows(spark, 40, "two"))
        folders = corpus.store.state["tables"]["chunks"]["folders"]
        assert len({f.split("/")[1] for f in folders.values()}) == min(rounds, len(folders))
        sources = corpus.sources.select("id", "url", "raw_text", "duplicate_of", "chunk_count", "shingle_count", F.array_sort("shingle_sketch"))
        posts = corpus.store.live("postings", POSTINGS, "chunk_id").drop("seg")
        held.append([sorted(map(repr, df.collect())) for df in (sources, corpus.passages(), posts)])
    assert held[0] == held[1] and len(held[0][0]) == 40
