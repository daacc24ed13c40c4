from pyspark.sql import functions as F

from sediment.api import Engine
from sediment.operators import chunker, merge
from sediment.streaming import ingest

SOURCES = "id long, owner string, url string, title string, raw_text string, raw_segments array<struct<text:string,start:double,duration:double>>, duplicate_of long"
CHUNKS = "source_id long, chunk_index int, content string, content_hash string, token_count int, start_ts decimal(10,3), end_ts decimal(10,3), embedding array<float>, embedding_model string"


def corpus(spark, rows):
    src = spark.createDataFrame([(i, "public", f"u{i}", f"T{i}", t, None, None) for i, t in rows], SOURCES)
    return src, spark.createDataFrame([], CHUNKS)


def test_ingest_search_and_ask(spark):
    src, none = corpus(spark, [(1, "Sparse hashing filters are compact. They miss nothing."), (2, "Dense tables are simple.")])
    engine = Engine(spark, src.where("false"), none)
    report = lambda df: {r.outcome: r.n for r in df.collect()}
    assert report(engine.ingest(src, dry_run=True)) == {"ingested": 2, "passages written": 2} and engine.chunks.count() == 0
    assert report(engine.ingest(src)) == {"ingested": 2, "passages written": 2}
    assert report(engine.ingest(src)) == {"ingested": 2}
    assert engine.sources.count() == 2 and engine.chunks.count() == 2
    held = engine.chunks.join(src.select(F.col("id").alias("source_id"), "title", "url", "owner", "duplicate_of"), "source_id").withColumn("chunk_id", F.col("source_id"))
    filler = spark.createDataFrame([(100 + i, f"filler{i}") for i in range(30)], "chunk_id long, content string")
    held = held.unionByName(filler.select("chunk_id", F.col("chunk_id").alias("source_id"), "content", F.lit("public").alias("owner"), F.lit("F").alias("title"), F.lit("f").alias("url")), allowMissingColumns=True)
    seen = Engine(spark, src, held, embed=lambda q: None)
    answer = seen.ask("sparse hashing filters")
    assert not answer["abstained"] and answer["citations"] == [{"marker": 1, "title": "T1", "url": "u1", "timestamp": "-", "transcript_kind": None}] and answer["answer"].startswith("Sparse hashing")
    assert answer["cost_usd"] is None and answer["elapsed_ms"] >= 0 and answer["explain"]["passages_used"] == 1
    assert Engine(spark, src, held, price=(1e6, 0.0)).ask("sparse hashing filters")["cost_usd"] == answer["tokens_in"]
    assert seen.live() == {"status": "ok"} and seen.ready()["status"] == "ok" and Engine(spark, src, None).ready()["status"] == "unavailable"
    assert seen.ask("quantum gravity")["abstained"] and seen.search("dense tables").first().title == "T2"
    assert Engine(spark, src, held, embed=lambda q: 1 / 0).vector("x") is None
    assert engine.stats().first().asDict() | {"tokens": 0} == {"sources": 2, "chunks": 2, "pending": 2, "tokens": 0}


def test_duplicates_of_an_engine(spark):
    text = " ".join(f"word{i}" for i in range(200))
    src, none = corpus(spark, [(1, text), (2, text.upper()), (3, text + " more"), (4, "other")])
    assert {(r.id, r.duplicate_of) for r in Engine(spark, src, none).find_duplicates().collect()} == {(2, 1), (3, 1)}


def test_duplicates_are_sought_among_what_the_owner_sees(spark):
    text = " ".join(f"word{i}" for i in range(200))
    owners = ["ann", "public", "bob", "ann", "public", "bob", None]
    src = spark.createDataFrame([(i, o, f"u{i}", f"T{i}", text, None, None) for i, o in enumerate(owners, 1)], SOURCES)
    found = {(r.id, r.duplicate_of) for r in Engine(spark, src, src).find_duplicates().collect()}
    # 2 is public and sees no private source; 4 sees 1, its owner's, and 2: the smaller of equals.
    assert found == {(3, 2), (4, 1), (5, 2), (6, 2), (7, 2)}
    private = src.where("id in (1, 3)")
    assert Engine(spark, private, private).find_duplicates().count() == 0
    assert {(r.id, r.duplicate_of) for r in Engine(spark, src.drop("owner"), src).find_duplicates().collect()} == {(i, 1) for i in range(2, 8)}


def test_a_stream_of_sources(spark, tmp_path):
    src, none = corpus(spark, [(1, "First text."), (2, "Second text.")])
    src.write.parquet(str(tmp_path / "in"))
    state = {"now": none, "n": 0}

    def write(df, number):
        df.write.mode("overwrite").parquet(str(tmp_path / f"v{number}"))
        state.update(now=spark.read.parquet(str(tmp_path / f"v{number}")), n=number)

    for _ in range(2):
        ingest.ingest_stream(spark, str(tmp_path / "in"), SOURCES, lambda: state["now"], write, str(tmp_path / "cp")).awaitTermination()
    assert state["now"].count() == 2 and state["n"] == 0
    fresh = chunker.chunk_sources(src).drop("cues", "tokenizer")
    assert merge.counts(merge.merge_chunks(state["now"], fresh)).first() == (0, 0)


def test_ingest_rejects_flags_and_replaces(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, "https://a.org/1", "blog", text, None), (2, "https://a.org/2", "blog", text + " more", None), (3, "https://gdcvault.com/x", "blog", text, None),
            (4, "https://a.org/4", "blog", "Just a moment... checking", None), (5, "https://a.org/5", "blog", None, "timeout"), (6, "https://youtube.com/watch?v=x", "talk", text, None), (7, "https://a.org/7", "blog", "  ", None)]
    new = spark.createDataFrame([(i, "public", u, k, f"T{i}", t, None, e, None) for i, u, k, t, e in rows], "id long, owner string, url string, kind string, title string, raw_text string, raw_segments array<struct<text:string,start:double,duration:double>>, error string, duplicate_of long")
    engine = Engine(spark, new.where("false"), spark.createDataFrame([], CHUNKS))
    report = {r.outcome: r.n for r in engine.ingest(new).collect()}
    assert report == {"ingested": 2, "denied": 1, "bot wall": 1, "failed": 1, "talk without cues": 1, "no content": 1, "passages written": report["passages written"], "duplicates flagged": 1}
    assert {(r.id, r.duplicate_of) for r in engine.sources.collect()} == {(1, None), (2, 1)}
    left = engine.backfill(lambda texts: [[1.0] for _ in texts], "m", spent_usd=2.0, budget_usd=1.0).first()[0]
    assert left == engine.chunks.count() and engine.backfill(lambda texts: [[1.0] for _ in texts], "m").first()[0] == 0


def test_command_line_ingests_into_a_store(spark, tmp_path, capsys):
    import json

    from sediment.__main__ import main
    from sediment.corpus import Corpus

    (tmp_path / "m.json").write_text(json.dumps([{"url": f"https://a.org/{i}", "title": t} for i, t in ((1, "One"), (2, "Two"), (3, "Three"))]))
    pages = [("https://a.org/1", 200, "Some words here. " * 600, None), ("https://a.org/3", 404, "gone", None)]
    spark.createDataFrame(pages, "url string, http_status int, text string, error string").write.parquet(f"file://{tmp_path}/pages")
    args = [str(tmp_path / "m.json"), "--fetched", f"file://{tmp_path}/pages"]
    store = f"file://{tmp_path}/store"
    assert main(["ingest", *args, "--store", store, "--dry-run", "--first", "1"]) == 0 and not (tmp_path / "store").exists()
    assert "failed" not in capsys.readouterr().out
    assert main(["ingest", *args, "--store", store, "--source", "https://a.org/2"]) == 0 and Corpus(spark, store).sources.count() == 0
    assert main(["ingest", *args, "--store", store]) == 0
    held = Corpus(spark, store)
    assert [r.url for r in held.sources.collect()] == ["https://a.org/1"] and held.chunks.count() == held.total().first()[0] > 0
    assert main(["stats", "--store", store]) == 0
    assert main(["verify", *args]) == 1 and "not fetched" in capsys.readouterr().out


def test_versions_of_a_table(spark, tmp_path):
    from sediment.io import Versions

    table = Versions(spark, f"file://{tmp_path}/t")
    for n in (3, 5):
        table.swap(spark.range(n))
    assert table.numbers() == [1, 2] and table.read(1).count() == 3 and table.read().count() == 5
    table.prune()
    assert table.numbers() == [2]
