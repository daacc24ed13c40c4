"""The stored corpus: commits, buckets, the postings log, fingerprints and flags."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from sediment.api import Engine
from sediment.corpus import POSTINGS, Corpus
from sediment.operators import dedupe, retrieval
from sediment.store import Conflict, Store

NEW = "url string, owner string, kind string, title string, raw_text string, raw_segments array<struct<text:string,start:double,duration:double>>, error string"


def sources(spark, *rows):
    full = [(f"https://a.org/{n}", owner, "blog", f"T{n}", text, None, None) for n, owner, text in rows]
    return spark.createDataFrame(full, NEW)


def told(df):
    return {r.outcome: r.n for r in df.collect()}


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "."


def flags(corpus):
    titles = {r.id: r.title for r in corpus.sources.collect()}
    return {r.title: titles.get(r.duplicate_of) for r in corpus.sources.collect()}


def test_ingest_search_ask_ingest_again(spark, tmp_path):
    engine = Engine.stored(spark, f"file://{tmp_path}/store")
    assert engine.stats().first()["sources"] == 0
    filler = [(100 + i, "public", prose(i)) for i in range(30)]
    rows = [(1, "public", "Sparse hashing filters are compact. They miss nothing."), (2, "ann", "Dense hashing tables are simple."), *filler]
    assert told(engine.ingest(sources(spark, *rows), dry_run=True)) == {"ingested": 32, "passages written": 32} and engine.sources.count() == 0
    assert told(engine.ingest(sources(spark, *rows))) == {"ingested": 32, "passages written": 32}
    answer = engine.ask("sparse hashing filters", explain=True)
    assert answer["answer"].startswith("Sparse hashing") and answer["trace"] and answer["citations"][0]["url"] == "https://a.org/1"
    assert answer["passages"][0]["score"] == round(0.1 * 3 * 3, 4) and answer["passages"][0]["transcript_kind"] is None 
    assert [h.title for h in engine.search("dense hashing tables").collect()] == ["T1"]
    assert {h.title for h in engine.search("dense hashing tables", user="ann").collect()} == {"T1", "T2"}
    # The first source changes: its old words are gone, its new ones are found.
    assert told(engine.ingest(sources(spark, (1, "public", "Perfect trees are balanced.")))) == {"ingested": 1, "passages written": 1}
    assert engine.ask("sparse hashing filters")["abstained"]
    held = Engine.stored(spark, f"file://{tmp_path}/store")
    assert held.search("perfect trees").first().title == "T1" and held.sources.count() == 32 and held.chunks.count() == 32


def test_an_ingest_writes_what_changed(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/store", buckets=16)
    corpus.ingest(sources(spark, *[(i, "public", prose(i)) for i in range(60)]))
    before = corpus.store.state
    corpus.ingest(sources(spark, (3, "public", prose(3)), (60, "public", "Only five words are here.")))
    after = corpus.store.state
    assert told(corpus.ingest(sources(spark, (3, "public", prose(3))))) == {"ingested": 1}
    moved = {t: [b for b, f in after["tables"][t]["folders"].items() if before["tables"][t]["folders"].get(b) != f] for t in ("sources", "chunks")}
    assert len(moved["chunks"]) <= 2 and len(moved["sources"]) <= 2
    last = after["tables"]["postings"]["segments"][-1]
    assert last["rows"] == 5 and after["tables"]["shingles"]["segments"][-1]["rows"] == 1


def test_two_talks_stay_apart_and_copies_are_found(spark, tmp_path):
    def talk(n, seed):
        rng = random.Random(seed)
        cues = [(" ".join(f"t{rng.randrange(10**6)}" for _ in range(8)) + ".", 3.0 * i, 2.5) for i in range(40)]
        return (f"https://youtube.com/watch?v=v{n}", "public", "talk", f"T{n}", None, cues, None)

    corpus = Corpus(spark, f"file://{tmp_path}/store")
    corpus.ingest(spark.createDataFrame([talk(1, "a"), talk(2, "b"), talk(3, "a")], NEW))
    found = flags(corpus)
    assert found["T2"] is None and sorted([found["T1"], found["T3"]], key=str) in ([None, "T1"], [None, "T3"]) or found == {"T1": "T3", "T2": None, "T3": None}
    # The same over an engine without a store.
    segs = "id long, owner string, url string, title string, raw_text string, raw_segments array<struct<text:string,start:double,duration:double>>, duplicate_of long"
    src = spark.createDataFrame([(n, "public", f"u{n}", f"T{n}", None, talk(n, s)[5], None) for n, s in ((1, "a"), (2, "b"), (3, "a"), (4, "c"))], segs)
    chunks = "source_id long, chunk_index int, content string, content_hash string, token_count int, start_ts decimal(10,3), end_ts decimal(10,3), embedding array<float>, embedding_model string"
    engine = Engine(spark, src.where("false"), spark.createDataFrame([], chunks))
    engine.ingest(src)
    assert {(r.id, r.duplicate_of) for r in engine.sources.collect()} == {(1, None), (2, None), (3, 1), (4, None)}


def test_flags_follow_the_texts(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/store")
    one = prose("one")
    corpus.ingest(sources(spark, (1, "public", one)))
    report = told(corpus.ingest(sources(spark, (2, "public", one + " more."), (3, "ann", one.upper()), (4, "public", prose("four")), (5, "public", "..."))))
    assert report["duplicates flagged"] == 2 and flags(corpus) == {"T1": None, "T2": "T1", "T3": "T1", "T4": None, "T5": None}
    asked = one.split()[5]
    assert corpus.postings.where(F.col("term") == asked).count() == 3 and retrieval.visible(corpus.postings, "ann").where(F.col("term") == asked).count() == 1
    # 2 gets a text of its own and loses its flag; nothing else changes.
    corpus.ingest(sources(spark, (2, "public", prose("two"))))
    assert flags(corpus) == {"T1": None, "T2": None, "T3": "T1", "T4": None, "T5": None}
    # 1 changes: 3 was its copy, is looked at again and stands for itself.
    corpus.ingest(sources(spark, (1, "public", prose("other"))))
    assert flags(corpus) == {"T1": None, "T2": None, "T3": None, "T4": None, "T5": None}


def test_logs_are_joined_by_levels_and_stay_right(spark, tmp_path):
    corpus, rng = Corpus(spark, f"file://{tmp_path}/store", buckets=4), random.Random(4)
    now, rows = {}, []
    for step in range(5):
        batch = {n: f"Step{step} word{rng.randrange(9)} word{rng.randrange(9)} source{n}." for n in rng.sample(range(8), 3)}
        now |= batch
        corpus.ingest(sources(spark, *[(n, "public", t) for n, t in batch.items()]), flag=False)
        rows.append(len(corpus.store.segments("postings")))
    want = sorted((w, t.lower().split().count(w)) for t in now.values() for w in set(t.lower().replace(".", "").split()) for t in [t.replace(".", "")])
    got = sorted((r.term, r.tf) for r in corpus.postings.collect())
    assert got == want and rows == [1, 2, 3, 1, 2]
    levels = [s["level"] for s in corpus.store.segments("postings")]
    assert levels == sorted(levels, reverse=True) and levels == [1, 0]
    before = corpus.postings.count()
    assert corpus.store.vacuum() > 0 and corpus.postings.count() == before == len(want) and len(corpus.store.numbers()) == 1
    assert corpus.chunks.count() == len(now)


def test_a_writer_that_dies_leaves_all_tables_as_they_were(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, f"file://{tmp_path}/store")
    corpus.ingest(sources(spark, (1, "public", "Old words stay.")))
    whole = Store.publish
    monkeypatch.setattr(Store, "publish", lambda self, state: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        corpus.ingest(sources(spark, (1, "public", "New words come."), (2, "public", "And more.")))
    monkeypatch.setattr(Store, "publish", whole)
    again = Corpus(spark, f"file://{tmp_path}/store")
    assert again.sources.count() == again.chunks.count() == 1 and again.chunks.first().content == "Old words stay."
    assert {r.term for r in again.postings.collect()} == {"old", "words", "stay"}
    # A commit that was cut off within is passed over.
    (tmp_path / "store/_commits/000000000009.json").write_text('{"number": 9, "tab')
    (tmp_path / "store/_commits/.000000000009.json.crc").unlink(missing_ok=True)
    again = Corpus(spark, f"file://{tmp_path}/store")
    again.ingest(sources(spark, (1, "public", "New words come.")))
    assert again.store.state["number"] >= 10 and again.chunks.first().content == "New words come." and again.store.vacuum() > 0
    assert not glob.glob(f"{tmp_path}/store/chunks/w-*/__b=*/*") == []


def test_of_two_writers_the_second_is_told(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=2)
    one, two = store.begin(), Store(spark, f"file://{tmp_path}/store", buckets=2).begin()
    one.append("log", spark.range(3), ["id"])
    one.commit()
    two.append("log", spark.range(5), ["id"])
    with pytest.raises(Conflict):
        two.commit()
    assert store.refresh().rows("log").count() == 3


def test_tombstones_end_only_earlier_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for ended in ([], [1], [1, 2]):
        change = store.begin()
        change.end("log", spark.createDataFrame([(i,) for i in ended], "id long"))
        change.append("log", spark.createDataFrame([(1, f"v{len(ended)}"), (3, "x")] if len(ended) < 2 else [(2, "w")], "id long, v string"), ["id"])
        change.commit()
    live = lambda: sorted((r.id, r.v) for r in store.live("log", "id long, v string", "id").collect())
    assert live() == [(2, "w"), (3, "x"), (3, "x")]
    change = store.begin()
    assert change.compacted("log", "id long, v string", "id", ["id"], fanout=3) == [3]
    change.commit()
    assert live() == [(2, "w"), (3, "x"), (3, "x")] and store.segments("log_ends") == []


def test_flags_equal_one_after_the_other(spark, tmp_path):
    """Batches in order of identifier flag as one source after the other would."""
    rng = random.Random(11)
    bases = [[f"b{k}x{i}" for i in range(60)] for k in range(4)]
    texts = {}
    for n in range(1, 25):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(60)] = f"n{n}y{rng.randrange(99)}"
        texts[n] = " ".join(words[: rng.choice([60, 60, 25])])
    owners = {n: rng.choice(["public", "public", "ann", "bob"]) for n in texts}
    kinds = "id long, " + NEW
    frame = lambda ns: spark.createDataFrame([(n, f"https://a.org/{n}", owners[n], "blog", f"T{n}", texts[n], None, None) for n in ns], kinds)
    corpus = Corpus(spark, f"file://{tmp_path}/store")
    for ns in (range(1, 10), range(10, 18), range(18, 25)):
        corpus.ingest(frame(ns))
    whole = corpus.sources
    sketched = whole.select("id", "owner", F.col("shingle_sketch").alias("sketch"), F.col("shingle_count").alias("n"))
    pairs = dedupe.scored_pairs(sketched).collect()
    want = {}
    for n in sorted(texts):
        best = [(-p.score, p.a) for p in pairs if p.b == n and want.get(p.a) is None]
        want[n] = min(best)[1] if best else None
    assert {r.id: r.duplicate_of for r in whole.collect()} == want and any(want.values())
    assert corpus.store.live("postings", POSTINGS, "chunk_id").select("chunk_id").distinct().count() == corpus.passages().count()
    assert corpus.total("ann").first()[0] == retrieval.visible(corpus.chunks, "ann").count()


def test_a_pass_stops_at_the_budget_and_goes_on(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/store")
    rows = [(i, "public", f"Passage number{i} here.") for i in range(12)]
    corpus.ingest(sources(spark, *rows), flag=False)
    embed = lambda texts: [[1.0, float(len(t))] for t in texts]
    # A passage has three words; batches of about four cost 12 or so each, and two of them pass 13.
    first = corpus.backfill(embed, "m", price=1e6, budget_usd=13.0, batch=4)
    assert first["stopped"] == "budget" and first["batches"] == corpus.calls.where("operation = 'embed'").count() <= 2
    assert first["written"] == corpus.vectors.count() == 12 - first["pending"] and 13 <= corpus.spent_today() == 3 * first["written"]
    assert corpus.backfill(embed, "m", budget_usd=13.0)["batches"] == 0
    with pytest.raises(Exception):  # noqa: B017  the worker's error
        corpus.backfill(lambda texts: [], "m")
    assert corpus.calls.where("error is not null").count() == 1
    assert corpus.backfill(embed, "m")["pending"] == 0 and corpus.vectors.count() == 12
    assert corpus.chunks.where("embedding is not null and embedding_model = 'm'").count() == 12
    # A passage that changes loses its vector, no other does.
    corpus.ingest(sources(spark, (3, "public", "Another text now.")), flag=False)
    assert [r.content for r in corpus.pending.collect()] == ["Another text now."]


def test_migrations_are_applied_once_and_in_order(spark, tmp_path):
    from sediment import schema

    corpus = Corpus(spark, f"file://{tmp_path}/store")
    old = spark.createDataFrame([(1, "u1", "blog")], "id long, url string, kind string")
    change = corpus.store.begin()
    first = schema.migrate(old, "sources", 2)
    change.replace("sources", first, [0], "id")
    change.commit()
    assert corpus.migrate() == [1, 2, 3, 4, 5] and corpus.migrate() == []
    assert corpus.sources.schema.names == schema.schema("sources").names and corpus.sources.first().owner == "public"
    held = [r.version for r in corpus.store.rows("ledger").orderBy("seg").collect()]
    assert held == [1, 2, 3, 4, 5] and corpus.sources.count() == 1
