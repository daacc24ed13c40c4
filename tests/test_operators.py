import datetime

import pytest
from pyspark.sql import functions as F

from sediment.functions import text as X
from sediment.operators import answers, chunker, constraints, dedupe, embedding, merge, retrieval, telemetry
from sediment.sources import manifest, recordings


@pytest.mark.parametrize(
    "matched,similarity,abstains",
    [(3, 0.60, False), (3, None, False), (3, 0.10, False), (0, 0.60, False), (0, 0.38, True), (1, 0.20, True), (0, None, True)],
)
def test_abstention(spark, matched, similarity, abstains):
    hits = spark.createDataFrame([(matched, similarity)], "matched_terms int, similarity double")
    assert retrieval.abstains(hits).first()["abstained"] is abstains
    assert answers.should_abstain(1, matched, similarity) is abstains
    assert retrieval.abstains(hits.where("false")).first()["abstained"] is True


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "a", "A", "https://a.org/", "sparse matrices and hashing hashing", "public", None, [1.0, 0.0]),
        (2, "a", "A", "https://a.org/2", "hashing tables", "public", None, [0.9, 0.1]),
        (3, "a", "A", "https://a.org/3", "hashing filters", "public", None, [0.8, 0.2]),
        (4, "b", "B", "https://b.org/", "sparse hashing by another source", "public", 1, [1.0, 0.0]),
        (5, "c", "C", "https://c.org/", "private sparse notes", "acme", None, None),
        *[(10 + i, f"s{i}", "S", "https://s.org/", f"filler number{i}", "public", None, [0.0, 1.0]) for i in range(60)],
    ]
    return spark.createDataFrame(rows, "chunk_id long, source_id string, title string, url string, content string, owner string, duplicate_of long, embedding array<double>")


def test_search_caps_sources_and_keeps_tenants_apart(chunks):
    hits = retrieval.search(chunks, "sparse hashing filters", None, 8).orderBy("marker").collect()
    assert [h.chunk_id for h in hits] == [1, 3] and {h.source_id for h in hits} == {"a"}
    assert {h.chunk_id for h in retrieval.search(chunks, "sparse hashing", None, 8, user="acme").collect()} == {1, 2, 5}
    assert retrieval.visible_owners("public") == retrieval.visible_owners(None) == ["public"]


def test_fusion_keeps_its_quirks(chunks):
    hits = {h.chunk_id: h for h in retrieval.search(chunks, "private sparse notes", [1.0, 0.0], 8, user="acme").collect()}
    assert hits[5].found_by == "words" and hits[5].similarity is None
    assert hits[2].found_by == "meaning" and hits[2].matched_terms == 0
    assert hits[1].found_by == "both"


def test_terms_in_many_chunks_are_dropped(chunks):
    report = {r.term: r for r in retrieval.analyse_terms(retrieval.visible(chunks), ["filler", "sparse", "absent"]).collect()}
    assert (report["filler"].kept, report["filler"].df) == (False, 60)
    assert (report["sparse"].kept, report["absent"].kept, report["absent"].df) == (True, False, 0)


def test_ask_refuses_without_a_model_call(chunks):
    def never(prompt):
        raise AssertionError("called")

    refused = answers.ask(chunks, "how does quantum gravity work", complete=never)
    assert refused.abstained and refused.hits == [] and "abstain" in refused.trace()
    given = answers.ask(chunks, "sparse hashing filters", complete=lambda p: ("Use filters [2], not [9].", 10, 5))
    assert list(given.cited) == [2] and "1 retrieved excerpts were not cited" in given.render()
    assert given.prompt.startswith("Question: sparse hashing filters\n\nExcerpts:\n\n[1] A (at -)\n")


def test_prompt_in_the_plan_equals_the_drivers(chunks):
    hits = retrieval.search(chunks, "sparse hashing filters", None, 8)
    assert answers.prompt(hits, "sparse hashing filters").first()[0] == answers.ask(chunks, "sparse hashing filters").prompt


def cue_rows(n, step=2.0, late=None):
    return [(1, i, f"one two three four five six{i}.", (late if late and i == n - 1 else i * step), 3.2) for i in range(n)]


CUES = "source_id long, pos int, text string, start double, duration double"


def test_chunks_cover_all_cues_and_never_split_one(spark):
    cues = cue_rows(40)
    got = chunker.chunk_cues(spark.createDataFrame(cues, CUES), target=30, overlap=6).orderBy("chunk_index").collect()
    assert [c.chunk_index for c in got] == list(range(len(got))) and len(got) > 3
    assert all(any(text in c.content for c in got) for _, _, text, _, _ in cues)
    assert all(c.start_ts <= c.end_ts for c in got) and float(got[-1].end_ts) == 78 + 3.2
    assert all(c.token_count == 6 * c.cues for c in got)


def test_a_silence_ends_a_chunk(spark):
    df = spark.createDataFrame(cue_rows(10, late=500.0), CUES)
    assert chunker.chunk_cues(df).count() == 2
    assert chunker.chunk_cues(df, overlap_across_gap=True).count() > 2


def test_prose_has_no_times_and_talks_have(spark):
    seg = "array<struct<text:string,start:double,duration:double>>"
    rows = [(1, "Some prose. More of it.", None), (2, None, [("[Music]", 0.0, 1.0), ("hello there", 1.0, 2.0)]), (3, None, None)]
    got = {c.source_id: c for c in chunker.chunk_sources(spark.createDataFrame(rows, f"id long, raw_text string, raw_segments {seg}")).collect()}
    assert set(got) == {1, 2} and got[1].start_ts is None and got[2].content == "hello there" and float(got[2].start_ts) == 1.0


def test_replacing_chunks_removes_the_tail_and_keeps_the_rest(spark):
    schema = "source_id long, chunk_index int, content string, content_hash string, embedding array<float>, embedding_model string"
    old = spark.createDataFrame([(1, i, f"b{i}", f"h{i}", [1.0], "m") for i in range(4)] + [(2, 0, "x", "hx", None, None)], schema)
    new = spark.createDataFrame([(1, 0, "b0", "h0"), (1, 1, "new", "other")], "source_id long, chunk_index int, content string, content_hash string")
    merged = merge.merge_chunks(old, new)
    assert merge.counts(merged).first() == (1, 2)
    after = {(r.source_id, r.chunk_index): r for r in merge.replaced(old, merged).collect()}
    assert set(after) == {(1, 0), (1, 1), (2, 0)}
    assert after[1, 0].embedding_model == "m" and after[1, 1].embedding is None and after[1, 1].content == "new"


def test_upsert_leaves_sticky_columns(spark):
    old = spark.createDataFrame([(7, "public", "u", "old", 3)], "id long, owner string, url string, title string, duplicate_of long")
    new = spark.createDataFrame([("public", "u", "new"), ("public", "v", "fresh")], "owner string, url string, title string")
    got = {r.url: r for r in merge.upsert_sources(old, new).collect()}
    assert (got["u"].id, got["u"].title, got["u"].duplicate_of, got["u"].action) == (7, "new", 3, "update")
    assert got["v"].id is not None and got["v"].action == "insert"


def test_deleting_a_source_takes_its_chunks_and_frees_its_copies(spark):
    src = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, duplicate_of long")
    chk = spark.createDataFrame([(10, 1), (20, 2)], "chunk_id long, source_id long")
    left, held = merge.delete_sources(src, chk, src.where("id = 1").select("id"))
    assert sorted(map(tuple, left.collect())) == [(2, None), (3, 2)] and [r.chunk_id for r in held.collect()] == [20]
    flagged = merge.mark_duplicates(src, spark.createDataFrame([(3, 1)], "id long, duplicate_of long"))
    assert sorted(map(tuple, flagged.collect())) == [(1, None), (2, None), (3, 1)]


ARTICLE = " ".join(f"word{i} thing{i * 7 % 31} detail{i}" for i in range(120))


def test_reformatting_hardly_changes_a_fingerprint(spark):
    rows = [(1, ARTICLE), (2, ARTICLE.upper().replace(" ", "\n  ")), (3, ARTICLE + " " + ARTICLE.replace("word", "other") * 3), (4, " ".join(f"unrelated{i}" for i in range(300)))]
    s = dedupe.sketches(spark.createDataFrame(rows, "id long, raw_text string"))
    assert all(len(r.sketch) <= 128 for r in s.collect())
    pairs = {(r.a, r.b): r for r in dedupe.scored_pairs(s, 0.6).collect()}
    assert pairs[1, 2].jaccard == 1.0 and (1, 3) in pairs and not any(4 in p for p in pairs)


def test_degenerate_texts_are_one_shingle(spark):
    s = dedupe.sketches(spark.createDataFrame([(1, ""), (2, "   "), (3, "short"), (4, None)], "id long, raw_text string"))
    assert [r.n for r in s.collect()] == [1, 1, 1, 1]
    none = spark.range(1).select(X.sketch_jaccard(F.array().cast("array<long>"), F.array(F.lit(1).cast("long"))).alias("j"), X.containment(F.lit(0.5), F.lit(0), F.lit(3)).alias("c"))
    assert none.first() == (0.0, 0.0)


def test_a_flagged_source_is_nobodys_original(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, 0.9), (2, 3, 0.8, 0.8), (3, 4, 0.7, 0.7), (1, 4, 0.6, 0.6)], "a long, b long, jaccard double, score double")
    assert sorted(map(tuple, dedupe.resolve(pairs).collect())) == [(2, 1, 0.9), (4, 3, 0.7)]
    assert sorted(map(tuple, dedupe.best_earlier(pairs).collect())) == [(2, 1, 0.9), (3, 2, 0.8), (4, 3, 0.7)]


def test_telemetry(spark, tmp_path):
    now = datetime.datetime(2024, 5, 2, 12)
    rows = [(now, "a", "ask", 1_000_000, 1_000_000, 100.0), (now, "x", "ask", 5, 5, 300.0), (now - datetime.timedelta(hours=20), "a", "embed", 1_000_000, 0, 900.0)]
    calls = spark.createDataFrame(rows, "created_at timestamp, model string, operation string, tokens_in long, tokens_out long, latency_ms double")
    prices = spark.createDataFrame([("a", 5.0, 25.0)], "model string, price_in double, price_out double")
    cost = telemetry.with_cost(calls, prices)
    assert sorted((r.cost_usd or -1) for r in cost.collect()) == [-1, 5.0, 30.0]
    assert telemetry.spend_today(cost, F.lit(now)).first()[0] == 30.0
    assert telemetry.latency(calls, F.lit(now), "ask").first() == (200.0, 290.0)
    assert telemetry.latency(calls, F.lit(now), "none").first() == (0.0, 0.0)
    telemetry.record(calls, str(tmp_path / "calls"))
    assert spark.read.parquet(str(tmp_path / "calls")).count() == 3
    telemetry.record(calls, "nowhere://x")  # a failure is logged, not raised


def test_embedding_backfill(spark):
    c = spark.createDataFrame([(i, f"t{i}", None if i % 2 else [1.0], None if i % 2 else "m") for i in range(10)], "chunk_id long, content string, embedding array<float>, embedding_model string")
    made = embedding.backfill(c, lambda texts: [[float(len(t))] for t in texts], "new", batch=2)
    after = merge.write_embeddings(c, made)
    assert embedding.pending(after).count() == 0 and after.where("embedding_model = 'new'").count() == 5
    assert embedding.backfill(c, lambda t: [[0.0]] * len(t), "new", batch=2, max_batches=1).count() == 2


def test_constraints(spark):
    src = spark.createDataFrame([(1, "p", "u", "talk", 1, None), (2, "p", "u", "page", None, None)], "id long, owner string, url string, kind string, duplicate_of long, raw_segments array<string>")
    assert sorted(r.rule for r in constraints.source_violations(src).collect()) == ["kind", "self_duplicate", "talk_needs_segments", "unique_owner_url"]
    chk = spark.createDataFrame([(1, -1, 2.0, 1.0, [1.0], None), (2, 0, None, None, None, None), (2, 0, 1.0, 2.0, None, None)], "source_id long, chunk_index int, start_ts double, end_ts double, embedding array<double>, embedding_model string")
    assert sorted(r.rule for r in constraints.chunk_violations(chk).collect()) == ["chunk_index", "embedding_pair", "span_order", "unique_chunk"]


def test_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"sources": [{"url": "http://www.x.org/a/", "kind": "odd"}, {"url": "https://gdcvault.com/1", "title": "T"}]}')
    (tmp_path / "b.json").write_text('[{"url": "https://x.org/a", "title": "later"}, {"url": "https://y.org/", "kind": "docs"}]')
    (tmp_path / "c.md").write_text('* [Talk](https://youtu.be/abcdefghijk "2019, someone")\n[lib]: https://github.com/o/r "A library"\n[list](https://youtube.com/playlist?list=1)\n[Again](https://github.com/o/r/)\n')
    got, denied = manifest.load(spark, *(str(tmp_path / n) for n in ("a.json", "b.json", "c.md")))
    rows = {r.url: r for r in got.collect()}
    assert set(rows) == {"https://x.org/a", "https://y.org/", "https://youtube.com/watch?v=abcdefghijk", "https://github.com/o/r"}
    assert rows["https://x.org/a"].title == "http://www.x.org/a/" and rows["https://x.org/a"].kind == "blog"
    assert rows["https://github.com/o/r"].title == "Again" and rows["https://youtube.com/watch?v=abcdefghijk"].note == "2019, someone"
    assert [r.url for r in denied.collect()] == ["https://gdcvault.com/1"]
    assert [r.url for r in manifest.select(got, kinds=["talk", "docs"], limit=1).collect()] == ["https://y.org/"]


def test_recordings(spark, tmp_path):
    spark.createDataFrame([("Should I use ECS?", "yes [1]")], "question string, answer string").coalesce(1).write.mode("append").json(str(tmp_path / "one"))
    recordings.write(spark.createDataFrame([("Should I use ECS?", "yes [1]")], "question string, answer string"), str(tmp_path / "r"), "acme")
    held = recordings.read(spark, str(tmp_path / "r"))
    asked = spark.createDataFrame([(" should i  USE ecs? ", "acme"), ("Should I use ECS?", None), ("Use ECS?", "acme")], "question string, user string")
    found = {(r.question, r.user): r.recorded for r in recordings.lookup(held, asked).collect()}
    assert found[" should i  USE ecs? ", "acme"].answer == "yes [1]" and found["Should I use ECS?", None] is None and found["Use ECS?", "acme"] is None
    assert recordings.entries(held).first() == ("Should I use ECS?", "acme")
