"""Stems by their published examples, and searches by stems against plain counts."""

import collections
import os
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sediment.functions.stemmer import STOP_WORDS, stem
from sediment.operators import retrieval, stems
from sediment.plans import queries as Q
from sediment.plans import stemmed
from sediment.sources import index

EXAMPLES = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consolation consol consolations consol consolatory consolatori console consol consoling consol consolingly consol conspicuous conspicu conspicuously conspicu conspiracy conspiraci
constable constabl constancy constanc constant constant knack knack knackeries knackeri knaves knave knavish knavish kneaded knead kneel kneel kneeling kneel knees knee knew knew
knightly knight knit knit knitted knit knitting knit knives knive knocker knocker knots knot
caresses caress ties tie cries cri gas gas this this gaps gap kiwis kiwi agreed agre feed feed plastered plaster bled bled motoring motor sing sing hopping hop hoping hope luxuriated luxuri
happy happi by by say say relational relat conditional condit rational ration generously generous generate generat communism communism skies sky news news succeed succeed
adjustable adjust replacement replac adoption adopt electrical electr goodness good hopefulness hope imported import imports import dog's dog yellow yellow
""".split()


@pytest.mark.parametrize("word, want", list(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True)))
def test_published_examples(word, want):
    assert stem(word) == want


@given(st.text("aeioubdglnstyz'", max_size=12))
def test_a_stem_is_never_longer_than_its_word_and_an_e(word):
    assert len(stem(word)) <= len(word) + 1


CHUNKS = "chunk_id long, source_id long, content string, owner string, duplicate_of long, embedding array<float>"


def test_terms_are_met_by_stem_and_words_of_one_stem_count_each(spark):
    texts = ["imported meshes import", "importing the mesh", "Imports of grain", "stone walls", None, "", *["plain filler words"] * 24]
    chunks = spark.createDataFrame([(i, i, x, "public", None, None) for i, x in enumerate(texts)], CHUNKS)
    words = retrieval.postings(chunks)
    posts = stems.stemmed(words)
    plain = collections.Counter((i, stem(w)) for i, x in enumerate(texts) for w in (x or "").lower().split() if w not in STOP_WORDS)
    assert {(r.chunk_id, r.term): r.tf for r in posts.collect()} == plain
    report = {r.term: (r.stem, r.df, r.kept) for r in stems.analyse(posts, ["import", "imported", "very", "words", "nowhere"], retrieval.visible_total(chunks)).collect()}
    assert report == {"import": ("import", 3, True), "imported": ("import", 3, True), "very": (None, 0, False), "words": ("word", 24, False), "nowhere": ("nowher", 0, False)}
    asked = spark.createDataFrame([(1, "import imported mesh very", None), (2, "very", None)], "qid long, question string, vector array<float>")
    hits = retrieval.search_many(chunks, asked, 5, posts=posts, stems=stems.asked_stems).orderBy("marker").collect()
    assert [(r.qid, r.chunk_id, r.matched_terms, round(r.score, 6)) for r in hits] == [(1, 0, 3, 1.5), (1, 1, 3, 0.9), (1, 2, 2, 0.4)]
    exact = retrieval.search_many(chunks, asked, 5, posts=words).collect()
    assert {(r.chunk_id, r.matched_terms) for r in exact} == {(0, 2), (1, 1)}


def test_vocabulary_of_the_test_tables_equals_plain_counts(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    counts, seen = collections.Counter(), collections.defaultdict(set)
    for r in retrieval.visible(index.of(spark, folder).chunks, "test1").select("chunk_id", "content").collect():
        for w in re.findall("[A-Za-z0-9_+#-]+", r.content or ""):
            if w.lower() not in STOP_WORDS:
                counts[stem(w.lower())] += 1
                seen[stem(w.lower())].add(r.chunk_id)
    got = {r.stem: (r.df, r.occurrences) for r in stemmed.queries()["stem_vocabulary"](spark, folder).collect()}
    assert got == {s: (len(seen[s]), n) for s, n in counts.items()}


def _passages(spark):
    texts = ["imported meshes import", "The Importing, the mesh", None, "", "the and", "İmport Kept ſtones c++ a_b-c#", *[f"Fillers w{i % 7} relate{i % 3}d filling x{i}" for i in range(600)]]
    return spark.createDataFrame([(i, i % 9, x, "public", 1 if i == 8 else None, None) for i, x in enumerate(texts)], CHUNKS).coalesce(1)


def test_passages_stemmed_where_they_are_read_have_the_postings_of_their_words(spark):
    chunks = _passages(spark)
    words = retrieval.postings(chunks)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    want = rows(stems.stemmed(words))
    got = stems.postings(chunks)
    assert got.columns == words.columns and rows(got) == want and len(want) > 2000
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([("filler",), ("import",), ("import",), ("nowhere",)], "term string")
    assert rows(stems.postings(chunks, asked)) == [r for r in want if r[4] in ("filler", "import")]
    assert stems.postings(chunks.where("false")).count() == 0
    known, said = collections.defaultdict(set), {r.stem: r for r in stems.words_met(chunks).collect()}
    for r in stems.vocabulary(words).collect():
        known[r.stem].add(r.term)
    assert {s: r.words for s, r in said.items()} == {s: sorted(w) for s, w in known.items()}
    posts = collections.Counter(r[4] for r in want)
    assert {s: r.df for s, r in said.items()} == posts and sum(r.occurrences for r in said.values()) == sum(r[5] for r in want)


def test_a_word_is_stemmed_after_words_are_distinct_whatever_the_stem_is_joined_to(spark):
    asked = spark.createDataFrame([("import",)], "term string")
    plan = stems.stemmed(retrieval.postings(_passages(spark))).join(asked, "term", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    udf = plan.index("ArrowEvalPython")
    assert "Aggregate [term" in plan[udf:] and "ArrowEvalPython" not in plan[udf + 1 :]


def test_postings_stay_where_they_are_read_unless_too_many_terms_are_asked(spark, monkeypatch):
    chunks = _passages(spark)
    posts = stems.postings(chunks)
    asked = spark.createDataFrame([(1, "import imported mesh very w3", None), (2, "related w5 w6", None), (3, "very", None)], "qid long, question string, vector array<float>")
    find = lambda: retrieval.lexical_many(asked, posts, retrieval.visible_total(chunks), 5, stems=stems.asked_stems)
    joins = lambda df: re.findall("SortMergeJoin|ShuffledHashJoin", df._jdf.queryExecution().executedPlan().toString())
    near = find()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = find()
        n = len(joins(sent))
        monkeypatch.setattr(retrieval, "SENT_TERMS", 2)
        dealt = find()
        assert len(joins(dealt)) >= n + 2  # postings to asked and to kept terms
        want = sorted(tuple(r) for r in near.collect())
        assert want and sorted(tuple(r) for r in sent.collect()) == want == sorted(tuple(r) for r in dealt.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hits_by_stems_of_the_test_tables_are_those_by_postings_of_words(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    held, columns = index.of(spark, folder), ["qid", "marker", "chunk_id", "matched_terms", "found_by"]
    whole = retrieval.search_many(held.chunks, Q._questions(spark, folder), Q.LIMIT, user=Q.USER, posts=stems.stemmed(held.postings), stems=stems.asked_stems)
    want = sorted(tuple(r) for r in whole.select(*columns).collect())
    assert sorted(tuple(r) for r in stemmed.queries()["stem_search_many"](spark, folder).select(*columns).collect()) == want and want
