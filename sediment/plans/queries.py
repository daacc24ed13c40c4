"""Queries over whole test tables, one for each operator of the corpus engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import io
from ..functions import terms as T
from ..functions import text as X
from ..functions import urls as U
from ..functions.vectors import cosine
from ..operators import answers, chunker, constraints, dedupe, embedding, ingest, merge, retrieval, telemetry, verify
from ..sources import cache, index, manifest, recordings
from ..sources import tables as S

QUESTION = "What should the therhean attion of thanedble erblest and eriner be, ndernt or esndha?"
TERMS = T.terms_of(QUESTION)
USER = "test1"
LIMIT = 8


def _vector(spark: SparkSession, d: str) -> list[float]:
    """The query vector: the embedding numbered 0."""
    return S.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.visible(index.of(spark, d).chunks, USER)


def _posts(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings that the tenant sees."""
    return retrieval.visible(index.of(spark, d).postings, USER)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Those of the question's terms."""
    return _posts(spark, d).where(F.col("term").isin(*TERMS))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.analyse_terms(_seen(spark, d), TERMS, _asked(spark, d)).where("kept")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "pages")


def tenancy_filter(spark, d):
    return S.sources(spark, d).where(F.col("owner").isin(*retrieval.visible_owners(None))).groupBy("owner", "lang").agg(F.count(F.lit(1)).alias("n"))


def visible_total(spark, d):
    return retrieval.visible_total(retrieval.visible(S.chunks(spark, d), USER))  # it reads two columns, so nothing is written for it


def query_terms(spark, d):
    return S.table(spark, d, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


def df_all_terms(spark, d):
    return retrieval.doc_freq(_posts(spark, d))


def df_terms(spark, d):
    """The report of the 50 most frequent terms; ``df_all_terms`` has every one."""
    freq = retrieval.doc_freq(_posts(spark, d))
    return freq.orderBy(F.desc("df"), "term").limit(50)


def analyse_terms(spark, d):
    return retrieval.analyse_terms(_seen(spark, d), TERMS, _asked(spark, d))


def fulltext_or_match(spark, d):
    hit = F.arrays_overlap(T.tokens(F.col("content")), F.array(*[F.lit(t) for t in TERMS]))
    return _seen(spark, d).where(hit).select("chunk_id", "source_id")


def lexical_topk(spark, d):
    return retrieval.top(retrieval.lexical(_seen(spark, d), _kept(spark, d), _asked(spark, d)), "score", 24).select("chunk_id", "source_id", "matched_terms", F.round("score", 6).alias("score"))


def lexical_capped(spark, d):
    return retrieval.lexical_pool(_seen(spark, d), _kept(spark, d), LIMIT, posts=_asked(spark, d)).select("chunk_id", "source_id", "lexical_rank")


def semantic_topk(spark, d):
    ranked = retrieval.top(retrieval.semantic(_seen(spark, d), _vector(spark, d)), "similarity", 24)
    return ranked.select("chunk_id", "source_id", F.round("similarity", 6).alias("similarity"))


def semantic_pruned(spark, d):
    """The same from blocks of vectors, of which only those are read that can hold a hit."""
    hits, _ = index.blocks(spark, d).nearest(_vector(spark, d), 24, USER)
    return hits.select("chunk_id", "source_id", F.round("similarity", 6).alias("similarity"))


def semantic_capped(spark, d):
    return retrieval.semantic_pool(_seen(spark, d), _vector(spark, d), LIMIT).select("chunk_id", "source_id", "vector_rank")


def _fused(spark, d):
    seen = _seen(spark, d)
    return retrieval.fuse(retrieval.lexical_pool(seen, _kept(spark, d), LIMIT, posts=_asked(spark, d)), retrieval.semantic_pool(seen, _vector(spark, d), LIMIT))


def rrf_fused(spark, d):
    return _fused(spark, d).select("chunk_id", "source_id", "matched_terms", "lexical_rank", "vector_rank", F.round("rrf", 9).alias("rrf"))


def hybrid_search(spark, d):
    held = index.of(spark, d)
    hits = retrieval.search(held.chunks, QUESTION, _vector(spark, d), LIMIT, user=USER, posts=held.postings)
    return hits.select("marker", "chunk_id", "source_id", "matched_terms", F.round("similarity", 6).alias("similarity"), F.round("rrf", 9).alias("rrf"), "found_by", "title")


def found_by(spark, d):
    return _fused(spark, d).groupBy(retrieval.found_by().alias("found_by")).agg(F.count(F.lit(1)).alias("n"))


def abstain_decision(spark, d):
    out = retrieval.abstains(retrieval.finalists(_fused(spark, d), LIMIT))
    return out.withColumn("best_similarity", F.round("best_similarity", 6))


def prompt_build(spark, d):
    held = index.of(spark, d)
    hits = retrieval.search(held.chunks, QUESTION, _vector(spark, d), LIMIT, user=USER, posts=held.postings)
    return answers.prompt(hits, QUESTION)


def citation_join(spark, d):
    """The hits that answers cite: each question's answer cites its length's last digit and hit 3; markers without a hit go."""
    held = index.of(spark, d)
    hits = retrieval.search(held.chunks, QUESTION, _vector(spark, d), LIMIT, user=USER, posts=held.postings)
    given = S.table(spark, d, "benchmark").select("item_id", F.concat(F.lit("See ["), (F.length("text") % 10).cast("string"), F.lit("], [3].")).alias("answer"))
    return answers.citations(given, hits, "item_id").select("item_id", "marker", "chunk_id")


def search_report(spark, d):
    held = index.of(spark, d)
    return retrieval.search_traced(held.chunks, QUESTION, _vector(spark, d), LIMIT, user=USER, posts=held.postings)[1]


def citation_markers(spark, d):
    """Sentences of the questions as answers, each citing its length's last two digits and hit 3."""
    text = F.concat(F.col("text"), F.lit(" ["), (F.length("text") % 100).cast("string"), F.lit("] [3] [3]"))
    return S.table(spark, d, "benchmark").select("item_id", F.array_join(answers.cited_markers(text).cast("array<string>"), ",").alias("cited"))


def semantic_all(spark, d):
    """The cosine similarity of every embedding to the query's."""
    v = F.array(*[F.lit(float(x)) for x in _vector(spark, d)])
    return S.table(spark, d, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), v), 6).alias("similarity"))


def norm_text_hash(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.normalise(F.col("text"))).alias("hash"))


def shingle_sketch(spark, d):
    s = dedupe.sketches(_docs(spark, d), "doc_id", "text")
    return s.select("id", F.col("n").cast("long").alias("n"), F.size("sketch").cast("long").alias("k"), F.md5(F.array_join(F.col("sketch").cast("array<string>"), ",")).alias("sketch_md5"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.scored_pairs(io.written(dedupe.sketches(S.sources(spark, d), owner_col="owner"), "sketches"))


def near_dup_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("score", 6).alias("score"))


def best_duplicate(spark, d):
    return dedupe.best_earlier(_pairs(spark, d)).select("id", "duplicate_of", F.round("score", 6).alias("score"))


def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", X.content_hash(F.col("text")).alias("hash"))


def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("clean_md5"))


def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", X.word_count(F.col("text")).cast("long").alias("tokens"))


def pseudo_cues(spark, d):
    cues = X.pseudo_cues(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(cues).cast("long").alias("n"), F.md5(F.array_join(cues, "\n")).alias("cues_md5"))


def html_to_text(spark, d):
    return X.page_text(_pages(spark, d), "html", "t").select("page_id", F.md5("t").alias("text_md5"))


def _as_videos(u: Column) -> Column:
    """English pages as watch pages, French ones as short links, German ones as a channel, of one video host."""
    number = F.lpad(F.col("page_id").cast("string"), 11, "a")
    watch = F.concat(F.lit("http://m.youtube.com/watch?list=x&v="), number, F.lit("&t=1m"))
    return (
        F.when(F.contains(u, F.lit("/en/")), watch).when(F.contains(u, F.lit("/fr/")), F.concat(F.lit("https://youtu.be/"), number, F.lit("?si=1")))
        .when(F.contains(u, F.lit("/de/")), F.lit("https://www.youtube.com/channel/abc")).otherwise(u)
    )


def canonical_url(spark, d):
    """Of every page, and of the page put on a video host."""
    return _pages(spark, d).select("page_id", U.canonical_url(F.col("url")).alias("url"), U.canonical_url(_as_videos(F.col("url"))).alias("video_url"))


def index_pages(spark, d):
    u = _as_videos(F.col("url"))
    return _pages(spark, d).select("page_id", U.video_id(u).alias("video"), U.is_index_page(u).alias("index_page"), U.kind_of(u).alias("kind"))


def url_parts(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.host(u).alias("host"), U.kind_of(u).alias("kind"), U.license_of(U.kind_of(u)).alias("license"), U.is_index_page(u).alias("index_page"), U.cache_key(u).alias("cache_key"))


def domain_filter(spark, d):
    """Pages that policy does not exclude, where German ones are put on a host that it does, French ones on one that only ends alike."""
    moved = lambda h: F.concat(F.lit(f"https://{h}"), U.path(F.col("url")))
    url = F.when(F.contains("url", F.lit("/de/")), moved("WWW.gdcvault.com")).when(F.contains("url", F.lit("/fr/")), moved("notgdcvault.com")).otherwise(F.col("url"))
    return _pages(spark, d).select("page_id", url.alias("url")).where(~U.is_denied(F.col("url")))


def github_raw_urls(spark, d):
    """Pages as repositories of that host: their paths' two parts, or a file below them."""
    fake = F.when(F.col("page_id") < 100, F.concat(F.lit("https://www.github.com"), U.path(F.col("url")))).otherwise(F.concat(F.lit("https://github.com/owner/repo/blob/main"), U.path(F.col("url"))))
    return _pages(spark, d).select("page_id", F.array_join(U.github_raw_urls(fake), " ").alias("raw_urls"))


def challenge_filter(spark, d):
    """Every page with a marker put before a part of them, by the language of its path."""
    text = F.when(F.contains("url", F.lit("/fr/")), F.concat(F.lit("Just a moment... "), "html")).when(F.contains("url", F.lit("/de/")), F.concat(F.lit("VERIFY you are human. "), "html")).otherwise(F.col("html"))
    return _pages(spark, d).select("page_id", X.challenge_marker(text).alias("marker"), X.page_status(text, F.lit(200), F.lit(False)).alias("status"))


def cue_clamp(spark, d):
    c = chunker.clamped(S.cues(spark, d))
    return c.select("source_id", "pos", F.round("end", 3).alias("end"), F.round("gap", 3).alias("gap"))


def cue_gaps(spark, d):
    c = chunker.clamped(S.cues(spark, d))
    return c.groupBy("source_id").agg(F.count_if(F.col("gap") > 8.0).alias("breaks"), F.count(F.lit(1)).alias("cues"))


def chunk_segments(spark, d):
    return chunker.chunk_cues(S.cues(spark, d), target=120, overlap=30)


def chunk_segments_across(spark, d):
    """As ``chunk_segments``, but a passage after a silence carries words from before it."""
    return chunker.chunk_cues(S.cues(spark, d), target=120, overlap=30, overlap_across_gap=True)


def chunk_texts(spark, d):
    """The text that a conversation's fingerprint is taken of: its passages in order."""
    return dedupe.chunk_texts(chunk_segments(spark, d)).select(F.col("id").alias("source_id"), F.md5("raw_text").alias("text_md5"))


def chunk_prose(spark, d):
    return chunker.chunk_prose(_docs(spark, d), "doc_id", "text")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns as stored passages, and the next version: assistants' turns rewritten, last turns gone, one turn more in every third conversation."""
    c = S.table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"), "role")
    old = c.withColumn("content_hash", F.sha2("content", 256)).withColumn("embedding_model", F.lit("m")).drop("role")
    last = c.groupBy("source_id").agg(F.max("chunk_index").alias("last"))
    new = c.join(last, "source_id").where((F.col("chunk_index") < F.col("last")) | (F.col("last") == 0))
    new = new.withColumn("content", F.when(F.col("role") == "assistant", F.concat("content", F.lit(" (revised)"))).otherwise(F.col("content")))
    more = last.where("source_id % 3 = 0 AND last > 0").select("source_id", (F.col("last") + 1).alias("chunk_index"), F.concat(F.lit("more of "), F.col("source_id").cast("string")).alias("content"))
    new = new.select("source_id", "chunk_index", "content").unionByName(more)
    return old, new.withColumn("content_hash", F.sha2("content", 256))


def merge_actions(spark, d):
    merged = merge.merge_chunks(*_versions(spark, d))
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count("embedding_model").alias("embedded"))


def stale_tail(spark, d):
    merged = merge.merge_chunks(*_versions(spark, d))
    return merged.where("action = 'delete'").select("source_id", "chunk_index")


def merged_table(spark, d):
    old, new = _versions(spark, d)
    out = merge.replaced(old, merge.merge_chunks(old, new))
    return out.select("source_id", "chunk_index", "content_hash", "embedding_model")


def upsert_sources(spark, d):
    """Sources upserted: urls of the same owner keep their sticky columns, French ones are new."""
    every = S.sources(spark, d)
    old = every.where("lang <> 'fr'").select("id", "url", "kind", "title", "owner", "duplicate_of")
    new = every.where("owner = 'public'").select("owner", "url", (-F.col("id")).alias("id"), F.lit("docs").alias("kind"), F.upper("title").alias("title"))
    out = merge.upsert_sources(old, new)
    return out.select("id", "owner", "url", "kind", "title", "duplicate_of", "action")


def embedding_writeback(spark, d):
    c = S.chunks(spark, d).withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), "stored"))
    made = c.where(F.col("embedding").isNull()).select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("new").alias("embedding_model"))
    return merge.write_embeddings(c, made).groupBy("embedding_model").agg(F.count("embedding").alias("n"), F.sum(F.size("embedding")).alias("dims"))


def duplicate_titles(spark, d):
    """Flagged sources with the title of the source they copy."""
    s = S.sources(spark, d)
    first = s.select(F.col("id").alias("duplicate_of"), F.col("title").alias("original"))
    return s.where("duplicate_of is not null").select("id", "duplicate_of").join(first, "duplicate_of")


def cascade_delete(spark, d):
    gone = S.sources(spark, d).where("lang = 'fr'").select("id")
    src, chk = merge.delete_sources(S.sources(spark, d), S.chunks(spark, d).withColumn("source_id", F.col("chunk_id")), gone)
    left = src.agg(F.count(F.lit(1)).alias("sources"), F.count("duplicate_of").alias("flagged"))
    return left.join(chk.agg(F.count(F.lit(1)).alias("chunks")), F.lit(True))


def corpus_stats(spark, d):
    return telemetry.corpus_stats(S.sources(spark, d), S.chunks(spark, d), X.word_count(F.col("content")))


def pending_batches(spark, d):
    """The first two batches of passages without an embedding, embedded by their length."""
    lengths = lambda texts: [[float(len(t))] for t in texts]
    made = embedding.backfill(S.chunks(spark, d), lengths, "len", batch=64, max_batches=2)
    return made.select("chunk_id", F.col("embedding")[0].cast("long").alias("length"), "embedding_model")


def mark_duplicates(spark, d):
    """Sources whose flags are all set anew, from those of equal texts."""
    s = S.sources(spark, d)
    flags = s.where("duplicate_of is not null").select("id", "duplicate_of")
    return merge.mark_duplicates(s.withColumn("duplicate_of", F.lit(-1).cast("long")), flags).select("id", "duplicate_of")


def clean_segments(spark, d):
    """Turns as cues with an artefact before them, of which those of the system are nothing else."""
    c = S.cues(spark, d).join(S.table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("pos"), "role"), ["source_id", "pos"])
    text = F.when(F.col("role") == "system", "[Music]").otherwise(F.concat(F.lit(" [Music]  "), "text"))
    segments = F.array(F.struct(text.alias("text"), F.when(F.col("pos") > 0, F.col("start")).alias("start"), "duration"))
    return c.select("source_id", "pos", F.explode(X.clean_segments(segments)).alias("s")).select("source_id", "pos", F.md5("s.text").alias("text_md5"), "s.start")


def pending_embeddings(spark, d):
    return S.chunks(spark, d).agg(F.count_if(F.col("embedding").isNull()).alias("pending"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    return e.select(F.col("ts").alias("created_at"), F.col("event_type").alias("operation"), F.col("event_type").alias("model"), F.col("value").alias("latency_ms"), F.col("user_id").alias("tokens_in"), (F.col("user_id") * 2).alias("tokens_out"))


def _now(spark: SparkSession, d: str) -> Column:
    return F.lit(S.table(spark, d, "events").agg(F.max("ts").cast("string")).first()[0]).cast("timestamp")


def _prices(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('click', 5.0D, 25.0D), ('view', 3.0D, 15.0D), ('error', 1.0D, 5.0D) AS p(model, price_in, price_out)")


def spend_today(spark, d):
    out = telemetry.spend_today(telemetry.with_cost(_calls(spark, d), _prices(spark)), _now(spark, d))
    return out.select(F.round("spend_usd", 6).alias("spend_usd"))


def cost_join(spark, d):
    out = telemetry.with_cost(_calls(spark, d), _prices(spark))
    return out.groupBy("model").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count(F.lit(1)).alias("calls"))


def latency_percentiles(spark, d):
    out = telemetry.latency(_calls(spark, d), _now(spark, d))
    return out.select(F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"))


def latency_of_operation(spark, d):
    out = telemetry.latency(_calls(spark, d), _now(spark, d), "view")
    return out.select(F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"))


def latency_by_operation(spark, d):
    part = lambda p: F.expr(f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY latency_ms), 6)")
    return _calls(spark, d).groupBy("operation").agg(part(0.5).alias("p50_ms"), part(0.95).alias("p95_ms"))


def dq_violations(spark, d):
    """Turns as passages: places that repeat or are negative, spans that end before they start."""
    c = chunker.clamped(S.cues(spark, d)).select("source_id", F.col("pos").cast("int").alias("chunk_index"), F.col("end").alias("start_ts"), F.col("start").alias("end_ts"))
    return constraints.chunk_violations(c)


def source_violations(spark, d):
    s = S.sources(spark, d).withColumn("kind", F.when(F.col("lang") == "de", "page").otherwise(F.col("kind")))
    return constraints.source_violations(s)


def deep_link(spark, d):
    u = F.when(F.contains("url", F.lit("/en/")), F.concat(F.lit("https://youtube.com/watch?v="), F.col("page_id").cast("string"))).when(F.contains("url", F.lit("/fr/")), F.lit("https://youtu.be/x")).otherwise(F.col("url"))
    return _pages(spark, d).select("page_id", X.deep_link(u, F.col("page_id") * 1.75).alias("link"))


def timestamp_fmt(spark, d):
    return S.cues(spark, d).select("source_id", "pos", X.timestamp_label(F.when(F.col("start") > 0, F.col("start") * 13.7)).alias("label"))


def provenance(spark, d):
    kind = F.when(F.col("role") == "user", "manual").when(F.col("role") == "assistant", "auto")
    return S.table(spark, d, "conversations").groupBy(X.provenance(kind).alias("provenance")).agg(F.count(F.lit(1)).alias("n"))


def sample_lookup(spark, d):
    """Questions, in other spacing, looked up among the recorded ones of their tenant."""
    b = S.table(spark, d, "benchmark")
    recorded = b.select(X.question_key(F.col("text")).alias("key"), F.lit(None).cast("string").alias("recorded_for_user"), F.col("item_id").alias("recorded_item"))
    asked = b.select("item_id", F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  "))).alias("question"), F.when(F.length("text") > 200, "test1").alias("user"))
    return recordings.lookup(recorded, asked).groupBy("item_id").agg(F.min("recorded.recorded_item").alias("recorded_item"))


def recording_parity(spark, d):
    """Recorded answers against the same ones given now, of which every fifth reads otherwise and every seventh is gone."""
    b = S.table(spark, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(" "), "text").alias("question"), F.lit(None).cast("string").alias("user"), "item_id", F.length("text").alias("answer"))
    again = b.where("item_id % 7 <> 0").withColumn("answer", F.when(F.col("item_id") % 5 == 0, -F.col("answer")).otherwise(F.col("answer")))
    found = verify.recording_differences(b, again, "answer", "item_id")
    return found.select(F.regexp_extract("question", r"^(\d+)", 1).cast("long").alias("item_id"), "column")


def citation_checks(spark, d):
    """Citations of turns at times of which some lie outside, some of flagged sources, and some of no passage."""
    c = chunker.clamped(S.cues(spark, d)).select(F.concat_ws(":", "source_id", "pos").alias("chunk_id"), "source_id", F.col("start").alias("start_ts"), F.col("end").alias("end_ts"), "pos")
    cited = c.select(F.when(F.col("pos") % 11 == 10, "none").otherwise(F.col("chunk_id")).alias("chunk_id"), F.col("chunk_id").alias("answer_id"), (F.col("start_ts") + F.col("pos") % 5).alias("at"))
    flagged = c.select(F.col("source_id").alias("id"), F.when(F.col("source_id") % 9 == 0, 1).alias("duplicate_of")).distinct()
    return verify.citation_violations(cited, c, flagged)


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Pages as sources and as what was fetched: French ones failed, German ones were not fetched, Spanish ones answered 404."""
    p = _pages(spark, d)
    u = F.col("url")
    sources = p.select("page_id", F.col("page_id").cast("string").alias("url"), F.when(F.col("page_id") % 2 == 0, "repo").otherwise("blog").alias("kind"))
    fetched = p.where(~F.contains(u, F.lit("/de/"))).select(
        F.col("page_id").cast("string").alias("url"), F.when(F.contains(u, F.lit("/es/")), 404).otherwise(200).alias("http_status"), F.col("html").alias("text"),
        F.when(F.contains(u, F.lit("/fr/")), "timeout").alias("error"))
    return verify.verified(sources, fetched)


def verified_sources(spark, d):
    return _checked(spark, d).select("page_id", "ok", "status", "detail")


def verified_by_kind(spark, d):
    return verify.by_kind(_checked(spark, d))


def ingest_outcomes(spark, d):
    """What becomes of every page as a source: policy, failed fetches, bot walls, talks without cues, and pages without text."""
    u = F.col("url")
    text = F.when(F.col("page_id") % 13 == 0, F.lit(" ")).when(F.contains(u, F.lit("/de/")), F.concat(F.lit("Just a moment... "), "t")).otherwise(F.col("t"))
    src = X.page_text(_pages(spark, d), "html", "t").select(
        F.col("page_id").alias("id"), F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("https://gdcvault.com/"), F.col("page_id").cast("string"))).otherwise(u).alias("url"),
        F.when(F.contains(u, F.lit("/es/")), "talk").otherwise("blog").alias("kind"), text.alias("raw_text"), F.lit(None).cast("array<struct<text:string,start:double,duration:double>>").alias("raw_segments"),
        F.when(F.contains(u, F.lit("/fr/")), "timeout").alias("error"))
    judged = ingest.judged(src)
    return ingest.outcomes(judged, chunker.chunk_sources(judged.where("outcome is null")))


def manifest_dedupe(spark, d):
    """Pages as two manifests, the second in reverse: one row for each canonical url, the first one's."""
    p = _pages(spark, d)
    base = p.select(U.canonical_url(F.col("url")).alias("url"), F.lit("blog").alias("kind"), F.col("url").alias("title"), F.lit(None).cast("string").alias("author"), F.lit("public-web").alias("license"), F.lit(None).cast("string").alias("note"), F.lit("a").alias("manifest"), F.col("page_id").alias("pos"))
    kept, _ = manifest.combine([base, base.withColumn("manifest", F.lit("b")).withColumn("pos", -F.col("pos"))])
    return kept.select("url", "title", "manifest")


def _json_manifests(spark: SparkSession, d: str) -> DataFrame:
    """A JSON manifest of each page: a bare list or a named one, with and without title, kind and license."""
    title = F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("Page "), F.col("page_id").cast("string"))).otherwise("")
    kind = F.when(F.col("page_id") % 3 == 0, "docs").when(F.col("page_id") % 3 == 1, "poem")
    item = F.struct("url", kind.alias("kind"), title.alias("title"), F.when(F.col("page_id") % 5 == 0, "cc-by").alias("license"))
    value = F.when(F.col("page_id") % 2 == 0, F.to_json(F.array(item))).otherwise(F.to_json(F.struct(F.array(item).alias("sources"))))
    return manifest.parse_json(_pages(spark, d).select(F.col("page_id").cast("string").alias("manifest"), value.alias("value")))


def manifest_json(spark, d):
    return _json_manifests(spark, d).select("manifest", "url", "kind", "title", "license")


def manifest_select(spark, d):
    """Of the manifests' sources, the first ten of a kind, in order."""
    ranked = _json_manifests(spark, d).withColumn("file", F.lit(0)).withColumn("pos", F.col("manifest").cast("long"))
    return manifest.select(ranked, kinds=["docs"], limit=10).select("manifest", "url")


def cache_missing(spark, d):
    """Pages whose response is not kept: those of even numbers are."""
    p = _pages(spark, d)
    cached = p.where("page_id % 2 = 0").select(U.cache_key(F.col("url")).alias("cache_key"))
    return cache.missing(p, cached).select("page_id", "cache_key")


def cache_rejects(spark, d):
    """Kept responses by whether they are errors."""
    p = _pages(spark, d).select(U.cache_key(F.col("url")).alias("cache_key"), F.when(F.col("page_id") % 7 == 0, "timeout").alias("error"))
    usable, rejects = cache.split(p)
    return usable.select("cache_key", F.lit(None).cast("string").alias("reason")).unionByName(rejects)


def markdown_links(spark, d):
    """Pages as Markdown with an inline link and a reference, parsed back to sources."""
    md = F.concat(F.lit("See [Page "), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(' "first").\n[ref]: '), "url", F.lit('/more "second"\n'))
    pages = _pages(spark, d).select(F.col("page_id").cast("string").alias("manifest"), md.alias("value"))
    return manifest.parse_markdown(pages).select("manifest", "url", "title", "note", "kind", "license")


def ingest_report(spark, d):
    """What becomes of every page: denied, a bot wall, without content, or ingested."""
    pages, text = X.page_text(_pages(spark, d), "html", "t"), F.col("t")
    deny = U.host(F.col("url")).isin("spam-farm.example.org", "casino-win.example.com")
    outcome = F.when(deny, "denied").when(X.challenge_marker(text).isNotNull(), "skipped").when(text == "", "no content").otherwise("ingested")
    return telemetry.ingest_report(pages.select(outcome.alias("outcome")))


def kinds_count(spark, d):
    return _pages(spark, d).groupBy(U.kind_of(F.col("url")).alias("kind"), U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def sources_per_owner(spark, d):
    """The best hit of each source: the window that caps them, at one."""
    w = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "chunk_id")
    ranked = retrieval.semantic(_seen(spark, d), _vector(spark, d)).withColumn("rn", F.row_number().over(w)).where("rn <= 1")
    return ranked.select("source_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


def stored_passages(spark, d):
    """The passages that two ingestions leave in a store."""
    return index.corpus(spark, d).passages().select("source_id", "chunk_index", "content_hash", "token_count")


def stored_terms(spark, d):
    """Document frequency and occurrences of every term, from the store's postings as they are after a re-ingestion."""
    return index.corpus(spark, d).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def stored_search(spark, d):
    """A search by words over the store: postings, the sources' counts, and only the buckets of the hits."""
    hits = index.corpus(spark, d).search(QUESTION, None, LIMIT, USER)
    return hits.select("marker", "source_id", "chunk_index", "matched_terms", F.round("score", 6).alias("score"), "content_hash", "title")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """All of ``benchmark`` as questions, each with the embedding of its number, if there is one."""
    vectors = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")).join(vectors, "qid", "left")


def _found_many(spark: SparkSession, d: str) -> DataFrame:
    held = index.of(spark, d)
    return retrieval.search_many(held.chunks, _questions(spark, d), LIMIT, user=USER, posts=held.postings)


def search_many(spark, d):
    """Every question's hits over all visible passages, in one plan."""
    return _found_many(spark, d).select("qid", "marker", "chunk_id", "source_id", "matched_terms", F.round("similarity", 6).alias("similarity"), F.round("rrf", 9).alias("rrf"), "found_by")


def abstain_many(spark, d):
    """Which of all questions are refused."""
    out = retrieval.abstains_many(_questions(spark, d), _found_many(spark, d))
    return out.withColumn("best_similarity", F.round("best_similarity", 6))
