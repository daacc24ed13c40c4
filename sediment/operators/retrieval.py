"""Retrieval: term analysis, lexical and vector rankings, their fusion, and the decision to abstain.

Everything is one lazy plan over ``chunks`` (chunk_id, source_id, content, owner, duplicate_of,
embedding, and what else shall come back). Ranking works on identifiers and scores alone; contents
are joined back to the few rows that are left.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import terms as T
from ..functions.text import bound
from ..functions.vectors import cosine, dot, norm

MAX_DOC_FREQ = 0.10
RRF_K = 60
PER_SOURCE = 2
SCAN_FACTOR = 8
MIN_MATCHED, MIN_SIMILARITY = 2, 0.45


def visible_owners(user: str | None) -> list[str]:
    return ["public"] if not user or user == "public" else ["public", user]


def visible(chunks: DataFrame, user: str | None = None) -> DataFrame:
    """What the tenant may see, without flagged duplicates."""
    return chunks.where(F.col("owner").isin(*visible_owners(user)) & F.col("duplicate_of").isNull())


#: What postings keep of their passage, so that they are filtered and capped without it.
CARRIED = ["chunk_id", "source_id", "owner", "duplicate_of"]


def counted(words: Column) -> Column:
    """An array of (term, tf): each distinct word of an array with its number, from the places where the sorted words change."""
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w, at: F.transform(at, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).cast("long").alias("tf")))
    return bound(F.sort_array(words), lambda w: F.when(F.size(w) > 0, bound(starts(w), lambda at: runs(w, at))))


def postings(chunks: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(chunk_id, source_id, owner, duplicate_of, term, tf). With ``terms``, other words are dropped before anything is exploded.

    A row holds all of its passage, so its words are counted where it is read, and nothing is shuffled.
    """
    words = T.tokens(F.col("content"))
    if terms is not None:
        words = F.filter(words, lambda t: t.isin(*terms) if terms else F.lit(False))
    made = chunks.select(*CARRIED, counted(words).alias("__w"))
    return made.select(*CARRIED, F.inline_outer("__w")).where("term is not null")  # without ``outer`` the planner would count twice, to filter


def doc_freq(posts: DataFrame) -> DataFrame:
    """(term, df): chunks that hold the term."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def visible_total(chunks: DataFrame) -> DataFrame:
    """One row: the number of chunks, at least 1."""
    return chunks.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))


def analyse_terms(chunks: DataFrame, terms: list[str], posts: DataFrame | None = None, max_df: float = MAX_DOC_FREQ, total: DataFrame | None = None) -> DataFrame:
    """(pos, term, df, total, kept): a term is kept if some chunk holds it, and at most ``max_df`` of them do. ``total``, one row, is their stored number."""
    spark = chunks.sparkSession
    asked = spark.createDataFrame(list(enumerate(terms)), "pos int, term string")
    freq = doc_freq(postings(chunks, terms) if posts is None else posts.where(F.col("term").isin(*terms)))
    out = asked.join(freq, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    out = out.join(visible_total(chunks) if total is None else total, F.lit(True), "left")
    return out.withColumn("kept", (F.col("df") > 0) & (F.col("df") / F.col("total") <= max_df))


def capped(ranked: DataFrame, score: str, per_source: int, *keys: str) -> DataFrame:
    """At most ``per_source`` rows of each source, best first; ties go to the smaller identifier."""
    best = Window.partitionBy(*keys, "source_id").orderBy(F.desc(score), "chunk_id")
    return ranked.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= per_source).drop("rn")


def top(ranked: DataFrame, score: str, n: int, rank: str | None = None) -> DataFrame:
    """The best ``n``, with their place from 1 if a name for it is given."""
    out = ranked.orderBy(F.desc(score), "chunk_id").limit(n)
    if rank:
        out = out.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), "chunk_id")))
    return out


def lexical(chunks: DataFrame, terms: list[str] | DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """(chunk_id, source_id, matched_terms, score): a tenth of the matching positions, times the terms that match."""
    if isinstance(terms, list):
        found = postings(chunks, terms) if posts is None else posts.where(F.col("term").isin(*terms))
    else:
        found = (postings(chunks) if posts is None else posts).join(terms.select("term"), "term", "left_semi")
    scored = found.groupBy("chunk_id", "source_id").agg(F.count(F.lit(1)).alias("matched_terms"), F.sum("tf").alias("n"))
    return scored.select("chunk_id", "source_id", "matched_terms", (F.lit(0.1) * F.col("n") * F.col("matched_terms")).alias("score"))


def semantic(chunks: DataFrame, vector: list[float] | Column) -> DataFrame:
    """(chunk_id, source_id, similarity) of all chunks with an embedding: an exact scan, by stored norms if there is a column ``norm``."""
    v = vector if isinstance(vector, Column) else F.array(*[F.lit(float(x)) for x in vector])
    scanned = chunks.where(F.col("embedding").isNotNull())
    alike = F.try_divide(dot(F.col("embedding"), v), F.col("norm") * norm(v)) if "norm" in chunks.columns else cosine(F.col("embedding"), v)
    return scanned.select("chunk_id", "source_id", F.round(alike, 9).alias("similarity"))


def pool_size(limit: int) -> int:
    return max(4 * limit, 24)


def lexical_pool(chunks: DataFrame, terms, limit: int, per_source: int = PER_SOURCE, posts: DataFrame | None = None) -> DataFrame:
    return top(capped(lexical(chunks, terms, posts), "score", 2 * per_source), "score", pool_size(limit), "lexical_rank")


def semantic_pool(chunks: DataFrame, vector, limit: int, per_source: int = PER_SOURCE, near: Callable[[list[float], int], DataFrame] | None = None) -> DataFrame:
    """The scan's window is bounded before the cap, so one source can fill it. ``near`` gives a vector's exact window without the scan."""
    n = SCAN_FACTOR * pool_size(limit)
    window = top(semantic(chunks, vector), "similarity", n) if near is None else near(vector, n)
    return top(capped(window, "similarity", 2 * per_source), "similarity", pool_size(limit), "vector_rank")


def fuse(lex: DataFrame | None, vec: DataFrame | None) -> DataFrame:
    """Reciprocal rank fusion. Only a lexical row has matched terms and a score above 0, only a vector row a similarity."""
    if lex is None and vec is None:
        raise ValueError("nothing to fuse")
    part = lambda rank: F.coalesce(1.0 / (RRF_K + F.col(rank)), F.lit(0.0))
    none = lambda t: F.lit(None).cast(t)
    if vec is None:
        both = lex.withColumn("similarity", none("double")).withColumn("vector_rank", none("int"))
    elif lex is None:
        both = vec.withColumn("matched_terms", none("long")).withColumn("lexical_rank", none("int")).withColumn("score", none("double"))
    else:
        right = vec.select("chunk_id", F.col("source_id").alias("__s"), "similarity", "vector_rank")
        both = lex.join(right, "chunk_id", "full_outer").withColumn("source_id", F.coalesce("source_id", "__s")).drop("__s")
    return both.select(
        "chunk_id", "source_id", F.coalesce("matched_terms", F.lit(0)).alias("matched_terms"), F.coalesce("score", F.lit(0.0)).alias("score"), "similarity", "lexical_rank", "vector_rank",
        F.round(part("lexical_rank") + part("vector_rank"), 12).alias("rrf"),
    )


def found_by() -> Column:
    both = F.col("lexical_rank").isNotNull() & F.col("vector_rank").isNotNull()
    return F.when(both, "both").when(F.col("lexical_rank").isNotNull(), "words").otherwise("meaning")


def finalists(fused: DataFrame, limit: int, per_source: int = PER_SOURCE) -> DataFrame:
    """The fused order, at most ``per_source`` of a source, cut at ``limit``, with markers from 1."""
    return top(capped(fused, "rrf", per_source), "rrf", limit, "marker").withColumn("found_by", found_by())


def search(chunks: DataFrame, question: str, vector: list[float] | None = None, limit: int = 8, per_source: int = PER_SOURCE, user: str | None = None, posts: DataFrame | None = None, report: DataFrame | None = None, total: DataFrame | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None, near: Callable[[list[float], int], DataFrame] | None = None) -> DataFrame:
    """Hits for a question: (marker, chunk_id, source_id, rrf, matched_terms, similarity, ranks, found_by) and the chunk's other columns.

    ``posts`` are the stored postings of all chunks, if there are any. Which terms are kept is
    decided within the plan, unless ``report``, a result of ``analyse_terms``, says so. Without a vector the ranking is lexical, without terms it is by vector.
    ``fetch`` adds the chunks' other columns to the hits where a store can do so without a scan.
    ``near`` finds the tenant's nearest passages, as ``VectorBlocks.nearest`` does, in place of the scan.
    """
    seen = visible(chunks, user)
    asked = T.terms_of(question)
    lex = None
    if asked:
        held = postings(seen, asked) if posts is None else visible(posts, user).where(F.col("term").isin(*asked))
        kept = (analyse_terms(seen, asked, held, total=total) if report is None else report).where("kept")
        lex = lexical_pool(seen, kept, limit, per_source, held)
    vec = semantic_pool(seen, vector, limit, per_source, near) if vector is not None else None
    if lex is None and vec is None:
        return fuse(lexical_pool(seen, [], limit), None).where("false").withColumn("marker", F.lit(0)).withColumn("found_by", F.lit(""))
    hits = finalists(fuse(lex, vec), limit, per_source)
    if fetch is not None:
        return fetch(hits)
    rest = [c for c in chunks.columns if c not in hits.columns and c not in ("embedding", "norm")]
    return hits.join(seen.select("chunk_id", *rest), "chunk_id")


def top_each(ranked: DataFrame, score: str, n: int, rank: str) -> DataFrame:
    """The best ``n`` of each question (qid), with their place from 1."""
    best = Window.partitionBy("qid").orderBy(F.desc(score), "chunk_id")
    return ranked.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= n)


#: So many rows of questions' terms at most are sent to the executors, so that postings stay where they are read; beyond, both are dealt by term.
SENT_TERMS = 50_000


def few(terms: DataFrame) -> bool:
    return terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS


def asked_terms(questions: DataFrame, stems: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, term) of all questions. ``stems`` puts stems in place of words; words of one question that share a stem are a row each."""
    asked = questions.select("qid", F.explode(T.query_terms(F.col("question"))).alias("term"))
    return asked if stems is None else stems(asked).select("qid", "term")


def _kept_terms(asked: DataFrame, posts: DataFrame, total: DataFrame, max_df: float = MAX_DOC_FREQ) -> DataFrame:
    """The rows of ``asked`` (qid, term) whose term is kept: each distinct term is looked up and judged once."""
    judged = doc_freq(posts).join(F.broadcast(total)).where(F.col("df") / F.col("total") <= max_df)  # one row
    return asked.join(judged.select("term"), "term")


def _similar(chunks: DataFrame, block: list, window: int) -> DataFrame:
    """(qid, chunk_id, source_id, similarity): for each question of the block the ``window`` nearest passages of each task.

    The products run over a block of questions and an Arrow batch of passages at once, dimension
    by dimension, so that sums are the same as those of a single search.
    """
    import numpy as np
    import pyarrow as pa

    qids, matrix = np.array([r.qid for r in block]), np.array([r.vector for r in block], float)

    def dots(a, b):
        out = np.zeros((len(a), len(b)))
        for d in range(a.shape[1]):
            out += a[:, d, None] * b[None, :, d]
        return out

    def norms(m):
        out = np.zeros(len(m))
        for d in range(m.shape[1]):
            out += m[:, d] * m[:, d]
        return np.sqrt(out)

    lengths, wide = norms(matrix), matrix.shape[1]

    def run(batches):
        ids, sources = np.zeros(0, np.int64), np.zeros(0, object)
        held = [(ids, sources, np.zeros(0))] * len(qids)
        for batch in batches:
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, wide)
            ids, sources = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            with np.errstate(divide="ignore", invalid="ignore"):
                alike = np.round(dots(matrix, vectors) / (lengths[:, None] * norms(vectors)[None, :]), 9)
            for i, row in enumerate(alike):
                near = np.flatnonzero(~np.isnan(row))
                if len(near) > window:  # those below the window's last are never in it, those equal to it may be
                    near = near[row[near] >= -np.partition(-row[near], window - 1)[window - 1]]
                both = [np.concatenate(x) for x in zip(held[i], (ids[near], sources[near], row[near]), strict=True)]
                order = np.lexsort((both[0], -both[2]))[:window]
                held[i] = tuple(x[order] for x in both)
        counts = [len(h[0]) for h in held]
        columns = [np.repeat(qids, counts), *(np.concatenate(x) for x in zip(*held, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], out.names)

    rows = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") == wide)).select("chunk_id", "source_id", "embedding")
    source = rows.schema["source_id"].dataType
    schema = f"qid long, chunk_id long, source_id {source.simpleString()}, similarity double"
    out = pa.schema([("qid", pa.int64()), ("chunk_id", pa.int64()), ("source_id", pa.string() if source.simpleString() == "string" else pa.int64()), ("similarity", pa.float64())])
    return rows.mapInArrow(run, schema)


QUESTION_BLOCK = 512


def semantic_many(chunks: DataFrame, questions: DataFrame, limit: int, per_source: int = PER_SOURCE, block: int = QUESTION_BLOCK) -> DataFrame | None:
    """(qid, chunk_id, source_id, similarity, vector_rank): every question's pool of nearest passages, exact.

    Questions (qid, question, vector) go over the passages in blocks, as many vectors at a time as
    ``block`` says, which bounds what a task is sent.
    """
    window, parts = SCAN_FACTOR * pool_size(limit), []
    vectors = questions.where(F.col("vector").isNotNull()).select("qid", "vector").toLocalIterator()
    held: list = []
    for row in vectors:
        held.append(row)
        if len(held) == block:
            parts, held = [*parts, _similar(chunks, held, window)], []
    if held:
        parts.append(_similar(chunks, held, window))
    if not parts:
        return None
    near = functools.reduce(DataFrame.unionByName, parts)
    near = top_each(near, "similarity", window, "place").drop("place")
    return top_each(capped(near, "similarity", 2 * per_source, "qid"), "similarity", pool_size(limit), "vector_rank")


def lexical_many(questions: DataFrame, posts: DataFrame, total: DataFrame, limit: int, per_source: int = PER_SOURCE, stems: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, chunk_id, source_id, matched_terms, score, lexical_rank): every question's pool of passages by words.

    Terms of too many passages are dropped before postings are met, so none brings more than its share of the corpus.
    """
    asked = asked_terms(questions, stems)
    beside = F.broadcast if few(asked) else lambda terms: terms
    found = posts.join(beside(asked.select("term").distinct()), "term", "left_semi")
    met = posts.join(beside(_kept_terms(asked, found, total)), "term")
    scored = met.groupBy("qid", "chunk_id", "source_id").agg(F.count(F.lit(1)).alias("matched_terms"), F.sum("tf").alias("n"))
    scored = scored.select("qid", "chunk_id", "source_id", "matched_terms", (F.lit(0.1) * F.col("n") * F.col("matched_terms")).alias("score"))
    return top_each(capped(scored, "score", 2 * per_source, "qid"), "score", pool_size(limit), "lexical_rank")


def search_many(chunks: DataFrame, questions: DataFrame, limit: int = 8, per_source: int = PER_SOURCE, user: str | None = None, posts: DataFrame | None = None, total: DataFrame | None = None, stems: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The hits of all ``questions`` (qid, question, vector) in one plan: (qid, marker, chunk_id, source_id, ranks, rrf, found_by, ...).

    Each question's hits are those that ``search`` gives it alone. A question without a kept term
    is searched by its vector, one without a vector by its words, one with neither has no hits.
    With ``stems`` (``stems.asked_stems``) ``posts`` must be stemmed postings.
    """
    seen = visible(chunks, user)
    held = postings(seen) if posts is None else visible(posts, user)
    lex = lexical_many(questions, held, visible_total(seen) if total is None else total, limit, per_source, stems)
    vec = semantic_many(seen, questions, limit, per_source)
    if vec is None:
        vec = lex.where("false").select("qid", "chunk_id", "source_id", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("vector_rank"))
    right = vec.select("qid", "chunk_id", F.col("source_id").alias("__s"), "similarity", "vector_rank")
    both = lex.join(right, ["qid", "chunk_id"], "full_outer").withColumn("source_id", F.coalesce("source_id", "__s"))
    part = lambda rank: F.coalesce(1.0 / (RRF_K + F.col(rank)), F.lit(0.0))
    fused = both.select(
        "qid", "chunk_id", "source_id", F.coalesce("matched_terms", F.lit(0)).alias("matched_terms"), F.coalesce("score", F.lit(0.0)).alias("score"), "similarity",
        "lexical_rank", "vector_rank", F.round(part("lexical_rank") + part("vector_rank"), 12).alias("rrf"),
    )
    return top_each(capped(fused, "rrf", per_source, "qid"), "rrf", limit, "marker").withColumn("found_by", found_by())


def abstains_many(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, hits, best_matched, best_similarity, abstained) of every question, those without a hit too."""
    facts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.max("matched_terms").alias("best_matched"), F.max("similarity").alias("best_similarity"))
    out = questions.select("qid").join(facts, "qid", "left").fillna(0, ["hits", "best_matched"])
    stands = (F.col("best_matched") >= MIN_MATCHED) | F.coalesce(F.col("best_similarity") >= MIN_SIMILARITY, F.lit(False))
    return out.withColumn("abstained", (F.col("hits") < 1) | ~stands)


def search_traced(chunks: DataFrame, question: str, vector: list[float] | None = None, limit: int = 8, *, user: str | None = None, posts: DataFrame | None = None, total: DataFrame | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, report): the terms are analysed once, and the search goes by that report, a table of a row for each term."""
    asked, spark = T.terms_of(question), chunks.sparkSession
    found = analyse_terms(visible(chunks, user), asked, None if posts is None else visible(posts, user), total=total)
    report = spark.createDataFrame(found.orderBy("pos").collect(), found.schema)
    return search(chunks, question, vector, limit, user=user, posts=posts, report=report, fetch=fetch), report


def best_similarity(hits: DataFrame) -> DataFrame:
    return hits.agg(F.max("similarity").alias("best_similarity"))


def abstains(hits: DataFrame) -> DataFrame:
    """One row: what the decision rests on, and whether to refuse."""
    facts = hits.agg(F.count(F.lit(1)).alias("hits"), F.coalesce(F.max("matched_terms"), F.lit(0)).alias("best_matched"), F.max("similarity").alias("best_similarity"))
    stands = (F.col("best_matched") >= MIN_MATCHED) | F.coalesce(F.col("best_similarity") >= MIN_SIMILARITY, F.lit(False))
    return facts.withColumn("abstained", (F.col("hits") < 1) | ~stands)
