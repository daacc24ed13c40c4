"""The engine behind one object: ask, search, ingest, and look at cost and contents."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .corpus import Corpus
from .io import written
from .operators import answers, chunker, dedupe, embedding, ingest, merge, retrieval, telemetry
from .sources import recordings


class Engine:
    """A corpus: sources, chunks, and optionally recorded answers, an embedder for questions, stored postings of
    the chunks, and the model's price per million tokens in and out. With a stored ``corpus`` its tables are
    searched, and ingestion commits to it."""

    def __init__(self, spark: SparkSession, sources: DataFrame, chunks: DataFrame, *, recorded: DataFrame | None = None, embed: Callable[[str], list[float] | None] | None = None, complete: Callable[[str], tuple[str, int, int]] = answers.extractive, postings: DataFrame | None = None, price: tuple[float, float] | None = None, corpus: Corpus | None = None):
        self.corpus = corpus
        self.spark, self.sources, self.chunks, self.recorded, self.embed, self.complete = spark, sources, chunks, recorded, embed, complete
        self.postings, self.price = postings, price

    @classmethod
    def stored(cls, spark: SparkSession, path: str, **options) -> Engine:
        """The engine over a folder of stored tables, which need not be there yet."""
        corpus = Corpus(spark, path)
        return cls(spark, corpus.sources, corpus.chunks, postings=corpus.postings, corpus=corpus, **options)

    def _refreshed(self) -> None:
        """The frames of the corpus's last commit."""
        if self.corpus is not None:
            self.corpus.store.refresh()
            self.sources, self.chunks, self.postings = self.corpus.sources, self.corpus.chunks, self.corpus.postings

    def _stored(self, user: str | None) -> dict:
        """What a search is told of a stored corpus."""
        return {} if self.corpus is None else {"total": self.corpus.total(user), "fetch": self.corpus.fetch}

    def _completed(self, text: str) -> tuple[str, int, int]:
        """The model's answer; over a stored corpus the call is recorded, with its cost, also if it fails."""
        if self.corpus is None:
            return self.complete(text)
        with self.corpus.metered("answer", getattr(self.complete, "__name__", "model"), self.price) as facts:
            out, facts["tokens_in"], facts["tokens_out"] = self.complete(text)
        return out, facts["tokens_in"], facts["tokens_out"]

    def vector(self, question: str) -> list[float] | None:
        """The question's vector; without an embedder, or if it fails, search is lexical."""
        if self.embed is None:
            return None
        try:
            return self.embed(question)
        except Exception:
            import logging

            logging.getLogger("sediment").exception("the question could not be embedded")
            return None

    def search(self, question: str, limit: int = 8, user: str | None = None, semantic: bool = True) -> DataFrame:
        return retrieval.search(self.chunks, question, self.vector(question) if semantic else None, limit, user=user, posts=self.postings, **self._stored(user))

    def analyse(self, question: str, user: str | None = None) -> DataFrame:
        from .functions.terms import terms_of

        return retrieval.analyse_terms(retrieval.visible(self.chunks, user), terms_of(question))

    def ask(self, question: str, limit: int = 6, user: str | None = None, explain: bool = False) -> dict:
        """The response to a question: the recording of exactly this question and tenant, if there is one. ``explain`` adds the trace."""
        began = time.perf_counter()
        if self.recorded is not None:
            asked = self.spark.createDataFrame([(question, user)], "question string, user string")
            held = recordings.lookup(self.recorded, asked).first()["recorded"]
            if held is not None:
                return held.asDict(recursive=True) | {"cached": True}
        a = answers.ask(self.chunks, question, vector=self.vector(question), limit=limit, user=user, complete=self._completed, posts=self.postings, **self._stored(user))
        per_in, per_out = self.price or (None, None)
        place = lambda h: {"marker": h.marker, "title": h.title, "url": h.link, "timestamp": h.timestamp, "transcript_kind": getattr(h, "transcript_kind", None)}
        passages = [
            place(h) | {"matched_terms": h.matched_terms, "score": round(h.score, 4), "rrf": round(h.rrf, 4), "provenance": h.provenance or None, "similarity": None if h.similarity is None else round(h.similarity, 3), "used": h.marker in a.cited, "found_by": h.found_by}
            for h in a.hits
        ]
        return {
            "question": question, "answer": a.text, "abstained": a.abstained, "cached": False, "tokens_in": a.tokens_in, "tokens_out": a.tokens_out,
            "cost_usd": None if self.price is None else (a.tokens_in * per_in + a.tokens_out * per_out) / 1_000_000,
            "elapsed_ms": round(1000 * (time.perf_counter() - began)),
            "citations": [place(h) for h in a.cited.values()],
            "terms": [{"term": t, "doc_freq": 0, "kept": True} for t in a.kept] + [{"term": t, "doc_freq": n, "kept": False} for t, n in a.dropped],
            "passages": passages,
            "explain": {"passages_used": len(a.cited), "passages": len(passages), "terms_kept": len(a.kept), "steps": a.steps()},
            "trace": a.trace() if explain else None,
        }

    def ingest(self, new: DataFrame, *, dry_run: bool = False, flag: bool = True, **options) -> DataFrame:
        """Takes in sources (id, url, owner, kind, raw_text, raw_segments, error, ...) and returns the report (outcome, n).

        Rejected sources are left out; the others' passages are merged, the sources upserted, and
        duplicates among all sources flagged. A dry run judges and cuts, and changes nothing.
        """
        if self.corpus is not None:
            told = written(self.corpus.ingest(new, dry_run=dry_run, flag=flag, **options), "report")
            self._refreshed()
            return told
        judged = written(ingest.judged(new), "judged")
        fresh = written(chunker.chunk_sources(judged.where("outcome is null"), **options).drop("cues", "tokenizer"), "passages")
        decided = ingest.outcomes(judged, fresh)
        merged = written(merge.merge_chunks(self.chunks, fresh), "merged")
        if dry_run:
            return ingest.report(decided, merged, None)
        let_in = judged.join(decided.where("outcome = 'ingested'").select("id"), "id", "left_semi").select(*new.columns)
        self.chunks = written(merge.replaced(self.chunks, merged), "chunks")
        self.sources = written(merge.upsert_sources(self.sources, let_in).drop("action"), "sources")
        flags = None
        if flag:
            flags = written(self.find_duplicates(), "flags")
            self.sources = written(merge.mark_duplicates(self.sources, flags), "sources")
        return ingest.report(decided, merged, flags)

    def backfill(self, embed: Callable[[list[str]], list[list[float]]], model: str, *, spent_usd: float = 0.0, budget_usd: float | None = None, **options) -> DataFrame:
        """Gives passages without an embedding one, unless the budget is spent; returns what is left to do (one row).

        Over a stored corpus the pass is metered: see ``Corpus.backfill``, which takes the same options and a price.
        """
        if self.corpus is not None:
            done = self.corpus.backfill(embed, model, budget_usd=budget_usd, **options)
            self._refreshed()
            return self.spark.createDataFrame([(done["pending"],)], "pending long")
        if budget_usd is None or embedding.within_budget(spent_usd, budget_usd):
            keys = ("chunk_id",) if "chunk_id" in self.chunks.columns else ("source_id", "chunk_index")
            made = written(embedding.backfill(self.chunks, embed, model, keys=keys, **options), "embeddings")
            self.chunks = written(merge.write_embeddings(self.chunks, made, keys), "chunks")
        return embedding.pending(self.chunks).agg(F.count(F.lit(1)).alias("pending"))

    def live(self) -> dict:
        return {"status": "ok"}

    def ready(self) -> dict:
        """Whether the corpus can be read."""
        try:
            return {"status": "ok", "passages": bool(self.chunks.limit(1).count())}
        except Exception as e:  # whatever the store raises, the answer is that it is not ready
            return {"status": "unavailable", "detail": type(e).__name__}

    def find_duplicates(self, threshold: float = dedupe.THRESHOLD) -> DataFrame:
        """(id, duplicate_of, score) as ingestion in order of identifier would flag them; without an owner column all are public.

        What is compared is what is indexed: a source's passages in order, and its text only if it has
        none. A source without a word in either has no fingerprint and is nobody's duplicate.
        """
        owned = ["owner"] * ("owner" in self.sources.columns)
        texts = self.sources.select("id", *owned, F.col("raw_text").alias("__raw"))
        if {"source_id", "chunk_index", "content"} <= set(self.chunks.columns):
            texts = texts.join(dedupe.chunk_texts(self.chunks), "id", "left").withColumn("raw_text", F.coalesce("raw_text", "__raw"))
        else:
            texts = texts.withColumnRenamed("__raw", "raw_text")
        worded = texts.where(F.lower("raw_text").rlike("[a-z0-9]"))
        sketched = written(dedupe.sketches(worded, owner_col="owner" if owned else None), "sketches")
        return dedupe.resolve(written(dedupe.scored_pairs(sketched, threshold), "pairs"), lambda df: written(df, "rounds"))

    def stats(self) -> DataFrame:
        return telemetry.corpus_stats(self.sources, self.chunks, X.word_count(F.col("content")))

    def cost(self, calls: DataFrame, now: Column, budget: float) -> DataFrame:
        """One row: what today cost, the budget, and the day's latencies."""
        return telemetry.spend_today(calls, now).withColumn("budget_usd", F.lit(budget)).join(telemetry.latency(calls, now), F.lit(True))
