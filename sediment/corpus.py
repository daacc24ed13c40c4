"""A stored corpus: sources, passages, postings and fingerprints, which an ingestion changes together.

* ``sources`` are bucketed by (owner, url), ``chunks`` by their source: an ingestion rewrites the
  buckets that hold its sources.
* ``postings`` (term, chunk_id, source_id, owner, tf) is a log: new and changed passages are one
  segment, and changed and removed ones get a tombstone.
* ``vectors`` (chunk_id, embedding, embedding_model) is a log of what an embedding pass has made.
* ``calls`` is a log of model calls with their cost, in order of time, and ``ledger`` of migrations.
* ``shingles`` (h, id, owner, p, k, n) is a log of the sources' sketches, hash by hash, each in one place: a changed
  source meets stored ones on its own hashes, and no other source is sketched again.

Flags of duplicates follow the texts: a source whose passages change is compared anew and may lose
its flag, and so is one that was flagged as a copy of a source that has changed. Among the changed
ones the order is that of identifiers; against all others what they are flagged as decides.
"""

from __future__ import annotations

import contextlib
import datetime
import logging
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.text import hash60, word_count
from .io import beside, discard, size_of, written
from .operators import chunker, dedupe, embedding, ingest, merge, retrieval, telemetry
from .store import Change, Store

POSTINGS = "term string, chunk_id long, source_id long, owner string, tf long"
VECTORS = "chunk_id long, embedding array<float>, embedding_model string"
CALLS = "created_at timestamp, model string, operation string, tokens_in long, tokens_out long, latency_ms long, cost_usd double, error string"
LEDGER = "version int, applied_at timestamp"
KEYS = {"sources": ("owner", "url"), "chunks": ("source_id",)}
SHINGLES = "h long, id long, owner string, p int, k int, n int"
#: A table's buckets are rewritten in rounds, each of about so many bytes of new sources, in so many at most.
ROUND_BYTES, ROUNDS = 16 << 20, 16


class Corpus:
    """The corpus in a folder. Its frames are those of the last commit that it has read."""

    def __init__(self, spark: SparkSession, path: str, **options):
        self.spark, self.store = spark, Store(spark, path, **options)

    # ---------------------------------------------------------------- what is stored

    @property
    def sources(self) -> DataFrame:
        return self.store.read("sources", schema.schema("sources"))

    def passages(self, buckets: list[int] | None = None) -> DataFrame:
        return self.store.read("chunks", schema.schema("chunks"), buckets=buckets)

    def _known(self) -> DataFrame:
        return self.sources.select(F.col("id").alias("source_id"), "owner", "duplicate_of", "title", "url", "transcript_kind")

    @property
    def chunks(self) -> DataFrame:
        """Passages with their vectors, and with what search needs of their source: owner, flag, title, url."""
        bare = self.passages().withColumnRenamed("id", "chunk_id").drop("embedding", "embedding_model")
        return bare.join(self.vectors, "chunk_id", "left").join(self._known(), "source_id")

    @property
    def vectors(self) -> DataFrame:
        return self.store.live("vectors", VECTORS, "chunk_id").drop("seg")

    @property
    def calls(self) -> DataFrame:
        return self.store.rows("calls", CALLS).drop("seg")

    @property
    def pending(self) -> DataFrame:
        """Passages (id, content) without a vector."""
        return self.passages().select("id", "content").join(self.vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")

    @property
    def postings(self) -> DataFrame:
        """Postings of all passages as they are now, with their source's flag."""
        flagged = self.sources.where("duplicate_of is not null").select(F.col("id").alias("source_id"), "duplicate_of")
        return self.store.live("postings", POSTINGS, "chunk_id").drop("seg").join(flagged, "source_id", "left")

    def total(self, user: str | None = None) -> DataFrame:
        """One row: the number of passages that the tenant sees, at least 1, from the sources' counts."""
        seen = retrieval.visible(self.sources, user)
        return seen.agg(F.greatest(F.coalesce(F.sum("chunk_count"), F.lit(0)), F.lit(1)).cast("long").alias("total"))

    def fetch(self, hits: DataFrame) -> DataFrame:
        """``hits``, as few as a limit says, with their passages' and sources' columns: only the buckets that hold them are read."""
        rows = hits.collect()
        ids = sorted({r.source_id for r in rows})
        keys = self.spark.createDataFrame([(i,) for i in ids], "source_id long")
        buckets = [r[0] for r in keys.select(self.store.bucket("source_id")).distinct().collect()]
        held = self.passages(buckets).where(F.col("source_id").isin(ids)).withColumnRenamed("id", "chunk_id").drop("embedding")
        small = F.broadcast(self.spark.createDataFrame(rows, hits.schema))  # at most the limit
        return held.join(small, ["chunk_id", "source_id"]).join(self._known().where(F.col("source_id").isin(ids)), "source_id")

    # ---------------------------------------------------------------- search

    def search(self, question: str, vector: list[float] | None = None, limit: int = 8, user: str | None = None, **options) -> DataFrame:
        return retrieval.search(self.chunks, question, vector, limit, user=user, posts=self.postings, total=self.total(user), fetch=self.fetch, **options)

    # ---------------------------------------------------------------- ingestion

    def _identified(self, new: DataFrame) -> DataFrame:
        """``new`` in the stored columns and those of a fetch, each source with its stored identifier, its own, or one of owner and url."""
        held = self.sources.select("owner", "url", F.col("id").alias("__held"))
        own = F.col("id") if "id" in new.columns else F.lit(None).cast("long")
        out = new if "owner" in new.columns else new.withColumn("owner", F.lit("public"))
        out = out.withColumn("owner", F.coalesce("owner", F.lit("public")))
        out = out.withColumn("id", own.cast("long")).join(held, ["owner", "url"], "left")
        out = out.withColumn("id", F.coalesce("__held", "id", F.xxhash64("owner", "url"))).drop("__held")
        kinds = {f.name: f.dataType for f in schema.schema("sources").fields}
        keep = [c for c in out.columns if c in kinds or c == "error"]
        out = out.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in keep])
        for c in ("raw_text", "raw_segments", "kind"):
            if c not in keep:
                out = out.withColumn(c, F.lit(None).cast(kinds[c]))
        return out

    def _prints(self, chunks: DataFrame, changed: DataFrame) -> DataFrame:
        """(id, owner, url, chunk_count, sketch, n) of changed (id, owner, url) sources, of all their passages; a text without a word has no sketch."""
        mine = chunks.join(changed.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        counted = mine.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        texts = dedupe.chunk_texts(mine).where(F.lower("raw_text").rlike("[a-z0-9]"))
        return changed.join(counted, "id", "left").join(dedupe.sketches(texts), "id", "left").fillna(0, ["chunk_count"])

    def _flags(self, probes: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
        """(id, duplicate_of, score) of ``probes`` (id, owner, sketch, n) that have an original among what ``shingles`` hold."""
        asked = dedupe.places(probes.where("sketch is not null"))
        again = probes.select(F.col("id").alias("__again"))
        unflagged = self.sources.where("duplicate_of is not null").select(F.col("id").alias("id")).join(again, F.col("id") == F.col("__again"), "left_anti")
        met = shingles.join(unflagged, "id", "left_anti").join(again, F.col("id") == F.col("__again"), "left")
        sees = (F.col("x.owner") == "public") | (F.col("x.owner") == F.col("y.owner"))
        before = F.when(F.col("x.__again").isNull(), F.col("x.id") != F.col("y.id")).otherwise(F.col("x.id") < F.col("y.id"))
        pairs = written(dedupe.scored_met(met, asked, before & sees, threshold), "pairs")
        if not pairs.limit(1).count():
            return pairs.select(F.col("b").alias("id"), F.col("a").alias("duplicate_of"), "score")
        return dedupe.resolve(pairs, lambda df: written(df, "rounds"))

    def ingest(self, new: DataFrame, *, dry_run: bool = False, flag: bool = True, threshold: float = dedupe.THRESHOLD, **options) -> DataFrame:
        """Takes in sources (url, owner, kind, title, raw_text, raw_segments, error, ...) in one commit; returns the report (outcome, n).

        Of several rows of one owner and url the last by identifier and text is taken. What is merged are
        the passages' hashes; texts are read where they are written, and what an ingestion wrote for itself goes as soon as
        nothing reads it.
        """
        change = self.store.begin()
        store = self.store
        new = self._identified(new)
        keep = F.row_number().over(retrieval.Window.partitionBy("owner", "url").orderBy(F.desc("id"), F.desc_nulls_last("raw_text")))
        judged = written(ingest.judged(new.withColumn("__rn", keep).where("__rn = 1").drop("__rn")), "judged")
        fresh = chunker.chunk_sources(judged.where("outcome is null"), **options).drop("cues", "tokenizer")
        fresh = written(fresh.withColumn("id", hash60(F.concat_ws(":", "source_id", "chunk_index"))), "passages")
        decided = written(ingest.outcomes(judged, fresh), "outcomes")
        touched = [r[0] for r in fresh.select(store.bucket("source_id")).distinct().collect()]
        names = ["source_id", "chunk_index", "id", "content_hash"]
        merged = written(merge.merge_chunks(self.passages(touched).select(*names), fresh.select(*names)), "merged")
        if dry_run:
            return self._told(decided, merged, None, judged, fresh)
        nothing = written(decided.where("outcome = 'no content'").select("id"), "nothing")
        let_in = judged.where("outcome is null").join(beside(nothing), "id", "left_anti").drop("outcome", "error")
        keys = judged.select("id", "owner", "url")
        changed = merged.where("action <> 'keep'").select(F.col("source_id").alias("id")).distinct().join(keys, "id")
        done = {r["action"]: r["count"] for r in merged.groupBy("action").count().collect()}
        prints = written(self._prints(fresh, changed), "prints")  # all passages of a source that has changed are fresh ones
        flags, again, rounds = None, prints.select("id"), max(1, min(ROUNDS, -(-size_of(judged) // ROUND_BYTES)))
        if set(done) - {"keep"}:
            come, stay = self._moves(fresh, merged, set(done) <= {"insert"})
            self._log(change, come, merged, keys.select("id", "owner"), prints, bool(done.get("update") or done.get("delete")))
            after = lambda part: stay(self.passages(part)).unionByName(schema.migrate(come.where(store.bucket("source_id").isin(part)), "chunks"))
            change.replace("chunks", after, touched, "source_id", rounds=min(rounds, len(touched)))
        discard(fresh)
        if flag and set(done) - {"keep"}:
            copies = self.sources.select("id", "owner", F.col("shingle_sketch").alias("sketch"), F.col("shingle_count").alias("n"), "duplicate_of")
            copies = copies.join(prints.select(F.col("id").alias("duplicate_of")), "duplicate_of", "left_semi").join(prints, "id", "left_anti")
            probes = written(prints.select("id", "owner", "sketch", "n").unionByName(copies.select("id", "owner", "sketch", "n")), "probes")
            flags = written(self._flags(probes, change._view().live("shingles", SHINGLES, "id").drop("seg"), threshold), "flags")
            again = probes.select("id")
        self._sources(change, let_in, prints, flags, again, rounds)
        change.commit()
        told = self._told(decided, merged, flags, judged, prints, nothing)
        self.compact()
        return told

    def _told(self, decided: DataFrame, merged: DataFrame, flags: DataFrame | None, *read: DataFrame) -> DataFrame:
        """The report as a table; the tables that it was made of, and others that were read, are discarded."""
        told = written(ingest.report(decided, merged, flags), "report")
        discard(decided, merged, *read)
        return told

    def _moves(self, fresh: DataFrame, merged: DataFrame, all_new: bool) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """The passages of ``fresh`` that are inserted or updated, and what leaves of stored ones those that stay."""
        if all_new:
            return fresh, lambda old: old
        keys = ["source_id", "chunk_index"]
        some = lambda actions, name: beside(written(merged.where(F.col("action").isin(*actions)).select(*keys), name))
        come, gone = some(("insert", "update"), "come"), some(("update", "delete"), "gone")
        return fresh.join(come, keys, "left_semi"), lambda old: old.join(gone, keys, "left_anti")

    def _log(self, change: Change, come: DataFrame, merged: DataFrame, owners: DataFrame, prints: DataFrame, replaces: bool) -> None:
        """Postings and shingles of what has changed, and tombstones for what they replace."""
        if replaces:
            for log in ("postings", "vectors"):
                change.end(log, merged.where("action in ('update', 'delete')").select("id"))
            change.end("shingles", self.sources.where("shingle_sketch is not null").select("id").join(prints, "id", "left_semi"))
        added = come.select(F.col("id").alias("chunk_id"), "source_id", "content")
        added = added.join(owners.select(F.col("id").alias("source_id"), "owner"), "source_id").withColumn("duplicate_of", F.lit(None).cast("long"))
        change.append("postings", retrieval.postings(added).select(*[c.split()[0] for c in POSTINGS.split(", ")]), ["term", "chunk_id"])
        change.append("shingles", dedupe.places(prints.where("sketch is not null")).select(*[c.split()[0] for c in SHINGLES.split(", ")]), ["id", "p"])

    def _sources(self, change: Change, let_in: DataFrame, prints: DataFrame, flags: DataFrame | None, again: DataFrame, rounds: int) -> None:
        """The buckets of sources that were let in, or whose flag was looked at, after the change."""
        keys = let_in.select("owner", "url").unionByName(self.sources.join(again, "id", "left_semi").select("owner", "url"))
        touched = [r[0] for r in keys.select(self.store.bucket("owner", "url")).distinct().collect()]
        if touched:
            change.replace("sources", lambda part: self._upserted(let_in, prints, flags, again, part), touched, "owner", "url", rounds=min(rounds, len(touched)))

    def _upserted(self, let_in: DataFrame, prints: DataFrame, flags: DataFrame | None, again: DataFrame, part: list[int]) -> DataFrame:
        """The sources of some buckets after the change."""
        let_in, prints = (df.where(self.store.bucket("owner", "url").isin(part)) for df in (let_in, prints))
        held = self.store.read("sources", schema.schema("sources"), buckets=part)
        up = merge.upsert_sources(held, let_in).drop("action", "shingle_sketch", "shingle_count", "chunk_count")
        kept = held.select("id", F.col("shingle_sketch").alias("__s"), F.col("shingle_count").alias("__n"), F.col("chunk_count").alias("__c"))
        up = up.join(kept, "id", "left").join(prints.select("id", "sketch", "n", "chunk_count", F.lit(True).alias("__new")), "id", "left")
        pick = lambda a, b, name: F.when(F.col("__new"), F.col(a)).otherwise(F.col(b)).alias(name)
        flag = F.col("duplicate_of")
        if flags is not None:
            up = up.join(again.withColumn("__again", F.lit(True)), "id", "left").join(flags.select("id", F.col("duplicate_of").alias("__of")), "id", "left")
            flag = F.when(F.col("__again"), F.col("__of")).otherwise(F.col("duplicate_of"))
        facts = [pick("sketch", "__s", "shingle_sketch"), pick("n", "__n", "shingle_count"), pick("chunk_count", "__c", "chunk_count"), flag.alias("duplicate_of")]
        made = {"shingle_sketch", "shingle_count", "chunk_count", "duplicate_of"}
        return up.select(*[c for c in held.columns if c not in made], *facts).select(*held.columns)

    def compact(self) -> dict[str, list[int]]:
        """Joins the logs' segments where enough of one level have come together; a commit of its own, if anything was joined."""
        change = self.store.begin()
        made = {"vectors": change.compacted("vectors", VECTORS, "chunk_id", ["chunk_id"]), "calls": change.compacted("calls", CALLS, "created_at", ["created_at"])}
        made |= {"postings": change.compacted("postings", POSTINGS, "chunk_id", ["term", "chunk_id"]), "shingles": change.compacted("shingles", SHINGLES, "id", ["id", "p"])}
        if any(made.values()):
            change.commit()
        return made

    # ---------------------------------------------------------------- model calls

    def _call(self, operation: str, model: str, tokens: tuple[int, int], began: float, cost: float | None, error: str | None = None) -> DataFrame:
        took = round(1000 * (time.perf_counter() - began))
        return self.spark.createDataFrame([(datetime.datetime.now(), model, operation, *tokens, took, cost, error)], CALLS)

    @contextlib.contextmanager
    def metered(self, operation: str, model: str, price: tuple[float, float] | None = None) -> Iterator[dict]:
        """Records a model call with its cost, whether it returns or raises; the caller sets tokens_in and tokens_out.

        A call that can't be recorded is logged and stops nobody.
        """
        facts, began = {"tokens_in": 0, "tokens_out": 0}, time.perf_counter()
        error = None
        try:
            yield facts
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            tokens = facts["tokens_in"], facts["tokens_out"]
            cost = None if price is None else (tokens[0] * price[0] + tokens[1] * price[1]) / 1_000_000
            try:
                change = self.store.begin()
                change.append("calls", self._call(operation, model, tokens, began, cost, error), ["created_at"])
                change.commit()
            except Exception:
                logging.getLogger("sediment.telemetry").exception("a call could not be recorded")

    def spent_today(self) -> float:
        return telemetry.spend_today(self.calls, F.current_timestamp()).first()[0]

    def backfill(self, embed: Callable[[list[str]], list[list[float]]], model: str, *, price: float = 0.0, budget_usd: float | None = None, batch: int = 64, max_batches: int | None = None) -> dict:
        """Gives passages without a vector one, batch by batch; returns {written, batches, pending, stopped}.

        What today's calls cost, of whatever kind, is read from the log before each batch, and the
        pass stops at the budget. A batch's vectors and its call are one commit, so a pass that
        stops, or dies, has written whole batches, and the next goes on from there. Batches hold
        about ``batch`` passages, by a hash of their identifier, which are embedded in the tasks.
        ``price`` is per million tokens, counted as words.
        """
        todo = written(self.pending, "pending")
        n = todo.count()
        groups = max(1, -(-n // batch))
        todo = written(todo.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")), "batches")
        done = {"written": 0, "batches": 0, "pending": n, "stopped": None}
        for number in sorted(r[0] for r in todo.select("batch").distinct().toLocalIterator()):
            if max_batches is not None and done["batches"] >= max_batches:
                return done | {"stopped": "batches"}
            if budget_usd is not None and not embedding.within_budget(self.spent_today(), budget_usd):
                return done | {"stopped": "budget"}
            mine, began = todo.where(F.col("batch") == number), time.perf_counter()
            tokens = mine.agg(F.sum(word_count(F.col("content")))).first()[0] or 0
            try:
                made = embedding.backfill(mine.withColumn("embedding", F.lit(None)), embed, model, keys=("id",), batch=batch)
                made = written(made.withColumnRenamed("id", "chunk_id"), "vectors")
            except Exception as e:
                with contextlib.suppress(Exception), self.metered("embed", model):
                    raise RuntimeError(type(e).__name__) from e
                raise
            change = self.store.begin()
            done["written"] += change.append("vectors", made, ["chunk_id"])
            change.append("calls", self._call("embed", model, (tokens, 0), began, tokens * price / 1_000_000), ["created_at"])
            change.commit()
            done["batches"] += 1
            done["pending"] = n - done["written"]
        self.compact()
        return done

    # ---------------------------------------------------------------- migrations

    def migrate(self) -> list[int]:
        """Brings stored tables to the latest schema, one version a commit, in order, each once; returns those applied now."""
        held = self.store.refresh().rows("ledger", LEDGER).select("version").collect()
        applied = []
        for version in sorted({v for v, _, _ in schema.VERSIONS} - {r.version for r in held}):
            change = self.store.begin()
            for table in {t for v, t, _ in schema.VERSIONS if v == version and t in KEYS and t in self.store.state["tables"]}:
                now = self.store.read(table)
                grown = schema.migrate(now, table, version) if len(now.columns) < len(schema.schema(table, version).fields) else now
                if grown is not now:
                    change.replace(table, grown, [int(b) for b in self.store.state["tables"][table]["folders"]], *KEYS[table])
            change.append("ledger", self.spark.createDataFrame([(version, datetime.datetime.now())], LEDGER), ["version"])
            change.commit()
            applied.append(version)
        return applied
