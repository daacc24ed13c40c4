"""Command line over a folder of tables: ``python -m sediment ask|search|stats|manifest|ingest|verify|record``."""

from __future__ import annotations

import argparse
import json

from .session import get_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sediment", description=__doc__)
    parser.add_argument("command", choices=["ask", "search", "stats", "manifest", "ingest", "verify", "record"])
    parser.add_argument("words", nargs="*", help="the question, or the manifests' paths")
    parser.add_argument("--tables", help="folder of Parquet tables")
    parser.add_argument("--limit", type=int, default=6)
    parser.add_argument("--user")
    parser.add_argument("--kind", action="append")
    parser.add_argument("--store", help="folder of stored tables, for ingest; of recordings, for record")
    parser.add_argument("--fetched", help="Parquet table of fetched pages (url, http_status, text, error), for verify and ingest")
    parser.add_argument("--source", help="take in only this url")
    parser.add_argument("--first", type=int, help="take in so many of the manifests' sources")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    spark = get_session("sediment")
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "manifest":
        from .sources import manifest

        sources, denied = manifest.load(spark, *args.words)
        manifest.select(sources, kinds=args.kind).select("url", "kind", "title").show(1000, False)
        denied.show(1000, False)
        return 0
    if args.command == "verify":
        from .operators import verify
        from .sources import manifest

        checked = verify.verified(manifest.load(spark, *args.words)[0], spark.read.parquet(args.fetched))
        checked.select("url", "kind", "ok", "status", "detail").show(1000, False)
        return 1 if checked.where("not ok").limit(1).count() else 0
    from .api import Engine

    if args.command == "ingest":
        return _ingest(spark, args)
    from .sources import index, tables

    if args.tables:
        held = index.of(spark, args.tables)
        engine = Engine(spark, tables.sources(spark, args.tables), held.chunks, postings=held.postings)
    else:
        engine = Engine.stored(spark, args.store)
    if args.command == "stats":
        engine.stats().show()
    elif args.command == "search":
        engine.search(" ".join(args.words), args.limit, args.user).orderBy("marker").select("marker", "title", "url", "matched_terms", "found_by").show(args.limit, False)
    elif args.command == "record":
        from .sources import recordings

        given = engine.ask(" ".join(args.words), args.limit, args.user)
        recordings.write(spark.read.json(spark.sparkContext.parallelize([json.dumps(given, ensure_ascii=False)])), args.store, args.user)
    else:
        print(json.dumps(engine.ask(" ".join(args.words), args.limit, args.user), indent=2, ensure_ascii=False))
    return 0


def _ingest(spark, args) -> int:
    """Takes the manifests' fetched pages into the store in one commit, and shows the report."""
    from pyspark.sql import functions as F

    from .api import Engine
    from .sources import manifest

    wanted = manifest.select(manifest.load(spark, *args.words)[0], kinds=args.kind)
    if args.source:
        wanted = wanted.where(F.col("url") == args.source)
    if args.first:
        wanted = wanted.orderBy("file", "pos").limit(args.first)
    fetched = spark.read.parquet(args.fetched)
    failed = F.when(F.col("http_status") >= 400, F.concat(F.lit("http "), F.col("http_status").cast("string"))) if "http_status" in fetched.columns else F.lit(None).cast("string")
    kept = [c for c in ("raw_segments", "transcript_kind") if c in fetched.columns]
    pages = fetched.select("url", F.col("text").alias("raw_text"), F.coalesce("error", failed).alias("error"), *kept)
    new = wanted.join(pages, "url", "left").withColumn("owner", F.lit(args.user or "public"))
    missing = F.col("raw_text").isNull() & (F.col("raw_segments").isNull() if "raw_segments" in kept else F.lit(True))
    new = new.withColumn("error", F.coalesce("error", F.when(missing, "not fetched")))
    Engine.stored(spark, args.store).ingest(new, dry_run=args.dry_run).show(100, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
