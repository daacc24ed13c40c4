"""Manifests of sources: JSON lists and Markdown pages of links, with the policy gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls

ITEM = "struct<url:string,kind:string,title:string,author:string,license:string,note:string>"
#: Kinds of sources, and the two forms of links in Markdown.
KINDS = ("talk", "book", "blog", "repo", "thread", "docs")
INLINE = r'\[([^\]]*)\]\(\s*(https?://[^\s)]+?)(?:\s+"([^"]*)")?\s*\)'
REFERENCE = r'(?m)^\[([^\]]+)\]:\s*(https?://\S+?)(?:\s+"([^"]*)")?\s*$'
COLUMNS = ["url", "kind", "title", "author", "license", "note", "manifest", "pos"]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Sources of JSON manifests."""
    return parse_json(spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("manifest"), "value"))


def parse_json(raw: DataFrame) -> DataFrame:
    """Sources of JSON texts (manifest, value): a list, or an object with a list named ``sources``."""
    listed = F.from_json("value", f"array<{ITEM}>")
    boxed = F.from_json("value", f"struct<sources:array<{ITEM}>>")["sources"]
    items = raw.select("manifest", F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(boxed)).alias("pos", "s"))
    kind = F.when(F.col("s.kind").isin(*KINDS), F.col("s.kind")).otherwise("blog")
    return items.select(
        urls.canonical_url(F.col("s.url")).alias("url"), kind.alias("kind"), F.coalesce(F.nullif("s.title", F.lit("")), "s.url").alias("title"),
        F.col("s.author").alias("author"), F.coalesce(F.nullif("s.license", F.lit("")), F.lit("public-web")).alias("license"), F.col("s.note").alias("note"), "manifest",
        F.col("pos").cast("long").alias("pos"),
    )


def links(text, pattern: str):
    """(label, url, description) of all matches, in order."""
    part = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return F.arrays_zip(part(1).alias("label"), part(2).alias("url"), part(3).alias("note"))


def parse_markdown(pages: DataFrame) -> DataFrame:
    """Sources of pages (manifest, value): inline links, then references; the first of each url, index pages left out."""
    found = None
    for rank, pattern in enumerate((INLINE, REFERENCE)):
        part = pages.select("manifest", F.lit(rank).alias("pass"), F.posexplode(links(F.col("value"), pattern)).alias("pos", "l"))
        found = part if found is None else found.unionByName(part)
    url = F.regexp_replace(F.regexp_replace(F.col("l.url"), ">+$", ""), ",+$", "")
    found = found.withColumn("url", urls.canonical_url(url)).where(~urls.is_index_page(F.col("url")))
    first = Window.partitionBy("manifest", "url").orderBy("pass", "pos")
    found = found.withColumn("__n", F.row_number().over(first)).where("__n = 1").withColumn("kind", urls.kind_of(F.col("url")))
    title = F.coalesce(F.nullif(F.trim("l.label"), F.lit("")), F.col("url"))
    return found.select(
        "url", "kind", title.alias("title"), F.lit(None).cast("string").alias("author"), urls.license_of(F.col("kind")).alias("license"),
        F.nullif(F.trim("l.note"), F.lit("")).alias("note"), "manifest", (F.col("pass") * 1_000_000_000 + F.col("pos")).cast("long").alias("pos"),
    )


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("manifest"), "value")
    return parse_markdown(raw)


def combine(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(sources, denied): manifests in order, the first of each url; what policy excludes is returned too."""
    every = None
    for rank, part in enumerate(parts):
        part = part.select(*COLUMNS).withColumn("file", F.lit(rank))
        every = part if every is None else every.unionByName(part)
    denied = every.where(urls.is_denied(F.col("url"))).select("url", "manifest")
    first = Window.partitionBy("url").orderBy("file", "pos")
    kept = every.where(~urls.is_denied(F.col("url"))).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept, denied


def load(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Every manifest, its parser chosen by its name."""
    return combine([read_json(spark, p) if p.endswith(".json") else read_markdown(spark, p) for p in paths])


def select(sources: DataFrame, only_url: str | None = None, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The manifest's filters, in this order: one url, kinds, the first few."""
    if only_url is not None:
        sources = sources.where(F.col("url") == only_url)
    if kinds:
        sources = sources.where(F.col("kind").isin(*kinds))
    return sources.orderBy("file", "pos").limit(limit) if limit is not None else sources
