"""The queries ``opN_<name>`` over whole tables, and the SQL that DuckDB must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dominance, exact_dedup, mixing, ngram_join, packing, pieces, quality_rules, resampling, secret_scan, sharding, token_store, url_filter, warc
from .common import n_words, scratch, written


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    judged = quality_rules.quality_rules(docs, carry_text=False)
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", *[f"m_{m}" for m in quality_rules.MEASURES])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    docs = _documents(spark, sf_dir).select(
        "doc_id", "source", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
    )
    docs = written(docs, "shard-rows")
    out = sharding.interleaved_shards(docs, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], [F.col("doc_id"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_documents(spark, sf_dir).select("doc_id", "text"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), end_id=2)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return ngram_join.ngram_join(docs, carry_text=False).select("doc_id", "class_id", "class_size", "n_links", "kept")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write_store(_documents(spark, sf_dir), path, _tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_store.read_store(spark, path)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("seal"))
    docs = written(docs, "mix-rows")
    out = mixing.choose(docs, mixing.source_targets(docs), [F.col("doc_id"), F.col("seal")])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = warc.derivatives(pages)  # whole records, of which the query keeps their length and digest
    return out.withColumns({"record_bytes": F.octet_length("record").cast("long"), "record_sha256": F.sha2("record", 256)}).drop("record")


#: The rules (host, path, verdict) of the url query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in URL_RULES) + " AS rules(host, path, verdict)")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, carry_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _tokenizer("piece_bpe_32k.model")
    encoded = pieces.encode(_documents(spark, sf_dir).select("doc_id", "text"), model, end_id=2, carry_text=False)
    facts = encoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("end_byte"), F.crc32(F.array_join(F.col("ends").cast("array<string>"), " ").cast("binary")).alias("ends_crc32"),
    )
    out = pieces.decode(facts, model, carried=["doc_id", "n_tokens", "ids_sha256", "end_byte", "ends_crc32"])
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "end_byte", "ends_crc32")


def op12_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet")
    copies = 1 + F.pmod(F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))
    rows = sales.select("sale_id", dominance.day_slot(sales, "sold_at").alias("slot"), dominance.cents_level(F.col("total")).alias("level"), copies.alias("weight"))
    out = dominance.dominance(rows)
    return out.select("sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("w_above").alias("n_rows"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = resampling.resample(_documents(spark, sf_dir).select("doc_id", "text"), target)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_secret_scan": op3_secret_scan,
    "op4_packing": op4_packing,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_store": op6_token_store,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_dominance": op12_dominance,
    "op13_resampling": op13_resampling,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
