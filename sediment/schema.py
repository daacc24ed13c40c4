"""Schemas of the stored tables, by version: each version adds to the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENTS = "array<struct<text:string,start:double,duration:double>>"
#: Version, table, columns that it adds.
VERSIONS = [
    (1, "model_calls", "id bigint, created_at timestamp, model string, operation string, tokens_in int, tokens_out int, latency_ms int, cost_usd decimal(12,6), schema_valid boolean, repaired boolean, error string"),
    (2, "sources", f"id bigint, url string, kind string, title string, author string, license string, published_at date, note string, raw_text string, raw_segments {SEGMENTS}, transcript_kind string, fetched_at timestamp, created_at timestamp, metadata map<string,string>"),
    (2, "chunks", "id bigint, source_id bigint, chunk_index int, content string, content_hash string, token_count int, start_ts decimal(10,3), end_ts decimal(10,3), embedding array<float>, embedding_model string, metadata map<string,string>, created_at timestamp"),
    (3, "sources", "owner string, added_by string"),
    (4, "sources", "shingle_sketch array<bigint>, shingle_count int, duplicate_of bigint"),
    (5, "sources", "chunk_count int"),
]
DEFAULTS = {"owner": "public"}


def schema(table: str, version: int | None = None) -> T.StructType:
    """A table's columns at a version, the latest if none is given."""
    parts = [c for v, t, c in VERSIONS if t == table and (version is None or v <= version)]
    return T.StructType([f for p in parts for f in T.StructType.fromDDL(p).fields])


def migrate(df: DataFrame, table: str, version: int | None = None) -> DataFrame:
    """``df`` with the columns of a later version: those it lacks get their default, mostly null. Twice is as once."""
    out = df
    for f in schema(table, version).fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(DEFAULTS.get(f.name)).cast(f.dataType))
    return out.select(*[f.name for f in schema(table, version).fields])
