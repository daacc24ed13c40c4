import duckdb  # noqa: F401  the oracle of the other tests must be importable

from sediment import schema
from sediment.sources import cache


def test_versions_add_columns_and_migration_is_idempotent(spark):
    assert "owner" not in schema.schema("sources", 2).names and "duplicate_of" in schema.schema("sources").names
    old = spark.createDataFrame([(1, "u")], "id long, url string")
    new = schema.migrate(old, "sources")
    assert new.first()["owner"] == "public" and new.schema == schema.migrate(new, "sources").schema
    assert schema.schema("chunks")["start_ts"].dataType.simpleString() == "decimal(10,3)"


def test_cache(spark):
    held = spark.createDataFrame([("x", None, "page"), ("y", "http 404", None)], "url string, error string, html string")
    held = cache.missing(held, spark.createDataFrame([], "cache_key string"))
    assert held.count() == 2 and len(held.first().cache_key) == 16
    assert cache.missing(spark.createDataFrame([("x",), ("z",)], "url string"), held).select("url").collect() == [("z",)]
    usable, rejects = cache.split(held)
    assert usable.first().html == "page" and rejects.first().reason == "http 404"
