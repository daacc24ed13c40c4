"""Queries against their SQL at the smallest size, where the tables are there."""

import glob
import math
import os

import duckdb
import pytest

from sediment.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: Their SQL takes most of a minute even here.
SLOW = {"near_dup_pairs", "best_duplicate", "shingle_sketch"}
NAMES = sorted(set(catalog.oracle_sql()) - SLOW)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
    got = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
    assert sorted(columns) == names and ours == theirs


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_document_frequency_has_every_term(spark):
    rows = [tuple(r) for r in catalog.queries()["df_all_terms"](spark, FOLDER).select("term", "df").collect()]
    top = [tuple(r) for r in catalog.queries()["df_terms"](spark, FOLDER).select("term", "df").collect()]
    assert len(rows) > len(top) == 50 and sorted(rows, key=lambda r: (-r[1], r[0]))[:50] == top
