"""Page texts and their SQL decode the same references, whatever the page has beside them."""

import duckdb

from sediment.plans import catalog

PAGES = [
    "<h1>cut off &amp;&amp;&amp</h1><p>a&ampb &copy2 &am &a</p>", "&notin; &notit; &NotEqualTilde; &bogus; &amp;amp; &&amp&#;&#x;", "&#65;&#x41;&#x80;&#0;&#xD800;&#1;&#xfdd0;&#99999999999999999999;&#x00000000000000041;z",
    "hard space &amp; no other", "hard space &eacute; another&nbsp;", "a&#10;b&lt;p&gt;", "", None,
]


def test_every_reference_in_query_and_sql(spark, tmp_path):
    rows = [(i, f"https://a.example/{i}", page) for i, page in enumerate(PAGES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_to_text", "ingest_report"):
        df = catalog.queries()[name](spark, str(tmp_path))
        ours = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
        theirs = con.sql(catalog.oracle_sql()[name])
        assert ours == sorted(theirs.select(", ".join(sorted(theirs.columns))).fetchall(), key=repr), name
