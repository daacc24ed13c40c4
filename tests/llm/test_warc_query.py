"""The archive query returns what stands for its whole records, bytes included."""

import hashlib

from sediment.llm import queries, warc


def test_the_query_has_the_records_it_describes(spark, tmp_path):
    rows = [(1, "https://a.example/", "<html lang=en><title>t</title><p>one &amp; two</p></html>"), (2, None, None), (3, "u", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {(i, k): (len(r), hashlib.sha256(r).hexdigest()) for i, u, p in rows for k, r in zip(("metadata", "conversion"), warc.derive(warc.response(u, p)), strict=True)}
    got = queries.op8_warc(spark, str(tmp_path))
    assert {(r.page_id, r.kind): (r.record_bytes, r.record_sha256) for r in got.collect()} == want and "record" not in got.columns
