"""The queries `*_whole` see the columns that their shorter forms leave out."""

from datetime import datetime

from __spark_entry__ import queries


def test_evidence_of_every_text_column(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.example.com/x", '<a href="http://10.9.8.7/in-html">y</a>')], "page_id long, url string, html string").write.parquet(
        f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "10.0.0.1", "en", "from 10.0.0.2", 8)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    pages = {r.value for r in queries()["network_evidence_pages_whole"](spark, str(tmp_path)).collect()}
    assert any("a.example.com" in v for v in pages) and any("10.9.8.7" in v for v in pages)
    assert {"10.0.0.1", "10.0.0.2"} <= {r.value for r in queries()["network_evidence_documents_whole"](spark, str(tmp_path)).collect()}


def events(spark, path, second):
    rows = [(1, datetime(2024, 1, 1, 0, 0, 1), 12, "view", '{"k": 1}'), (2, datetime(2024, 1, 1, 0, 0, second), 12, "view", '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_rows_that_differ_in_time_alone(spark, tmp_path):
    same, later = events(spark, tmp_path / "same", 1), events(spark, tmp_path / "later", 2)
    count, prints = queries()["duplicate_count_whole"], queries()["source_fingerprint_whole"]
    assert [count(spark, d).first().duplicate_count for d in (same, later)] == [1, 0]
    assert prints(spark, same).first().sha256 != prints(spark, later).first().sha256
