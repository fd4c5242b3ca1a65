"""From files as they come to the results: readers, enrichment, the written table, the operators."""

import pytest
from pyspark.sql import functions as F

from causeway import schema as S
from causeway.operators import correlate, impact, incident, reports
from causeway.operators.enrich import enrich
from causeway.sources import files


def run_all(spark, df, path):
    reports.write_enriched(enrich(df), path)
    events = spark.read.parquet(path)
    row = incident.incident(events).first()
    assert impact.tag_sets(events).count() >= 0 and impact.anomaly_breakdown(events).count() >= 0
    assert correlate.cross_host_cascade(events, window_seconds=5.0).count() >= 0
    return events, row, reports.incident_summary(events).first()


def test_csv_files_with_columns_in_another_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("timestamp,host,level,message\n2024-01-01 00:00:01,h1,ERROR,out of memory\n")
    (tmp_path / "in" / "b.csv").write_text("host,message,level,timestamp\nh9,disk full,ERROR,2024-01-01 00:00:09\n")
    df = files.load_events(spark, str(tmp_path / "in"))
    assert sorted((r.timestamp, r.host, r.level, r.message) for r in df.collect()) == [
        ("2024-01-01 00:00:01", "h1", "ERROR", "out of memory"), ("2024-01-01 00:00:09", "h9", "ERROR", "disk full")]
    events, row, summary = run_all(spark, df, str(tmp_path / "out"))
    assert events.count() == 2 and row.root_host == "h1" and summary.total_events == 2
    assert events.select("event_id").distinct().count() == 2


def test_raw_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "app_log").write_text("2024-01-01 00:00:01,100 ERROR [a] (t) segfault\n\tat x\n2024-01-01 00:00:02,100 INFO [a] (t) ok\n")
    events = enrich(files.load_events(spark, str(tmp_path / "in")))
    assert [r.event_id.rsplit(":", 1)[1] for r in events.orderBy("event_id").collect()] == ["000000000000001", "000000000000002"]
    assert reports.timeline(events).count() >= 1


def test_lists_of_the_summary_are_whole(spark, events):
    rows = [(i, f"h{i:02d}", "ERROR", f"peer 10.0.0.{i} timeout") for i in range(45)]
    summary = reports.incident_summary(events(rows)).first()
    assert len(summary.recovery_timeline) == 45
    assert max(len(v) for v in summary.network_evidence.values()) == 45
    assert reports.flat_summary(reports.incident_summary(events(rows))).first().hosts_with_errors == 45


@pytest.mark.parametrize("text, want", [
    ("1/5/2024 03:04:05", "2024-01-05 03:04:05"), ("5-1-2024 3:04:05", "2024-01-05 03:04:05"), ("2024-1-5 3:4:5", "2024-01-05 03:04:05"),
    ("2024-01-05T03:04:05.25", "2024-01-05 03:04:05.25")])
def test_times_without_leading_zeros(spark, text, want):
    df = enrich(spark.createDataFrame([(1, text, "h", "ERROR", "x")], "event_id long, timestamp string, host string, log_level string, message string"))
    assert df.selectExpr("cast(_timestamp_parsed as string) as t").first().t == want


def test_duplicates_do_not_look_at_the_event_id(spark, events):
    assert impact.duplicate_count(events([(1, "h", "ERROR", "x"), (1, "h", "ERROR", "x"), (2, "h", "ERROR", "x")])).first().duplicate_count == 1


def test_a_table_without_ids_goes_through(spark):
    """Two enriched rows as another tool hands them over: no id, own columns of time, level and flags."""
    flags = [S.IS_ERROR, S.IS_WARNING, S.IS_ANOMALY, S.IS_RECOVERY]
    rows = [("2024-03-15T09:00:00Z", "web01", "ok login 10.0.0.5", "INFO", False, False, False, False, []),
            ("2024-03-15T09:00:10Z", "db01", "connection timeout to 10.0.0.9:5432", "ERROR", True, False, True, False, ["timeout"])]
    df = spark.createDataFrame(rows, f"_time string, host string, message string, _log_level string, {', '.join(f + ' boolean' for f in flags)}, _anomaly_tags array<string>")
    events = enrich(df.withColumn("_timestamp_parsed", F.to_timestamp("_time")))
    row, summary = incident.incident(events).first(), reports.incident_summary(events).first()
    assert (row.root_host, row.total_events, summary.total_events, summary.error_events) == ("db01", 2, 2, 1)
    assert [r.event_id.split(":")[1] for r in events.collect()] == ["000000000001"] * 2


def test_ids_from_contents_do_not_depend_on_the_packing(spark, monkeypatch):
    from causeway.sources import ids

    monkeypatch.setattr(ids, "CHUNK", 4)
    rows = [("a", None, [None, "x"], {"k": 1})] * 11 + [(None, "a", ["x", None], {"k": 1})] * 3 + [("b", "c", None, None), ("a", None, ["x", None], {"k": 2})]
    df = spark.createDataFrame(rows, "s string, t string, l array<string>, m map<string, int>")

    def found(parts):
        return sorted((r.event_id, str(r.s), str(r.t), str(r.l), str(r.m)) for r in ids.with_event_id(df.repartition(parts)).collect())

    one = found(1)
    assert one == found(7) and len({r[0] for r in one}) == len(rows) == 16
    assert sorted({r[0].split(":")[1] for r in one if r[1:3] == ("a", "None") and "None, 'x'" in r[3]}) == [f"{i:012d}" for i in range(1, 12)]
    assert ids.with_event_id(df.where("false")).count() == 0


def test_an_id_is_no_text(spark):
    """Ids of rows of files hold the file's path; its words are none of the events'."""
    row = ("file:/var/log/timeout/error.csv:000000000000002", "2024-03-15 09:00:00", "INFO", "all well")
    df = enrich(spark.createDataFrame([row], "event_id string, timestamp string, log_level string, message string"))
    assert df.first()["_anomaly_tags"] == []
