import pytest
from pyspark.sql import functions as F

from causeway import schema as S
from causeway.functions import hosts, levels, text, times
from causeway.operators import enrich
from causeway.rules import DEFAULT_RULES


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("given, level, error, warning", [
    (" err ", "ERROR", True, False), ("Warn", "WARNING", False, True), ("SEVERE", "SEVERE", False, False),
    ("", "", False, False), ("notice", "NOTICE", False, True), ("\tfatal\n", "FATAL", True, False)])
def test_level_column(spark, given, level, error, warning):
    df = spark.createDataFrame([(1, given, "ERROR inside")], "event_id long, level string, message string")
    row = enrich.enrich_levels(df).first()
    assert (row[S.LEVEL], row[S.IS_ERROR], row[S.IS_WARNING]) == (level, error, warning)


def test_level_falls_back_to_the_first_word_left_to_right(spark):
    rows = [(1, None, "an info", "ERROR x"), (2, None, "errors", "nothing"), (3, None, None, "warn: x")]
    df = spark.createDataFrame(rows, "event_id long, level string, a string, b string")
    found = {r.event_id: r[S.LEVEL] for r in enrich.enrich_levels(df).collect()}
    assert found == {1: "INFO", 2: "UNKNOWN", 3: "WARNING"}


def test_rank(spark):
    names = {"critical": 7, "ALERT": 6, "ERR": 5, "WARNING": 4, "NOTICE": 3, "INFO": 2, "DEBUG": 1, "TRACE": 0, "??": -1}
    for name, rank in names.items():
        assert one(spark, levels.severity_rank(F.lit(name))) == rank


@pytest.mark.parametrize("message, tags, recovery", [
    ("service is not healthy", [], True), ("unhealthy", [], False),
    ("status 401 here", ["auth_fail"], False), ("code 4010", [], False),
    ("load average: 49", [], False), ("load average: 50", ["cpu_spike"], False),
    ("TIMED  OUT while kill process", ["oom_killer", "timeout"], False),
    ("connection pool reset by peer", ["pool_exhausted", "timeout"], False)])
def test_tags(events, message, tags, recovery):
    row = events([(0, "a", "INFO", message)]).first()
    assert row[S.TAGS] == tags and row[S.IS_RECOVERY] == recovery and row[S.IS_ANOMALY] == bool(tags)


def test_patterns_match_across_columns(spark):
    df = spark.createDataFrame([(1, "disk", "full")], "event_id long, a string, b string")
    assert enrich.enrich(df).first()[S.TAGS] == ["disk_full"]


def test_skipping_by_literals_changes_nothing(spark):
    texts = ["restart", "SYSTEMD x start", "oom", "out  of memory", "at a.b(", "x\tat y", "bug:", "max connections reached",
             "duplicate ack", "auth fail", "name resolution fail", "SSL error", "Call Trace:", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id long, message string")
    bare = DEFAULT_RULES.__class__(DEFAULT_RULES.patterns, DEFAULT_RULES.labels, DEFAULT_RULES.steps, {})
    columns = ["event_id", S.TAGS, S.IS_RECOVERY]
    assert enrich.enrich(df).select(columns).collect() == enrich.enrich(df, rules=bare).select(columns).collect()


def test_custom_rules_order():
    rules = DEFAULT_RULES.with_custom({"mine": "x", "segfault": "y"}, {"mine": "Mine"}, {"mine": ["a", "b"]})
    assert rules.tags[:2] == ("oom_killer", "segfault") and rules.tags[10] == "mine" and rules.tags[11] == "timeout"
    assert rules.patterns["segfault"] == "y" and rules.steps["mine"] == ("a", "b") and "segfault" not in rules.literals


def test_times(spark):
    us = 1_710_489_705_000_000
    assert one(spark, times.format_ts(F.lit(us))) == "2024-03-15T08:01:45Z"
    assert one(spark, times.format_ts(F.lit(us + 999_999))) == "2024-03-15T08:01:45.999Z"
    assert one(spark, times.format_ts(F.lit(us + 400))) == "2024-03-15T08:01:45.000Z"
    assert one(spark, times.format_ts(F.lit(None).cast("long"))) == "N/A"
    assert one(spark, times.format_duration(F.lit(75_999_999))) == "1m 15s"
    assert one(spark, times.format_duration(F.lit(-90_061_000_000))) == "25h 1m 1s"
    assert one(spark, times.format_relative(F.lit(us), F.lit(us))) == "08:01:45"
    assert one(spark, times.format_relative(F.lit(us), F.lit(us + 5_000_000))) == "08:01:45 (T-5s)"
    assert one(spark, times.floor_div(F.lit(-1), 10)) == -1


def test_texts(spark):
    raw = "id 3f2504e0-4f89-11d3-9a0c-0305e82c3301 at 10.0.0.1 0xFF 42 v42 "
    assert one(spark, text.normalize_message(F.lit(raw))) == "id <N> at <N> <N> <N> v42"
    assert one(spark, text.table_cell(F.lit("a|b\nc" + "x" * 200))) == "a¦b c" + "x" * 95
    assert one(spark, text.clip_marked(F.lit("x" * 501))) == "x" * 500 + "…[troncato]"
    assert one(spark, text.clip_marked(F.lit("x" * 500))) == "x" * 500


@pytest.mark.parametrize("url, kind", [
    ("http://127.0.0.1:11434/x", "internal"), ("http://192.168.1.10:1/x", "internal"), ("http://8.8.8.8/x", "external"),
    ("http://printer.local/", "internal"), ("https://localhost/a", "internal"), ("http://172.32.0.1/", "external"),
    ("http://172.31.0.1/", "internal"), ("http://[::1]/", "internal"), ("http://[2001:4860::1]/", "external"),
    ("not a url", "external"), ("http://10.0.0.300/", "external"), (None, "external")])
def test_host_class(spark, url, kind):
    assert one(spark, hosts.host_class(hosts.url_host(F.lit(url).cast("string")))) == kind


def test_time_range_includes_both_ends(events):
    df = events([(0, "a", "INFO", "x"), (1, "a", "INFO", "x"), (2, "a", "INFO", "x"), (None, "a", "INFO", "x")])
    got = enrich.time_range(df, "timestamp", "2024-03-15 08:00:00", "2024-03-15 08:00:01")
    assert got.count() == 2 and enrich.time_range(df, "timestamp", until="2024-03-16").count() == 3


def test_short_durations_before_the_base_are_cut_towards_zero(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    # 999,999,001 and 1,000,000,000 microseconds before 2024-01-11 19:06:40, and as long after it.
    con, path = duckdb.connect(), f"{tmp_path}/events.parquet"
    con.execute(f"""COPY (SELECT i AS event_id, make_timestamp(1705000000000000 + gap) AS ts, 7 AS user_id, 'view' AS event_type, '{{"k": 1}}' AS props
        FROM (VALUES (1, -999999001), (2, -1000000000), (3, 999999001), (4, -1)) AS t(i, gap)) TO '{path}' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    got = queries()["format_duration"](spark, str(tmp_path)).select("event_id", "duration", "short").orderBy("event_id").collect()
    assert [tuple(r) for r in got] == sorted(con.execute(oracle_sql()["format_duration"]).fetchall())
    assert [r.short for r in got] == ["0s", "1s", "0s", "0s"]
