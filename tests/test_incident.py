from pyspark.sql import functions as F

from causeway.operators import correlate, impact, incident, reports


def run(df, **kw):
    return incident.incident(df, **kw).first()


def test_cascade_mttr_and_precursor_bounds(events):
    row = run(events([
        (-600, "a", "WARN", "edge"), (-601, "a", "WARN", "too early"), (-1, "a", "INFO", "no space left"),
        (0, "a", "ERR", "recovered"), (0, "b", "ERROR", "same time"), (300, "a", "ERROR", "edge"),
        (300.000001, "a", "ERROR", "late"), (75, "a", "INFO", "all checks passing")]))
    assert (row.root_event_id, row.cascade_count, row.precursor_count, row.mttr_us) == (3, 1, 2, 75_000_000)


def test_root_falls_back_to_warning_then_first_row(events):
    assert run(events([(0, "a", "INFO", "x"), (5, "a", "NOTICE", "w")])).root_event_id == 1
    row = run(events([(3, "a", "INFO", "x"), (1, "a", "INFO", "y"), (None, "a", "INFO", "z")]))
    assert (row.root_event_id, row.mttr_us, row.sla_breach) == (1, None, None)


def test_equal_times_are_ordered_by_id(events):
    assert run(events([(0, "a", "INFO", "x"), (9, "b", "ERROR", "one"), (9, "c", "ERROR", "two")])).root_event_id == 1


def test_events_without_time_have_no_aftermath(events):
    row = run(events([(None, "a", "ERROR", "x"), (None, "a", "INFO", "recovered")]))
    assert (row.root_micros, row.cascade_count, row.mttr_us) == (None, 0, None)


def test_empty_input_keeps_the_schema(events):
    df = events([(0, "a", "INFO", "x")]).where("false")
    assert incident.incident(df, scope=["host"]).count() == 0
    assert "severity_grade" in incident.incident(df, scope=["host"]).columns


def test_score_is_cut_not_rounded_and_unknown_recovery_scores_15(events):
    row = run(events([(0, "a", "ERROR", "x"), (1, "a", "INFO", "y"), (2, "a", "INFO", "z")]))
    assert (row.severity_score, row.part_error_ratio, row.part_mttr, row.severity_grade) == (23, 8.3, 15.0, "P4")
    row = run(events([(0, "a", "CRITICAL", "kernel panic")]))
    assert (row.severity_score, row.part_pattern_weight) == (65, 25.0)


def test_sla_is_strict(events):
    calm = [(0, "a", "ERROR", "x")] + [(1, "a", "INFO", "x")] * 9
    assert run(events(calm + [(7200, "a", "INFO", "recovered")])).severity_grade == "P4"
    assert run(events(calm + [(86400, "a", "INFO", "recovered")])).sla_breach is False
    assert run(events(calm + [(86401, "a", "INFO", "recovered")])).sla_breach is True


def test_confidence_branches(events):
    def reason(rows):
        row = run(events(rows))
        return row.confidence, row.confidence_reason

    assert reason([(0, "a", "FATAL", "segfault")]) == ("HIGH", "critical_with_tags")
    assert reason([(0, "a", "FATAL", "x")]) == ("MEDIUM", "critical_without_tags")
    assert reason([(0, "a", "EMERG", "x")]) == ("LOW", "other_level")
    assert reason([(i, "a", "ERROR", "x") for i in range(6)]) == ("HIGH", "error_deep_cascade")
    assert reason([(0, "a", "ERROR", "segfault timeout")] + [(i, "a", "ERROR", "x") for i in (1, 2, 3)]) == (
        "HIGH", "error_tags_and_cascade")
    assert reason([(0, "a", "ERROR", "segfault")]) == ("MEDIUM", "error_with_tags")
    assert reason([(0, "a", "INFO", "x")]) == ("LOW", "other_level")


def test_trend(events):
    def label(rows):
        return incident.trend(events(rows)).first().trend

    quiet, loud = "INFO", "ERROR"
    assert label([(0, "a", loud, ""), (1, "a", quiet, ""), (9, "a", loud, ""), (10, "a", loud, "")]) == "ESCALATING"
    assert label([(0, "a", loud, ""), (1, "a", loud, ""), (9, "a", quiet, ""), (10, "a", loud, "")]) == "RECOVERING"
    assert label([(0, "a", loud, ""), (1, "a", quiet, ""), (9, "a", quiet, ""), (10, "a", loud, "")]) == "STABLE"
    assert label([(0, "a", loud, ""), (1, "a", quiet, ""), (9, "a", quiet, "")]) == "N/D"
    assert label([(5, "a", loud, "")] * 4) == "N/D"


def test_scopes_are_apart_and_null_keys_left_out(events):
    df = events([(0, "a", "ERROR", "x"), (1, "b", "INFO", "recovered"), (2, None, "ERROR", "x"), (3, "a", "INFO", "recovered")])
    rows = {r.host: r for r in incident.incident(df, scope=["host"]).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].mttr_us == 3_000_000 and rows["b"].mttr_us is None


def test_host_status_uses_rounded_and_service_status_exact_percentages(events):
    # 14.96 % errors: rounded to 15.0 for hosts, under 15 for services.
    df = events([(i, "a", "ERROR" if i < 187 else "INFO", "x") for i in range(1250)]).withColumn("sourcetype", F.lit("s"))
    assert impact.host_impact(df).first().status == "DEGRADED"
    assert impact.service_impact(df).first().status == "OK"
    half = events([(0, "a", "ERROR", "x"), (1, "a", "INFO", "x")])
    assert impact.host_impact(half).first().status == "DOWN"
    assert impact.worst_service_status(half).first().service_status == "UNKNOWN"


def test_recovery_before_the_error_is_kept_signed(events):
    df = events([(0, "a", "INFO", "recovered"), (5, "a", "ERROR", "x"), (9, "a", "INFO", "recovered"), (1, "b", "INFO", "x")])
    rows = impact.recovery_timeline(df).collect()
    assert [(r.host, r.downtime_us, r.downtime) for r in rows] == [("a", -5_000_000, "5s")]
    assert impact.recovery_timeline(df, after_error=True).first().downtime_us == 4_000_000


def test_flow_isolation(events):
    df = events([(0, "a", "INFO", "x"), (1, "b", "INFO", "segfault"), (2, "c", "INFO", "segfault")])
    assert [r.host for r in correlate.isolate_flow(df, "host").collect()] == ["b"]
    assert [r.host for r in correlate.isolate_flow(df, "host", "c").collect()] == ["c"]
    assert correlate.isolate_flow(df.where("host = 'a'"), "host").count() == 1


def test_cause_list_default(events):
    rows = correlate.cause_list(reports.root_report(events([(0, "a", "ERROR", "x")]))).collect()
    assert [(r.cause_no, r.kind, r.label) for r in rows] == [(1, "default", "Error event at level ERROR")]


def test_duplicates_count_nulls_as_equal(events):
    df = events([(0, None, "INFO", "x"), (1, None, "INFO", "x"), (2, "a", "INFO", "x")])
    assert impact.duplicate_count(df, ["host", "message"]).first().duplicate_count == 1


def test_first_sources_limit_the_drilldowns(events):
    df = events([(i, "a", "ERROR", "x") for i in range(5)]).withColumn("source", F.concat(F.lit("s"), F.col("event_id")))
    root = incident.root_cause(df)
    assert correlate.incident_window(df, root).count() == 3
    assert correlate.root_host_drilldown(df, root).count() == 5
