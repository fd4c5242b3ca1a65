"""What is shuffled, and what an empty table gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from causeway import schema as S
from causeway.operators import correlate, impact, incident, reports
from causeway.operators.enrich import enrich
from causeway.plans.scaling import RANGE_BUCKETS, within_range


@pytest.fixture(scope="module")
def spread(events):
    """Thirty days of four hosts; each host's root event is on a day of its own."""
    rng = random.Random(1)
    rows = [(round(rng.random() * 30 * 86400, 3), rng.choice("abcd"), "INFO", "all well") for _ in range(3000)]
    rows += [(86400 * (3 + 5 * i) + k, h, "ERROR", "connection timeout") for i, h in enumerate("abcd") for k in range(5)]
    return events(rows)


def shuffled_rows(df, column):
    """Rows written by exchanges whose output has the column, after a run."""
    df.collect()
    total, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name == "Exchange" and re.search(rf"\b{column}#", node.output().toString()):
            metric = node.metrics().get("shuffleRecordsWritten")
            if metric.isDefined():
                total.append(metric.get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(total)


@pytest.mark.parametrize("operator", ["incident_window", "root_host_drilldown", "pattern_drilldown"])
def test_only_rows_near_a_root_event_are_shuffled_whole(spark, spread, tmp_path, operator):
    path = str(tmp_path / "e")
    reports.write_enriched(spread, path)
    df = spark.read.parquet(path)
    root = incident.root_cause(df, scope=["host"])
    rows = getattr(correlate, operator)(df, root, scope=["host"])
    every, near = df.count(), df.join(root.select("host", "root_micros"), "host").where(F.abs(F.col(S.MICROS) - F.col("root_micros")) <= 600_000_000).count()
    assert rows.count() > 0
    assert shuffled_rows(rows, "message") <= 2 * near < every / 10


def test_other_flows_are_not_shuffled_whole(spark, spread):
    df = spread.withColumn("flow", F.when(F.col("host") != "d", F.pmod(F.xxhash64("event_id"), F.lit(40)).cast("string")))
    rows = correlate.isolate_flow(df, "flow", scope=["host"])
    plain = df.groupBy("host", "flow").agg(F.count_if(S.IS_ERROR).alias("e")).where("flow is not null").groupBy("host").agg(F.min_by("flow", F.struct(-F.col("e"), "flow")).alias("w"))
    want = df.join(plain, "host", "left").where("flow = w or w is null").select("event_id")
    assert rows.select("event_id").exceptAll(want).count() == 0 == want.exceptAll(rows.select("event_id")).count()
    of_d = df.where("host = 'd'").count()
    assert rows.where("host = 'd'").count() == of_d  # no flow is known there, so everything stays
    assert shuffled_rows(rows, "message") <= of_d + (df.count() - of_d) / 5


def test_ranges_let_all_rows_of_a_scope_through(spark):
    rows = spark.range(2000).select((F.col("id") % 50).alias("s"), (F.col("id") * 7919 % 1000).alias("v"))
    facts = spark.range(50).select(F.col("id").alias("s"), (F.col("id") * 20).alias("at"))
    exact = rows.join(facts, "s").where("v between at - 5 and at + 5").select("s", "v")
    near = within_range(rows, facts, ["s"], F.col("v"), F.col("at") - 5, F.col("at") + 5)
    assert exact.exceptAll(near).count() == 0 and near.count() < 100 and RANGE_BUCKETS > 50


def test_empty_tables(spark, spread):
    none = enrich(spread.select("event_id", "timestamp", "host", "log_level", "message").where("false"))
    row = incident.incident(none).first()
    assert (row.total_events, row.severity_score, row.severity_grade, row.part_mttr, row.root_host, row.sla_breach) == (0, 0, "N/A", None, None, None)
    assert reports.incident_summary(none).first().total_events == 0
    assert reports.alert_feed(none).first().severity_score == 0
    assert reports.narrative_facts(none).count() == 1
    for scope in (["host"],):
        for found in (incident.incident(none, scope=scope), reports.incident_summary(none, scope=scope), reports.alert_feed(none, scope=scope),
                      reports.narrative_facts(none, scope=scope), incident.mttr_all_errors(none, scope), impact.tag_sets(none, scope)):
            assert found.count() == 0
    assert incident.mttr_all_errors(none).count() == 0
    root = incident.root_cause(none)
    assert correlate.incident_window(none, root).count() == 0 and correlate.pattern_drilldown(none, root).count() == 0


def test_recovery_after_every_error(spark, events):
    """One host holds 99 % of the rows; silences of minutes and days lie between errors and recoveries."""
    rng = random.Random(6)
    rows = []
    for _ in range(900):
        at = rng.choice([0, 86_400, 86_400 * 9]) + rng.choice([0, 60, 3600, 7200]) + rng.randrange(90)
        host = "big" if rng.random() < 0.99 else "small"
        rows.append((at, host, *rng.choice([("ERROR", "timeout"), ("ERROR", "x"), ("INFO", "service recovered"), ("INFO", "y"), ("ERROR", "service recovered")])))
    rows += [(86_400 * 30, "big", "ERROR", "never over"), (5, "odd", "INFO", "service recovered")]
    want = {}
    for host in ("big", "small"):
        ups = sorted(r[0] for r in rows if r[1] == host and "recovered" in r[3])
        waits = [next((u - r[0] for u in ups if u > r[0]), None) for r in rows if r[1] == host and r[2] == "ERROR"]
        some = [w for w in waits if w is not None]
        want[host] = (len(waits), len(some), sum(some) / len(some) * 1e6 if some else None, max(some) * 1_000_000 if some else None)
    got = {r.host: (r.errors, r.recovered, r.mean_mttr_us, r.longest_mttr_us) for r in incident.mttr_all_errors(events(rows), ["host"]).collect()}
    assert set(got) == set(want)
    for host, row in want.items():
        assert got[host] == pytest.approx(row)
