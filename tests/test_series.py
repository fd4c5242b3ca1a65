import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway import schema as S
from causeway.operators import correlate, incident, series
from causeway.plans.scaling import exact_quantile, running_total, top_k


def gaps_of(rows):
    return sorted((r.gap_us, r.gap_factor) for r in rows.collect())


def test_gap_of_exactly_the_least_length_counts(events):
    steady = [(i, "a", "INFO", "x") for i in range(10)]
    assert gaps_of(series.log_gaps(events(steady + [(69, "a", "INFO", "x")]))) == [(60_000_000, 60.0)]
    assert gaps_of(series.log_gaps(events(steady + [(68.999999, "a", "INFO", "x")]))) == []


def test_gaps_fall_back_to_the_mean_when_most_times_are_equal(events):
    rows = [(0, "a", "INFO", "x")] * 30 + [(7200, "a", "INFO", "x"), (None, "a", "INFO", "x")]
    assert gaps_of(series.log_gaps(events(rows))) == [(7_200_000_000, 30.0)]
    assert gaps_of(series.log_gaps(events([(0, "a", "INFO", "x")] * 5))) == []
    assert gaps_of(series.log_gaps(events([(0, "a", "INFO", "x"), (9000, "a", "INFO", "x")]))) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_equal_brute_force(events, seed):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for _ in range(150):
        at += rng.choice([0, 0, 1, 2, 30, 400, 90000]) * rng.random()
        rows.append((round(at, 3), rng.choice("ab"), "INFO", "x"))
    got = series.log_gaps(events(rows), ["host"])
    found = {(r.host, r.gap_us) for r in got.collect()}
    for host in "ab":
        times = sorted(round(r[0] * 1e6) for r in rows if r[1] == host)
        deltas = np.diff(times)
        p75 = np.quantile(deltas, 0.75)
        want = sorted((d for d in deltas if d >= max(5 * (p75 if p75 > 0 else deltas.mean()), 60e6)), reverse=True)[:10]
        assert sorted(g for h, g in found if h == host) == sorted(set(want))


@pytest.mark.parametrize("width", [30, 7])
def test_bursts_equal_dense_bins(events, width):
    rng = random.Random(5)
    at = [rng.random() * 3600 for _ in range(200)] + [1800 + rng.random() * 20 for _ in range(60)]
    got = {(r.events, r.z_score) for r in series.burst_windows(events([(round(t, 6), "a", "INFO", "x") for t in at]),
                                                               resample_seconds=width).collect()}
    start = 8 * 3600  # the table begins at 08:00, bins at midnight
    bins = np.array([int((start + t) // width) for t in at])
    counts = np.bincount(bins - bins.min())
    mean, sigma = counts.mean(), counts.std(ddof=1)
    want = {(int(c), float(np.floor((c - mean) / sigma * 10 + 0.5) / 10)) for c in counts if c > mean + 2 * sigma}
    assert got == want and got


def test_no_bursts_without_spread_or_events(events):
    assert series.burst_windows(events([(i * 30, "a", "INFO", "x") for i in range(8)])).count() == 0
    assert series.burst_windows(events([(0, "a", "INFO", "x")] * 4)).count() == 0


def test_density_fills_empty_minutes(events):
    rows = series.error_density(events([(0, "a", "ERROR", "x"), (1, "a", "INFO", "x"), (185, "a", "INFO", "x")])).orderBy("bin_start")
    assert [(r.events, r.errors, r.bar) for r in rows.collect()] == [(2, 1, 24), (0, 0, 0), (0, 0, 0), (1, 0, 12)]


def test_chain_around_the_root(events):
    rows = [(i, "a", "INFO", "segfault") for i in range(10)] + [(20, "a", "ERROR", "x"), (60, "a", "ERROR", "y")]
    df = events(rows)
    chain = series.event_chain(df, incident.root_cause(df), max_events=6).orderBy("position").collect()
    assert [(r.event_id, r.marker, r.gap_before_us) for r in chain] == [
        (7, "other", None), (8, "other", None), (9, "other", None), (10, "root", None), (11, "error", 40_000_000)]


def brute_cascades(rows, window, limit):
    errors = sorted((round(t * 1e6), i, h) for i, (t, h, level, _) in enumerate(rows) if level == "ERROR")
    out, seen = [], set()
    for n, (t0, i0, h0) in enumerate(errors):
        if t0 // 1000 in seen:
            continue
        followers = [h for t, i, h in errors[n + 1:] if t - t0 <= window * 1e6 and h != h0]
        if followers:
            seen.add(t0 // 1000)
            out.append((i0, list(dict.fromkeys([h0, *followers]))))
    return out[:limit]


@pytest.mark.parametrize("seed", range(4))
def test_cross_host_equals_brute_force(events, seed):
    rng = random.Random(seed)
    rows = [(round(rng.random() * rng.choice([0.01, 3, 30]), 4), rng.choice(["a", "a", "a", "b", "c"]),
             rng.choice(["ERROR", "ERROR", "INFO"]), "m") for _ in range(70)]
    found = correlate.cross_host_cascade(events(rows), window_seconds=2.0, limit=1000).orderBy("group_rank").collect()
    assert [(r.seed_event_id, r.hosts) for r in found] == brute_cascades(rows, 2.0, 1000)


def test_cross_host_window_end_is_included(events):
    rows = [(0, "a", "ERROR", "m" * 90), (2, "b", "CRITICAL", "n")]
    row = correlate.cross_host_cascade(events(rows)).first()
    assert (row.hosts, row.levels, row.trigger) == (["a", "b"], ["ERROR", "CRITICAL"], "m" * 80)
    assert correlate.cross_host_cascade(events([rows[0], (2.000001, "b", "ERROR", "n")])).count() == 0


@pytest.mark.parametrize("quarters", [1, 2, 3])
def test_exact_quantile(spark, quarters):
    rng = random.Random(quarters)
    data = [("k" + str(i % 3), int(10 ** (rng.random() * 9))) for i in range(600)] + [("one", 5), ("zero", 0), ("zero", 0)]
    df = spark.createDataFrame(data, "k string, v long").groupBy("k", "v").agg(F.count(F.lit(1)).alias("w"))
    got = {r.k: (r.q, r.n) for r in exact_quantile(df, ["k"], "v", "w", quarters, "q").collect()}
    for k in {k for k, _ in data}:
        values = [v for key, v in data if key == k]
        assert got[k] == (pytest.approx(np.quantile(values, quarters / 4)), len(values))


def test_running_total_over_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 64).alias("b"), "id")
    got = running_total(df, ["g"], "b", [F.col("id")], F.lit(1), "n")
    assert got.where(F.col("n") != F.floor(F.col("id") / 2) + 1).count() == 0


def test_top_k_beyond_the_limit_of_early_cutting(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = top_k(df, ["g"], [F.col("id").desc()], 1500, "r")
    assert got.count() == 3000 and got.agg(F.min("id")).first()[0] == 2000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    assert "WindowGroupLimit" in plan_of(top_k(df, ["g"], [F.col("id").asc()], 5, "r"))
    assert "TakeOrderedAndProject" in plan_of(top_k(df, [], [F.col("id").asc()], 5, "r"))


@pytest.mark.parametrize("build", [
    lambda df: series.burst_windows(df), lambda df: series.event_bins(df),
    lambda df: incident.incident(df), lambda df: incident.trend(df)])
def test_global_scope_never_windows_all_rows_in_one_task(events, build):
    df = events([(i, "a", "ERROR", "x") for i in range(10)])
    assert "Window" not in plan_of(build(df))


def test_results_do_not_depend_on_partitions(spark, events):
    rows = [(i % 40 * 13, "ab"[i % 2], "ERROR" if i % 3 else "INFO", "x") for i in range(200)]
    df = events(rows)
    got = [sorted(map(str, f(d).collect())) for d in (df.repartition(1), df.repartition(7)) for f in (
        lambda x: incident.incident(x, scope=["host"]), lambda x: series.log_gaps(x), correlate.cross_host_cascade)]
    assert got[:3] == got[3:]


def test_scope_of_several_columns(events):
    df = events([(0, "a", "ERROR", "x"), (9, "a", "ERROR", "x")]).withColumn("day", F.to_date(S.EVENT_TIME))
    assert incident.incident(df, scope=["day", "host"]).first().cascade_count == 1
