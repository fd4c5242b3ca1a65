"""Streams that take several micro-batches give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from causeway import schema as S
from causeway.operators import correlate, impact
from causeway.operators.enrich import enrich, enrich_levels
from causeway.plans.scaling import shared_dir
from causeway.streaming import streams

COLUMNS = ["event_id", "timestamp", "host", "log_level", "message"]


@pytest.fixture(scope="module")
def parts(spark, events, tmp_path_factory):
    """Three days of events in six files, in time order."""
    rng = random.Random(3)
    rows = sorted((round(rng.random() * 3 * 86400, 3), rng.choice("abc"), rng.choice(["ERROR", "INFO", "INFO"]),
                   rng.choice(["x", "service recovered", "timeout"])) for _ in range(600))
    df = events(rows).select(COLUMNS)
    folder = str(tmp_path_factory.mktemp("parts"))
    for i in range(6):
        df.where(F.floor(F.col("event_id") / 100) == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream_of(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_recovery_over_batches(spark, parts):
    seconds = streams.recovery_seconds(enrich(stream_of(spark, parts)), "host", "1 minute")
    path = shared_dir(spark, "test-seconds")
    streams.run_to_table(seconds, path, shared_dir(spark, "test-c1"))
    found = streams.run_to_table(streams.recovery_stream(spark.readStream.schema(seconds.schema).parquet(path)),
                                 shared_dir(spark, "test-rec"), shared_dir(spark, "test-c2"))
    batch = impact.recovery_timeline(enrich(spark.read.parquet(parts)), after_error=True)
    want = {(r.host, r.first_error_us, r.first_recovery_us) for r in batch.collect()}
    assert {(r.host, r.first_error_us, r.first_recovery_us) for r in found.collect()} == want and want


def test_density_over_batches(spark, parts):
    got = streams.run_to_table(streams.density_stream(enrich_levels(stream_of(spark, parts)), ["host"], 3600),
                               shared_dir(spark, "test-density"), shared_dir(spark, "test-c3"))
    total, late = got.agg(F.sum("events")).first()[0], 600
    assert 0 < total <= late and got.count() == got.select("host", "bin_start").distinct().count()


def test_cross_host_days_are_given_once(spark, parts):
    path = streams.cross_host_by_day(enrich_levels(stream_of(spark, parts)), shared_dir(spark, "test-cross"),
                                     window_seconds=300, delay_seconds=60)
    got = spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")
    df = enrich_levels(spark.read.parquet(parts))
    want = correlate.cross_host_cascade(df, window_seconds=300, by_day=True)
    days = {str(r.day) for r in got.select("day").distinct().collect()}
    assert len(days) == 3  # the last of the four calendar days is still open
    assert {(str(r.day), r.group_rank, r.seed_event_id, tuple(r.hosts)) for r in got.collect()} == {
        (r.day, r.group_rank, r.seed_event_id, tuple(r.hosts)) for r in want.collect() if r.day in days}


def test_cascades_go_on_over_midnight(spark, events, tmp_path):
    """A seed of 23:59:59 has a follower of 00:00:01, which comes in a later micro-batch."""
    midnight = 16 * 3600
    rows = [(10, "a", "ERROR", "x"), (midnight - 1, "a", "ERROR", "last of the day"), (midnight + 1, "b", "CRITICAL", "first of the next"),
            (midnight + 2, "c", "ERROR", "too late"), (midnight + 90_000, "a", "ERROR", "x"), (midnight + 90_001, "c", "ERROR", "x"),
            (midnight + 200_000, "a", "ERROR", "x")]
    df, folder = events(rows).select(COLUMNS), str(tmp_path / "in")
    for i in range(0, len(rows), 2):
        df.where(F.col("event_id").isin(i, i + 1)).coalesce(1).write.mode("append").parquet(folder)
    path = streams.cross_host_by_day(enrich_levels(stream_of(spark, folder)), str(tmp_path / "out"), window_seconds=2, delay_seconds=60)
    got = spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").orderBy("day", "group_rank").collect()
    assert [(str(r.day), r.seed_event_id, r.hosts, r.levels, r.trigger) for r in got] == [
        ("2024-03-15", 1, ["a", "b"], ["ERROR", "CRITICAL"], "last of the day"), ("2024-03-16", 2, ["b", "c"], ["CRITICAL", "ERROR"], "first of the next"),
        ("2024-03-17", 4, ["a", "c"], ["ERROR"], "x")]
    with pytest.raises(ValueError, match="day"):
        streams.cross_host_by_day(enrich_levels(stream_of(spark, folder)), str(tmp_path / "no"), window_seconds=100_000)


def test_duplicates_over_batches(spark, parts):
    from causeway.operators.enrich import normalize_time

    rows = streams.deduplicate_stream(normalize_time(stream_of(spark, parts)), ["host", "message"], "10 days")
    got = streams.run_to_table(rows.select("host", "message"), shared_dir(spark, "test-dup"), shared_dir(spark, "test-c4"))
    assert got.count() == 9 == got.distinct().count()


def test_text_times_need_a_format(spark, tmp_path):
    from causeway.sources.timestamps import choose_formats

    path = str(tmp_path / "log.parquet")
    spark.createDataFrame([("1", "1/5/2024 03:04:05", "a", "ERROR", "timeout"), ("2", "1/5/2024 13:04:06", "b", "INFO", "up")],
                          "event_id string, timestamp string, host string, log_level string, message string").write.parquet(path)
    stream = streams.read_table_stream(spark, path)  # a folder of parts
    with pytest.raises(ValueError, match="formats"):
        streams.enrich_stream(stream)
    chosen = choose_formats(spark.read.parquet(path), ["timestamp"])["timestamp"]
    found = streams.run_to_table(streams.enrich_stream(stream, time_format=chosen).select("event_id", S.MICROS),
                                 shared_dir(spark, "test-text"), shared_dir(spark, "test-c9"))
    want = enrich(spark.read.parquet(path)).select("event_id", S.MICROS)
    assert sorted(found.collect()) == sorted(want.collect())
    assert all(r[1] for r in found.collect())


def test_no_baseline_no_alerts(spark, events):
    df = events([(0, "a", "INFO", "x")])
    density = streams.density_stream(df, (), 60)
    assert streams.burst_alerts(density, streams.burst_baseline(df.where("false"))).count() == 0


def test_every_recovery_episode_is_given(spark, events, tmp_path):
    rows = [(0, "h", "ERROR", "x"), (0.25, "h", "INFO", "service recovered"), (0.5, "h", "ERROR", "x"), (7, "h", "ERROR", "x"),
            (9, "h", "INFO", "service recovered"), (10, "h", "INFO", "service recovered"), (20, "h", "ERROR", "x"),
            (21, "h", "INFO", "service recovered"), (90_000, "h", "ERROR", "x")]
    path, seen = str(tmp_path / "seconds"), str(tmp_path / "events")
    events(rows).write.parquet(seen)
    seconds = streams.episode_seconds(streams.read_table_stream(spark, seen), "host")
    streams.run_to_table(seconds, path, str(tmp_path / "c1"))
    found = streams.run_to_table(streams.episode_stream(spark.readStream.schema(seconds.schema).parquet(path)),
                                 str(tmp_path / "found"), str(tmp_path / "c2")).collect()
    start = min(r.first_error_us for r in found)
    assert {(r.first_error_us - start, r.first_recovery_us - start) for r in found} == {
        (0, 250_000), (500_000, 9_000_000), (20_000_000, 21_000_000)}


def episodes_by_hand(events_of_host, timeout, upto):
    """(first error, recovery or none) one by one; `upto` is how far the host's clock has come."""
    out, opened = [], None
    for at, is_error in sorted(events_of_host):
        if opened is not None and timeout is not None and at > opened + timeout:
            out.append((opened, None))
            opened = None
        if is_error and opened is None:
            opened = at
        elif not is_error and opened is not None and at > opened:
            out.append((opened, at))
            opened = None
    if opened is not None and timeout is not None and (opened + timeout) // 1000 + 1 <= upto // 1000:
        out.append((opened, None))
    return out


@pytest.mark.parametrize("timeout", [None, 100])
def test_episodes_over_batches_and_their_state(spark, tmp_path, timeout):
    """Forty hosts over nine micro-batches; of the hosts that have recovered or timed out no state is left."""
    rng, second = random.Random(8), 1_000_000
    rows, by_host = [], {f"h{i}": [] for i in range(40)}
    for at in range(1, 901):
        for host in rng.sample(sorted(by_host), 3):
            if host in ("h0", "h1") and at > 300:  # these fall silent with an open error
                continue
            times = [(at * second + rng.randrange(second), rng.random() < 0.7 or host in ("h0", "h1")) for _ in range(rng.randrange(1, 4))]
            by_host[host] += times
            rows.append((host, at * second, [t for t, e in times if e], [t for t, e in times if not e], (at - 1) // 100))
    schema = "host string, second_us long, errors array<long>, recoveries array<long>, part int"
    df, folder = spark.createDataFrame(rows, schema), str(tmp_path / "seconds")
    for i in range(9):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with streams.timer_state(spark):
        query = (streams.episode_stream(stream, timeout).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
                 .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    got = sorted((r.host, r.first_error_us, r.first_recovery_us or -1) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    limit = None if timeout is None else timeout * second
    want, still_open = [], 0
    for host, times in by_host.items():
        found = episodes_by_hand(times, limit, 900 * second)
        want += [(host, e, -1 if r is None else r) for e, r in found]
    assert got == sorted(want) and len(query.recentProgress) >= 9
    if timeout is None:
        assert all(r[2] > 0 for r in got)
        return
    silent = {r[0] for r in got if r[2] == -1}
    assert {"h0", "h1"} <= silent
    # Open errors of the last 100 seconds at most, each with its entry in the timers' two tables.
    recent = sum(1 for times in by_host.values() if max(t for t, _ in times) > (900 - 100) * second)
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held <= 3 * recent and len(by_host) - recent >= 2
