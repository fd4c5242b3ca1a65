"""Structured Streaming forms of enrichment, density, bursts, recovery, duplicates, cross-host cascades.

All of them work on event time in append mode: a result is given once, when the watermark has passed
it, so late rows within the delay are counted and state is bounded by the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from causeway import schema as S
from causeway.functions.times import micros
from causeway.operators import correlate, series
from causeway.operators.enrich import enrich
from causeway.rules import DEFAULT_RULES, RuleSet
from causeway.schema import Roles, resolve_roles
from causeway.sources.timestamps import TimeFormat


def read_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a parquet table, which may be one file or a folder of parts.

    Spark streams folders only, but takes any file that a pattern names.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Work off what there is, write it as parquet and read it back."""
    with timer_state(stream.sparkSession):
        query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@contextmanager
def timer_state(spark: SparkSession):
    """State with timers lives in RocksDB; a query keeps the setting that it was started with."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def enrich_stream(stream: DataFrame, roles: Roles | None = None, rules: RuleSet = DEFAULT_RULES,
                  time_format: TimeFormat | None = None) -> DataFrame:
    """Stateless, so it is the batch enrichment; text times need their format, chosen on a table beforehand."""
    return enrich(stream, roles, rules, time_format=time_format)


def density_stream(enriched: DataFrame, scope=(), seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Events and errors per bin, given when the bin is closed."""
    rows = enriched.withWatermark(S.EVENT_TIME, delay)
    bins = rows.groupBy(*scope, F.window(S.EVENT_TIME, f"{seconds} seconds")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(S.IS_ERROR).alias("errors"))
    return bins.select(*scope, F.col("window.start").cast("timestamp_ntz").alias("bin_start"),
                       F.col("window.end").cast("timestamp_ntz").alias("bin_end"), "events", "errors")


def burst_baseline(enriched: DataFrame, scope=(), seconds: int = 30) -> DataFrame:
    """Mean and deviation of the events per bin, empty bins counted in; made in batch and stored."""
    width = micros(seconds)
    bins = series.event_bins(enriched, scope, seconds)
    n, sq = F.sum("events").cast("double"), F.sum(F.col("events").cast("double") * F.col("events"))
    facts = bins.groupBy(*scope).agg(
        n.alias("n"), sq.alias("sq"), ((F.max("start_us") - F.min("start_us")) / width + 1).alias("bins"))
    variance = (F.col("sq") - F.col("n") * F.col("n") / F.col("bins")) / (F.col("bins") - 1)
    return facts.select(*scope, (F.col("n") / F.col("bins")).alias("mean"), F.sqrt(variance).alias("sigma"))


def burst_alerts(density: DataFrame, baseline: DataFrame, scope=()) -> DataFrame:
    """Closed bins above mean + 2 deviations of a stored baseline."""
    if scope:
        joined = density.join(baseline, list(scope))
    else:
        row = baseline.first()  # one row by construction, none without events
        if row is None:
            return density.where(F.lit(False))
        joined = density.withColumns({"mean": F.lit(row["mean"]), "sigma": F.lit(row["sigma"])})
    hot = joined.where((F.col("sigma") > 0) & (F.col("events") > F.col("mean") + 2 * F.col("sigma")))
    return hot.drop("mean", "sigma")


_EPISODE = T.StructType([
    T.StructField("first_error_us", T.LongType()), T.StructField("first_recovery_us", T.LongType()),
    T.StructField("mttr_us", T.LongType())])
_OPEN = T.StructType([T.StructField("first_error_us", T.LongType()), T.StructField("closed", T.BooleanType())])


def recovery_seconds(enriched: DataFrame, host: str, delay: str = "10 minutes") -> DataFrame:
    """Errors and recoveries reduced to one row per host and second, given when the second is closed.

    Partial aggregation makes this safe for a host with very many events.
    """
    rows = enriched.where(F.col(S.IS_ERROR) | F.col(S.IS_RECOVERY)).withWatermark(S.EVENT_TIME, delay)
    seconds = rows.groupBy(F.col(host).alias("host"), F.window(S.EVENT_TIME, "1 second")).agg(
        F.min(F.when(F.col(S.IS_ERROR), F.col(S.MICROS))).alias("error_us"),
        # At most one entry per microsecond of the second.
        F.collect_set(F.when(F.col(S.IS_RECOVERY), F.col(S.MICROS))).alias("recoveries"))
    after = F.filter("recoveries", lambda r: r > F.col("error_us"))
    return seconds.select("host", F.unix_micros("window.start").alias("second_us"), "error_us",
                          F.array_min("recoveries").alias("recovery_us"), F.array_min(after).alias("recovery_after_us"))


def recovery_stream(seconds: DataFrame) -> DataFrame:
    """First error and the first recovery after it per host, given once.

    Takes a stream over the table `recovery_seconds` is written to. Closed seconds arrive in time
    order, since a second is given once and never before an earlier one; the state is the open error.
    """
    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, closed = state.get if state.exists else (None, False)
        found = []
        seconds_of_host = pd.concat(list(batches)).sort_values("second_us")
        for error, recovery, after_error in zip(seconds_of_host["error_us"], seconds_of_host["recovery_us"],
                                                seconds_of_host["recovery_after_us"]):
            if closed:
                break
            ends = recovery
            if opened is None:
                if pd.isna(error):
                    continue
                opened, ends = int(error), after_error
            if not pd.isna(ends):
                found.append((key[0], opened, int(ends), int(ends) - opened))
                closed = True
        state.update((opened, closed))
        yield pd.DataFrame(found, columns=["host", "first_error_us", "first_recovery_us", "mttr_us"])

    out = T.StructType([T.StructField("host", T.StringType()), *_EPISODE.fields])
    return seconds.groupBy("host").applyInPandasWithState(follow, out, _OPEN, "append", GroupStateTimeout.NoTimeout)


def episode_seconds(enriched: DataFrame, host: str, delay: str = "10 minutes") -> DataFrame:
    """Times of errors and of recoveries per host and second, each once, given when the second is closed."""
    rows = enriched.where(F.col(S.IS_ERROR) | F.col(S.IS_RECOVERY)).withWatermark(S.EVENT_TIME, delay)
    # At most one entry per microsecond of the second in either list.
    seconds = rows.groupBy(F.col(host).alias("host"), F.window(S.EVENT_TIME, "1 second")).agg(
        F.collect_set(F.when(F.col(S.IS_ERROR), F.col(S.MICROS))).alias("errors"),
        F.collect_set(F.when(F.col(S.IS_RECOVERY), F.col(S.MICROS))).alias("recoveries"))
    return seconds.select("host", F.unix_micros("window.start").alias("second_us"), "errors", "recoveries")


class _Episodes(StatefulProcessor):
    """Per host the open error, and nothing while none is open; a timer closes it when no recovery has come in time."""

    def __init__(self, timeout_us: int | None):
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", T.StructType([T.StructField("first_error_us", T.LongType())]))

    def _rows(self, host, found) -> pd.DataFrame:
        rows = [(host, e, r, None if r is None else r - e) for e, r in found]
        return pd.DataFrame(rows, columns=["host", *_EPISODE.names], dtype=object)

    def _hold(self, opened: int | None, before: int | None) -> None:
        if opened == before:
            return
        if self.timeout is not None and before is not None:
            self.handle.deleteTimer((before + self.timeout) // 1000 + 1)
        if opened is None:
            self.opened.clear()
            return
        self.opened.update((opened,))
        if self.timeout is not None:
            self.handle.registerTimer((opened + self.timeout) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Times only, in order; the work goes from episode to episode, not from event to event.
        parts = [(batch["errors"], batch["recoveries"]) for batch in rows]
        errors, recoveries = (np.sort(np.concatenate([np.asarray(x, np.int64) for p in parts for x in p[i]] or [np.zeros(0, np.int64)])) for i in (0, 1))
        before = self.opened.get()[0] if self.opened.exists() else None
        last = max([*errors[-1:].tolist(), *recoveries[-1:].tolist()], default=None)
        found, opened = [], before
        if opened is None and len(errors):
            opened = int(errors[0])
        while opened is not None:
            at = int(np.searchsorted(recoveries, opened, "right"))
            end = int(recoveries[at]) if at < len(recoveries) else None
            if end is not None and (self.timeout is None or end <= opened + self.timeout):
                found.append((opened, end))
                nth = int(np.searchsorted(errors, end, "left"))  # an error at that time opens the next episode
            elif self.timeout is not None and last > opened + self.timeout:
                found.append((opened, None))
                nth = int(np.searchsorted(errors, opened + self.timeout, "right"))
            else:
                break
            opened = int(errors[nth]) if nth < len(errors) else None
        self._hold(opened, before)
        yield self._rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened = self.opened.get()[0] if self.opened.exists() else None
        found = []
        if opened is not None and (opened + self.timeout) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            found.append((opened, None))
            self.opened.clear()
        yield self._rows(key[0], found)

    def close(self) -> None:
        pass


def episode_stream(seconds: DataFrame, timeout_seconds: float | None = None) -> DataFrame:
    """Every episode of a host: its first error and the first recovery after it, given once.

    An error at or after that recovery opens the next episode. Where no recovery comes within the time-out, the
    episode is given without one, at the latest when the watermark has passed it, and the first error behind
    the time-out opens the next. Takes a stream over the table `episode_seconds` is written to, whose seconds
    come in time order. The state is the open error: a host that has recovered or timed out holds none.
    """
    out = T.StructType([T.StructField("host", T.StringType()), *_EPISODE.fields])
    timed = seconds.withColumn("second", F.timestamp_micros("second_us")).withWatermark("second", "0 seconds")
    timeout = None if timeout_seconds is None else micros(timeout_seconds)
    return timed.groupBy("host").transformWithStateInPandas(_Episodes(timeout), out, "Append", "EventTime")


def deduplicate_stream(stream: DataFrame, columns: list[str], delay: str = "10 minutes") -> DataFrame:
    """Rows equal in `columns` are given once within the delay."""
    return stream.withWatermark(S.EVENT_TIME, delay).dropDuplicatesWithinWatermark(columns)


def cross_host_by_day(enriched: DataFrame, folder: str, roles: Roles | None = None, window_seconds: float = 2.0,
                      delay_seconds: float = 600.0, limit: int = 10) -> str:
    """The first `limit` cross-host cascades of each closed UTC day; gives the folder of the result.

    Every micro-batch adds its errors to a table partitioned by day and notes the days it saw. A day
    is closed when the newest error lies further behind its end than delay and window. It is then worked
    off once by the batch operator, which pairs no events, together with the first window of the day
    after it, where the followers of its last errors lie; seeds are those of the day alone. A repeated
    micro-batch overwrites what its first run wrote.
    """
    if window_seconds > 86_400:
        raise ValueError("the window may not be longer than a day")
    roles = roles or resolve_roles(enriched)
    event_id, host, message = roles.need("event_id", "cross_host", "message")
    errors = enriched.where(F.col(S.IS_ERROR)).select(event_id, host, message, S.MICROS, S.LEVEL, S.IS_ERROR)
    day = F.date_format(F.timestamp_micros(S.MICROS), "yyyy-MM-dd")
    kept, seen, finished, result = (f"{folder}/{name}" for name in ("errors", "seen", "finished", "cascades"))

    def notes(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
        """The notes of the batches so far: a few rows per batch."""
        return spark.read.schema(f"{schema}, batch_id long").parquet(path).where(F.col("batch_id") <= batch_id)

    def add(batch: DataFrame, batch_id: int) -> None:
        spark, part = batch.sparkSession, f"batch_id={batch_id}"
        batch.select("*", day.alias("day")).write.mode("overwrite").partitionBy("day").parquet(f"{kept}/{part}")
        batch.groupBy(day.alias("day")).agg(F.max(S.MICROS).alias("newest")).write.mode("overwrite").parquet(f"{seen}/{part}")
        spark.createDataFrame([], "day string").write.mode("overwrite").parquet(f"{finished}/{part}")
        days = notes(spark, seen, "day string, newest long", batch_id)
        closed = F.lit(micros(delay_seconds + window_seconds))
        limit_day = days.select(F.date_format(F.timestamp_micros(F.max("newest") - closed), "yyyy-MM-dd").alias("before"))
        due = days.select("day").distinct().join(notes(spark, finished, "day string", batch_id - 1), "day", "left_anti")
        names = [r.day for r in due.where(F.col("day") < limit_day.scalar()).collect()]
        if not names:
            return
        after = [str(date.fromisoformat(n) + timedelta(days=1)) for n in names]
        # The names of the days prune the partitions that are read.
        schema = T.StructType([*errors.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("day", T.StringType())])
        rows = spark.read.schema(schema).parquet(kept).where(F.col("day").isin([*names, *after]) & (F.col("batch_id") <= batch_id))
        begun = F.pmod(F.col(S.MICROS), F.lit(micros(86_400))) <= micros(window_seconds)
        rows = rows.where(F.col("day").isin(names) | begun).drop("day")
        found = correlate.cross_host_cascade(rows, roles, (), window_seconds, limit, by_day=True).where(F.col("day").isin(names))
        found.write.mode("overwrite").partitionBy("day").parquet(f"{result}/{part}")
        spark.createDataFrame([(n,) for n in names], "day string").write.mode("overwrite").parquet(f"{finished}/{part}")

    query = (errors.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return result
