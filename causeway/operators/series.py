"""Bursts, gaps, density and the chain of events around the root cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway import schema as S
from causeway.functions.times import DAY, MINUTE, as_time, floor_div, micros
from causeway.operators.enrich import time_order
from causeway.plans.scaling import attach, exact_quantile, top_k, with_scope
from causeway.schema import Roles, resolve_roles


def half_up_tenths(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def event_bins(df: DataFrame, scope=(), seconds: float = 30) -> DataFrame:
    """Events and errors per non-empty bin. Bins start at midnight of the scope's first day."""
    width = micros(seconds)
    rows = with_scope(df, scope).where(F.col(S.MICROS).isNotNull()).select(*scope, S.MICROS, S.IS_ERROR)
    if DAY % width == 0:
        start = floor_div(F.col(S.MICROS), width) * width
    else:
        first = rows.groupBy(*scope).agg(F.min(S.MICROS).alias("us"), F.count(F.lit(1)).alias("n"))
        rows = attach(rows, first, scope, "first", F.col(S.MICROS), "n")
        origin = floor_div(F.col("first.us"), DAY) * DAY
        start = origin + floor_div(F.col(S.MICROS) - origin, width) * width
    return rows.withColumn("start_us", start).groupBy(*scope, "start_us").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(S.IS_ERROR).alias("errors"))


def burst_windows(df: DataFrame, scope=(), resample_seconds: float = 30) -> DataFrame:
    """Bins with more than mean + 2 standard deviations events, empty bins counted in.

    Mean and deviation come from the number of bins of the span, the sum and the sum of squares, so
    empty bins are never made. The test is done in whole numbers; where these outgrow 38 digits, in
    doubles.
    """
    width = micros(resample_seconds)
    bins = event_bins(df, scope, resample_seconds)
    facts = bins.groupBy(*scope).agg(
        F.sum("events").alias("n"), F.sum(F.col("events").cast("decimal(38,0)") * F.col("events")).cast("decimal(38,0)").alias("sq"),
        (floor_div(F.max("start_us") - F.min("start_us"), width) + 1).alias("bins"))
    rows = attach(bins, facts, scope, "f")

    def whole(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    def times(a: Column, b: Column) -> Column:
        return F.try_multiply(whole(a), whole(b))

    c, n, sq, b = F.col("events"), F.col("f.n"), F.col("f.sq"), F.col("f.bins")
    above = whole(times(b, c)) - whole(n)
    spread = whole(times(b, sq)) - whole(times(n, n))
    exact = times(times(above, above), b - 1) > times(times(F.lit(4), b), spread)
    mean = n / b
    variance = (sq.cast("double") - n.cast("double") * n.cast("double") / b) / (b - 1)
    close = c > mean + 2 * F.sqrt(variance)
    is_burst = (n >= 5) & (b > 1) & (c > mean) & (variance > 0) & F.coalesce(exact, close)
    bursts = rows.where(is_burst)
    # z = (c - mean) / sigma with both brought over B: sigma^2 = (B*sq - n^2) / (B*(B-1)).
    z = above.cast("double") / F.sqrt(b * (spread.cast("double") / (b - 1)))
    return bursts.select(
        *scope, as_time(F.col("start_us")).alias("burst_start"), as_time(F.col("start_us") + width).alias("burst_end"),
        "events", "errors", half_up_tenths(z).alias("z_score"),
        half_up_tenths(c * b.cast("double") / n).alias("rate_factor"))


def log_gaps(df: DataFrame, scope=(), multiplier: float = 5.0, min_gap_seconds: float = 60.0, limit: int = 10) -> DataFrame:
    """Silences of at least `multiplier` times the upper quartile of the distances between events.

    Equal times collapse first. Distances are then taken inside minutes, which hold a bounded number
    of different times, and between minutes, of which there are few; no task sees a whole scope.
    """
    times = with_scope(df, scope).where(F.col(S.MICROS).isNotNull()).groupBy(*scope, S.MICROS).agg(
        F.count(F.lit(1)).alias("copies")).withColumn("minute", floor_div(F.col(S.MICROS), MINUTE))
    inside = Window.partitionBy(*scope, "minute").orderBy(S.MICROS)
    linked = times.select(*scope, "minute", F.col(S.MICROS).alias("to_us"), "copies",
                          F.lag(S.MICROS).over(inside).alias("from_us"), F.lead(S.MICROS).over(inside).alias("_next"))
    # The first and the last time of every minute: at most two rows per minute of the span.
    edges = linked.where(F.col("from_us").isNull() | F.col("_next").isNull())
    minutes = edges.groupBy(*scope, "minute").agg(F.min("to_us").alias("to_us"), F.max("to_us").alias("_last"))
    minutes = minutes.withColumn("_day", floor_div(F.col("minute"), 1440))
    of_day = Window.partitionBy(*scope, "_day").orderBy("minute")
    between = minutes.select(*scope, F.lag("_last").over(of_day).alias("from_us"), "to_us")
    days = minutes.groupBy(*scope, "_day").agg(F.min("to_us").alias("to_us"), F.max("_last").alias("_last"))
    of_scope = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    across = days.select(*scope, F.lag("_last").over(of_scope.orderBy("_day")).alias("from_us"), "to_us")
    steps = linked.select(*scope, "from_us", "to_us").unionByName(between).unionByName(across)
    steps = steps.where(F.col("from_us").isNotNull()).withColumn("gap_us", F.col("to_us") - F.col("from_us"))
    repeats = times.where("copies > 1").select(*scope, F.lit(0).cast("bigint").alias("gap_us"), (F.col("copies") - 1).alias("w"))
    lengths = steps.select(*scope, "gap_us", F.lit(1).cast("bigint").alias("w")).unionByName(repeats)
    lengths = lengths.groupBy(*scope, "gap_us").agg(F.sum("w").alias("w"))
    quartile = exact_quantile(lengths, scope, "gap_us", "w", 3, "p75")
    # Gaps of the least length are few: the span of a scope divided by that length.
    wide = attach(steps.where(F.col("gap_us") >= micros(min_gap_seconds)), quartile, scope, "q")
    base = F.when(F.col("q.p75") > 0, F.col("q.p75")).otherwise(F.col("q.mean"))
    found = wide.withColumn("_base", base).where(
        (F.col("q.n") >= 2) & (F.col("_base") > 0)
        & (F.col("gap_us") >= F.greatest(F.col("_base") * multiplier, F.lit(float(micros(min_gap_seconds))))))
    top = top_k(found, scope, [F.col("gap_us").desc(), F.col("from_us").asc()], limit, "gap_rank")
    return top.select(
        *scope, "gap_rank", as_time(F.col("from_us")).alias("gap_from"), as_time(F.col("to_us")).alias("gap_to"),
        "gap_us", half_up_tenths(F.col("gap_us") / MINUTE).alias("gap_minutes"),
        half_up_tenths(F.col("gap_us") / F.col("_base")).alias("gap_factor"))


def error_density(df: DataFrame, scope=(), seconds: float = 60, steps: int = 24) -> DataFrame:
    """Events and errors of every bin of the span, empty ones as 0, and the bar length of each."""
    width = micros(seconds)
    bins = event_bins(df, scope, seconds)
    facts = bins.groupBy(*scope).agg(F.min("start_us").alias("lo"), F.max("start_us").alias("hi"),
                                     F.max("events").alias("peak"))
    block = width * 1440
    # Unfolded in two steps, so that no row holds all bins of a long span.
    blocks = facts.withColumn("block", F.explode(F.sequence("lo", "hi", F.lit(block))))
    last = F.least(F.col("block") + (block - width), F.col("hi"))
    grid = blocks.withColumn("start_us", F.explode(F.sequence("block", last, F.lit(width)))).drop("block", "lo", "hi")
    dense = grid.join(bins, [*scope, "start_us"], "left")
    events = F.coalesce("events", F.lit(0))
    bar = F.when(events > 0, F.greatest(F.floor(events / F.col("peak") * steps), F.lit(1))).otherwise(0).cast("int")
    return dense.select(*scope, as_time(F.col("start_us")).alias("bin_start"), events.alias("events"),
                        F.coalesce("errors", F.lit(0)).alias("errors"), bar.alias("bar"))


def event_chain(df: DataFrame, root: DataFrame, roles: Roles | None = None, scope=(), max_events: int = 12,
                gap_seconds: float = 30.0) -> DataFrame:
    """The anomalies around the root event: the last half before it, the rest from it on."""
    roles = roles or resolve_roles(df)
    (event_id,) = roles.need("event_id")
    half = max_events // 2
    keep = [c for c in (event_id, S.MICROS, S.LEVEL, roles.host, roles.message) if c]
    rows = with_scope(df, scope).where(F.col(S.IS_ANOMALY)).select(*dict.fromkeys([*scope, *keep]), S.TAGS)
    facts = root.select(*scope, F.col("root_micros").alias("t0"), "total_events")
    rows = attach(rows, facts, scope, "r", F.col(event_id), "total_events")
    rows = rows.withColumn("t0", F.col("r.t0")).drop("r")
    before = top_k(rows.where(F.col(S.MICROS) < F.col("t0")), scope,
                   [F.col(S.MICROS).desc(), F.col(event_id).desc()], half, "_rank")
    after = top_k(rows.where(F.col(S.MICROS) >= F.col("t0")), scope, time_order(roles), max_events, "_rank")
    # Both parts are at most max_events rows per scope, so ordering them again is cheap.
    both = before.withColumn("_side", F.lit(0)).unionByName(after.withColumn("_side", F.lit(1)))
    in_scope = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    both = both.withColumn("_n_before", F.count_if(F.col("_side") == 0).over(in_scope))
    both = both.where((F.col("_side") == 0) | (F.col("_rank") <= max_events - F.col("_n_before")))
    chain = in_scope.orderBy(*time_order(roles))
    gap = F.col(S.MICROS) - F.lag(S.MICROS).over(chain)
    marker = (F.when(F.col(S.MICROS) == F.col("t0"), "root")
              .when(F.col(S.LEVEL).isin("CRITICAL", "FATAL", "EMERG", "ALERT", "ERROR", "ERR"), "error").otherwise("other"))
    return both.withColumns({
        "position": F.row_number().over(chain), "marker": marker,
        "gap_before_us": F.when(gap >= micros(gap_seconds), gap)}).drop("_rank", "_side", "_n_before", "t0")
