"""Counts per host, service, flow and tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway import schema as S
from causeway.functions.text import normalize_message
from causeway.functions.times import floor_div, format_duration
from causeway.operators.incident import beside
from causeway.plans.scaling import attach, top_k, with_scope
from causeway.rules import DEFAULT_RULES, FLOW_KEY_CANDIDATES, RECOVERY_MARKER_TAGS, RuleSet
from causeway.schema import Roles, resolve_roles


def percent_tenths(part: Column, whole: Column) -> Column:
    """Tenths of a percent, rounded half up in whole numbers."""
    return floor_div(part * 2000 + whole, whole * 2)


def _status(down: Column, degraded: Column) -> Column:
    return F.when(down, "DOWN").when(degraded, "DEGRADED").otherwise("OK")


def _counts(df: DataFrame, keys) -> DataFrame:
    return with_scope(df, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(S.IS_ERROR).alias("errors"),
        F.count_if(S.IS_WARNING).alias("warnings"), F.count_if(S.IS_ANOMALY).alias("anomalies"),
        F.count_if(S.IS_RECOVERY).alias("recoveries"))


def _tenths(name: str) -> Column:
    return (percent_tenths(F.col(name), F.col("total")) / 10).cast("double")


def host_impact(df: DataFrame, roles: Roles | None = None, scope=()) -> DataFrame:
    """Counts and status per host; the status looks at percentages rounded to tenths."""
    (host,) = (roles or resolve_roles(df)).need("host")
    keys = list(dict.fromkeys([*scope, host]))
    out = _counts(df, keys).withColumns({"err_pct": _tenths("errors"), "warn_pct": _tenths("warnings")})
    e, w = percent_tenths(F.col("errors"), F.col("total")), percent_tenths(F.col("warnings"), F.col("total"))
    return out.withColumn("status", _status(e >= 500, (e >= 150) | (w >= 250)))


def service_impact(df: DataFrame, roles: Roles | None = None, scope=()) -> DataFrame:
    """Counts and status per service; the status looks at exact percentages."""
    (service,) = (roles or resolve_roles(df)).need("service")
    keys = list(dict.fromkeys([*scope, service]))
    e, w, n = F.col("errors"), F.col("warnings"), F.col("total")
    status = _status(e * 100 >= n * 50, (e * 100 >= n * 15) | (w * 100 >= n * 25))
    return _counts(df, keys).select(*keys, "total", "errors", "warnings", _tenths("errors").alias("err_pct"),
                                    status.alias("status"))


def worst_service_status(df: DataFrame, roles: Roles | None = None, scope=()) -> DataFrame:
    """DOWN over DEGRADED over OK; UNKNOWN where no column tells services apart."""
    roles = roles or resolve_roles(df)
    if roles.service is None:
        return with_scope(df, scope).groupBy(*scope).agg(F.lit("UNKNOWN").alias("service_status"))
    worst = F.max(F.when(F.col("status") == "DOWN", 2).when(F.col("status") == "DEGRADED", 1).otherwise(0))
    ranked = service_impact(df, roles, scope).groupBy(*scope).agg(worst.alias("_worst"))
    return ranked.select(*scope, F.when(F.col("_worst") == 2, "DOWN").when(F.col("_worst") == 1, "DEGRADED")
                         .otherwise("OK").alias("service_status"))


def source_breakdown(df: DataFrame, roles: Roles | None = None, scope=()) -> DataFrame:
    """Totals and error share per service."""
    (service,) = (roles or resolve_roles(df)).need("service")
    keys = list(dict.fromkeys([*scope, service]))
    return _counts(df, keys).select(*keys, "total", "errors", "warnings", _tenths("errors").alias("err_pct"))


def flow_summary(df: DataFrame, flow_key: str, scope=(), limit: int = 15) -> DataFrame:
    """The flows with the most errors."""
    counts = _counts(df, [*scope, flow_key]).drop("recoveries")
    return top_k(counts, scope, [F.col("errors").desc(), F.col(flow_key).asc()], limit, "flow_rank")


def flow_matrix(df: DataFrame, roles: Roles | None = None, scope=(), limit: int = 20) -> DataFrame:
    """The (source, destination) pairs with the most errors."""
    src, dst = (roles or resolve_roles(df)).need("src", "dst")
    counts = _counts(df, [*scope, src, dst]).select(*scope, src, dst, "total", "errors", _tenths("errors").alias("err_pct"))
    return top_k(counts, scope, [F.col("errors").desc(), F.col(src).asc(), F.col(dst).asc()], limit, "pair_rank")


def _tag_lists(df: DataFrame, scope) -> DataFrame:
    """Events per distinct tag list: events collapse before anything is unfolded."""
    return (with_scope(df, scope).where(F.size(S.TAGS) > 0).groupBy(*scope, S.TAGS)
            .agg(F.count(F.lit(1)).alias("n")))


def _label(tag: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.element_at(F.create_map(*pairs), tag) if pairs else F.lit(None).cast("string")


def anomaly_breakdown(df: DataFrame, scope=(), rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Events per tag."""
    one = _tag_lists(df, scope).select(*scope, "n", F.explode(S.TAGS).alias("tag"))
    return one.groupBy(*scope, "tag").agg(F.sum("n").alias("events")).withColumn("label", _label(F.col("tag"), rules.labels))


def tag_cooccurrence(df: DataFrame, scope=(), rules: RuleSet = DEFAULT_RULES, limit: int = 10) -> DataFrame:
    """Pairs of tags by the number of events that carry both; ties in rule order."""
    tags = F.col(S.TAGS)
    # Pairs of one short tag list (at most one tag per rule), made once per distinct list.
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(tags) - 1), lambda i: F.transform(
        F.slice(tags, i + 1, F.size(tags)), lambda second: F.struct(
            F.element_at(tags, i).alias("tag_a"), second.alias("tag_b")))))
    rows = _tag_lists(df, scope).where(F.size(tags) > 1).select(*scope, "n", F.explode(pairs).alias("p"))
    counts = rows.groupBy(*scope, F.col("p.tag_a").alias("tag_a"), F.col("p.tag_b").alias("tag_b")).agg(
        F.sum("n").alias("events"))
    place = F.array(*[F.lit(t) for t in rules.tags])
    order = [F.col("events").desc(), F.array_position(place, F.col("tag_a")), F.array_position(place, F.col("tag_b"))]
    return top_k(counts, scope, order, limit, "pair_rank")


def duplicate_count(df: DataFrame, columns: list[str] | None = None, scope=()) -> DataFrame:
    """Rows beyond the first of each group of equal rows; by default over the display columns but the event id."""
    if columns is None:
        event_id = resolve_roles(df).event_id
        columns = [c for c in S.display_columns(df) if c != event_id]
    groups = with_scope(df, scope).groupBy(*dict.fromkeys([*scope, *columns])).agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy(*scope).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))


def recovery_timeline(df: DataFrame, roles: Roles | None = None, scope=(), after_error: bool = False) -> DataFrame:
    """First error and first recovery per host with errors.

    The recovery is the earliest of the host even when it lies before the error (the downtime is
    then negative); with `after_error` only later recoveries count.
    """
    (host,) = (roles or resolve_roles(df)).need("host")
    keys = list(dict.fromkeys([*scope, host]))
    df = with_scope(df, keys)
    per_host = df.groupBy(*keys).agg(
        F.count_if(S.IS_ERROR).alias("errors"), F.count_if(S.IS_RECOVERY).alias("recoveries"),
        F.min(F.when(F.col(S.IS_ERROR), F.col(S.MICROS))).alias("first_error_us"),
        F.min(F.when(F.col(S.IS_RECOVERY), F.col(S.MICROS))).alias("first_recovery_us")).where("errors > 0")
    if after_error:
        recoveries = df.where(F.col(S.IS_RECOVERY)).select(*keys, S.MICROS)
        known = attach(recoveries, per_host.select(*keys, "first_error_us", "recoveries"), keys, "h", F.col(S.MICROS), "recoveries")
        later = known.where(F.col(S.MICROS) > F.col("h.first_error_us")).groupBy(*keys).agg(
            F.min(S.MICROS).alias("first_recovery_us"))
        per_host = per_host.drop("first_recovery_us").join(later, keys, "left")
    down = F.col("first_recovery_us") - F.col("first_error_us")
    return per_host.drop("recoveries").withColumns({"downtime_us": down, "downtime": F.coalesce(format_duration(down), F.lit("N/D"))})


def top_error_messages(df: DataFrame, roles: Roles | None = None, scope=(), top_n: int = 5) -> DataFrame:
    """The most frequent normalised messages of error rows, and whether none occurs twice."""
    (message,) = (roles or resolve_roles(df)).need("error_message")
    errors = with_scope(df, scope).where(F.col(S.IS_ERROR) & F.col(message).isNotNull())
    counts = errors.groupBy(*scope, normalize_message(F.col(message)).alias("message_pattern")).agg(
        F.count(F.lit(1)).alias("occurrences"))
    top = top_k(counts, scope, [F.col("occurrences").desc(), F.col("message_pattern").asc()], top_n, "message_rank")
    if not scope:
        most = counts.agg(F.max("occurrences").alias("most"))
        return attach(top, most, (), "_m").withColumn("all_unique", F.col("_m.most") == 1).drop("_m")
    most = counts.groupBy(*scope).agg((F.max("occurrences") == 1).alias("all_unique"))
    return top.join(most, list(scope))


def top_error_tags(df: DataFrame, scope=(), top: int = 5, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The most frequent tags of error rows; ties in rule order."""
    lists = _tag_lists(df.where(F.col(S.IS_ERROR)), scope)
    counts = lists.select(*scope, "n", F.explode(S.TAGS).alias("tag")).groupBy(*scope, "tag").agg(F.sum("n").alias("events"))
    place = F.array(*[F.lit(t) for t in rules.tags])
    return top_k(counts, scope, [F.col("events").desc(), F.array_position(place, F.col("tag"))], top, "tag_rank")


def tag_sets(df: DataFrame, scope=(), rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Sorted tags per scope: of error rows that are no recovery, of all rows but the markers of a
    recovery, and the ones with response steps. At most one entry per rule."""
    hard = F.col(S.IS_ERROR) & ~F.col(S.IS_RECOVERY)
    lists = with_scope(df, scope).groupBy(*scope, S.TAGS, hard.alias("_hard")).agg(F.count(F.lit(1)).alias("_n"))
    one = lists.select(*scope, "_hard", F.explode_outer(S.TAGS).alias("tag"))
    error_only = F.sort_array(F.collect_set(F.when(F.col("_hard"), F.col("tag"))))
    alert = F.sort_array(F.collect_set(F.when(~F.col("tag").isin(*RECOVERY_MARKER_TAGS), F.col("tag"))))
    mapped = F.array(*[F.lit(t) for t in rules.steps]) if rules.steps else F.array().cast("array<string>")
    return one.groupBy(*scope).agg(error_only.alias("error_only_tags"), alert.alias("alert_tags")).withColumn(
        "playbook_patterns", F.array_intersect("error_only_tags", mapped))


def overview(df: DataFrame, roles: Roles | None = None, scope=(), flow_key: str | None = None) -> DataFrame:
    """Totals, distinct flows and hosts, time span and class of each scope."""
    roles = roles or resolve_roles(df)
    df = with_scope(df, scope)
    totals = df.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(S.IS_ERROR).alias("error_events"),
        F.count_if(S.IS_WARNING).alias("warning_events"), F.count_if(S.IS_ANOMALY).alias("anomaly_events"),
        F.min(S.MICROS).alias("first_us"), F.max(S.MICROS).alias("last_us"))
    for column, name in ((flow_key, "unique_flows"), (roles.host, "host_count")):
        if column is not None:
            values = df.select(*scope, F.col(f"`{column}`").alias("_value")).distinct()
            totals = beside(totals, values.groupBy(*scope).agg(F.count("_value").alias(name)), scope)
    duration = F.col("last_us") - F.col("first_us")
    label = (F.when(F.col("error_events") > 0, "ERROR").when(F.col("warning_events") > 0, "WARNING").otherwise("INFO"))
    share = F.when(F.col("total_events") > 0, percent_tenths(F.col("anomaly_events"), F.col("total_events")) / 10)
    return totals.withColumns({"anomaly_pct": share.cast("double"), "duration_us": duration,
                               "duration": format_duration(duration), "event_class": label})


def flow_key_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows and exact distinct values of every column that could tell flows apart.

    All columns are unpivoted into (column, value) and counted in one shuffle; repeated values
    collapse before it.
    """
    columns = columns or [c for c in S.source_columns(df) if c.lower() in FLOW_KEY_CANDIDATES or c in S.text_columns(df)]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"))
                                for c in columns])).alias("cell")
    values = df.select(cells).groupBy("cell.column_name", "cell.value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("column_name").agg(F.sum("n").alias("total"), F.count("value").alias("distinct_values"))


def detect_flow_key(df: DataFrame, hint: str | None = None) -> str | None:
    """The hint; else the first candidate that repeats but is no constant; else a short text column."""
    if hint is not None:
        if hint not in df.columns:
            raise S.MissingRole(f"no such flow column: {hint}")
        return hint
    names = [c for c in S.source_columns(df) if c.lower() in FLOW_KEY_CANDIDATES]
    counts = _profile(df, names)
    for candidate in FLOW_KEY_CANDIDATES:
        for c in sorted(counts, key=lambda name: name != candidate):
            if c.lower() == candidate and 1 < counts[c][1] < counts[c][0] * 0.9:
                return c
    texts = [c for c in S.text_columns(df) if not c.startswith("_")]
    counts = _profile(df, texts)
    return next((c for c in texts if c in counts and 1 < counts[c][1] <= 500), None)


def _profile(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """One row per column, so the result is as small as the schema."""
    rows = flow_key_profile(df, columns).collect() if columns else []
    return {r.column_name: (r.total, r.distinct_values) for r in rows}
