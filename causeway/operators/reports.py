"""Tables a report is made of, and the records that go out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway import schema as S
from causeway.functions import levels
from causeway.functions.text import clip, row_to_text, table_cell
from causeway.functions.times import format_relative, format_ts
from causeway.operators import enrich, evidence, impact, incident, series
from causeway.operators.incident import beside
from causeway.operators.pseudonyms import pseudonymize
from causeway.plans.scaling import top_k, with_scope
from causeway.rules import DEFAULT_RULES, RuleSet
from causeway.schema import Roles, resolve_roles

VERSION = "1.0"


def timeline(df: DataFrame, roles: Roles | None = None, scope=(), max_rows: int = 30, min_level: str | None = None) -> DataFrame:
    """The first anomalies, or rows of a least level, with their texts fit for table cells."""
    roles = roles or resolve_roles(df)
    roles.need("event_id")
    rows = enrich.min_level(df, min_level) if min_level else df.where(F.col(S.IS_ANOMALY))
    rows = top_k(with_scope(rows, scope), scope, enrich.time_order(roles), max_rows, "row_no")
    shown = [c for c in S.display_columns(df) if c not in scope]
    cells = [table_cell(F.col(f"`{c}`")).alias(c) if c in S.text_columns(df) else F.col(f"`{c}`") for c in shown]
    return rows.select(*scope, "row_no", format_ts(F.col(S.MICROS)).alias("time_text"), *cells)


def top_raw_errors(df: DataFrame, roles: Roles | None = None, scope=(), n: int = 5) -> DataFrame:
    """The gravest errors, earliest first, with the raw line (500) or the fields (200 each)."""
    roles = roles or resolve_roles(df)
    (event_id,) = roles.need("event_id")
    errors = with_scope(df, scope).where(F.col(S.IS_ERROR)).withColumn("severity_rank", levels.severity_rank(F.col(S.LEVEL)))
    top = top_k(errors, scope, [F.col("severity_rank").desc(), *enrich.time_order(roles)], n, "row_no")
    fields = F.concat_ws("\n", *[
        F.concat(F.lit(f"{c}: "), clip(F.col(f"`{c}`").cast("string"), 200)) for c in S.display_columns(df)])
    extract = F.coalesce(clip(F.col(roles.raw), 500), fields) if roles.raw else fields
    return top.select(*scope, "row_no", event_id, format_ts(F.col(S.MICROS)).alias("time_text"), F.col(S.LEVEL).alias("level"),
                      "severity_rank", extract.alias("extract"))


def export_enriched(df: DataFrame) -> DataFrame:
    """The enriched table with its tag lists as `a|b`, fit for CSV."""
    return df.withColumn(S.TAGS, F.array_join(S.TAGS, "|"))


def write_enriched(df: DataFrame, path: str, fmt: str = "parquet", rebalance: bool = True) -> None:
    """Write by day, so that later reads of a time range skip the other days.

    Parquet keeps the tag lists, so that every operator runs on the table read back; CSV has them as `a|b`.

    Rows are brought together by day first, large days in several parts, so that few and well-sized
    files come out; leave that away where the input is already ordered by time.
    """
    out = (export_enriched(df) if fmt == "csv" else df).withColumn("event_date", F.to_date(S.EVENT_TIME))
    out = out.hint("rebalance", "event_date") if rebalance else out
    writer = out.write.partitionBy("event_date")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def narrative_facts(df: DataFrame, roles: Roles | None = None, scope=(), rules: RuleSet = DEFAULT_RULES,
                    burst_seconds: float = 30) -> DataFrame:
    """What a prose account of each incident needs, one row per scope, with a closing sentence."""
    roles = roles or resolve_roles(df)
    event_id, host, message = roles.need("event_id", "host", "message")
    row = incident.incident(df, roles, scope, rules=rules)

    def first_of(rows: DataFrame, prefix: str) -> DataFrame:
        place = F.struct(F.col(S.MICROS).isNull(), F.coalesce(S.MICROS, F.lit(0)), F.col(event_id))
        event = F.struct(F.col(S.MICROS).alias("us"), F.col(host).cast("string").alias("host"),
                         clip(F.coalesce(F.col(message), F.lit("")), 100).alias("message"))
        found = rows.groupBy(*scope).agg(F.min_by(event, place).alias("_e"))
        return found.select(*scope, F.col("_e.us").alias(f"{prefix}_us"), F.col("_e.host").alias(f"{prefix}_host"),
                            F.col("_e.message").alias(f"{prefix}_message"))

    known = with_scope(df, scope)
    row = beside(row, first_of(known.where(F.col(S.IS_WARNING)), "warning"), scope)
    row = beside(row, first_of(incident.precursors(df, row, roles, scope), "precursor"), scope)
    bursts = top_k(series.burst_windows(df, scope, burst_seconds), scope,
                   [F.col("events").desc(), F.col("burst_start").asc()], 1, "_r")
    row = beside(row, bursts.select(*scope, F.col("burst_start").alias("peak_start"), F.col("events").alias("peak_events")), scope)
    hosts = impact.recovery_timeline(df, roles, scope)
    worst = hosts.groupBy(*scope).agg(F.min_by(
        F.struct(F.col(host).cast("string").alias("host"), "errors", "downtime"),
        F.struct(-F.col("errors"), "first_error_us", host)).alias("_w"))
    row = beside(row, worst.select(*scope, F.col("_w.host").alias("worst_host"), F.col("_w.errors").alias("worst_host_errors"),
                                   F.col("_w.downtime").alias("worst_host_downtime")), scope)
    t0 = F.col("root_micros")
    sentence = F.concat(
        F.lit("First error at "), format_ts(t0), F.lit(" on "), F.coalesce("root_host", F.lit("N/A")),
        F.lit(", followed by "), F.col("cascade_count").cast("string"), F.lit(" errors; "),
        F.coalesce(F.concat(F.lit("recovered after "), F.col("mttr_text")), F.lit("no recovery seen")))
    return row.select(
        *scope, format_relative(F.col("warning_us"), t0).alias("first_warning"), "warning_host", "warning_message",
        format_ts(t0).alias("root_time"), "root_host", "root_level", F.array_join(F.slice("root_tags", 1, 3), "|").alias("root_tags"),
        "cascade_count", "precursor_count", format_relative(F.col("precursor_us"), t0).alias("first_precursor"),
        "precursor_host", "peak_start", "peak_events", "mttr_text", "worst_host", "worst_host_errors",
        "worst_host_downtime", "confidence", "confidence_reason", sentence.alias("sentence"))


def incident_summary(df: DataFrame, roles: Roles | None = None, scope=(), flow_key: str | None = None,
                     rules: RuleSet = DEFAULT_RULES, source: str | None = None, burst_seconds: float = 30,
                     report_path: str | None = None, row: DataFrame | None = None) -> DataFrame:
    """One nested record per incident; `row` is the result of `incident` where it has been computed.

    Evidence and host lists are whole. Pass an enriched table that has been written, since it is read
    once per part.
    """
    from causeway.sources.files import table_fingerprint

    roles = roles or resolve_roles(df)
    (host,) = roles.need("host")
    row = incident.incident(df, roles, scope, flow_key, rules) if row is None else row
    known = with_scope(df, scope)
    hosts = known.select(*scope, F.col(host).alias("_h")).distinct().groupBy(*scope).agg(F.count("_h").alias("host_count"))
    bursts = series.burst_windows(df, scope, burst_seconds).groupBy(*scope).agg(F.count(F.lit(1)).alias("burst_count"))
    gaps = series.log_gaps(df, scope).groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(
        "gap_rank", "gap_from", "gap_to", "gap_minutes", "gap_factor"))).alias("log_gaps"))
    columns = [c for c in S.display_columns(df) if c != roles.event_id]
    downs = impact.recovery_timeline(df, roles, scope).groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(
        "first_error_us", F.col(host).cast("string").alias("host"), format_ts(F.col("first_error_us")).alias("first_error"),
        format_ts(F.col("first_recovery_us")).alias("first_recovery"), "downtime", "errors"))).alias("recovery_timeline"))
    found = evidence.evidence_summary(evidence.network_evidence(df, scope), scope, shown=None)
    found = found.groupBy(*scope).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "distinct_values")))).alias("evidence_counts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "shown_values")))).alias("network_evidence"))
    prints = table_fingerprint(known, S.source_columns(df), scope)
    for part in (hosts, impact.worst_service_status(df, roles, scope), incident.trend(df, scope).drop(
            "first_events", "first_errors", "second_events", "second_errors"), bursts, gaps,
            impact.duplicate_count(df, columns, scope), downs, found, prints, impact.tag_sets(df, scope, rules)):
        row = beside(row, part, scope)
    return row.select(
        *scope, F.lit(VERSION).alias("version"), F.concat(F.lit("IR-"), "incident_id").alias("incident_id"),
        F.current_timestamp().alias("analyzed_at"), F.lit(source).alias("source_file"), "sha256",
        "total_events", "error_events", "warning_events", "anomaly_events", "host_count", "precursor_count",
        F.struct(F.col("severity_score").alias("score"), F.col("severity_grade").alias("grade"), F.struct(
            F.col("part_error_ratio").alias("error_ratio"), F.col("part_cascade_depth").alias("cascade_depth"),
            F.col("part_mttr").alias("mttr_factor"), F.col("part_pattern_weight").alias("pattern_weight"),
        ).alias("components")).alias("severity"),
        F.struct("trend", "first_error_pct", "second_error_pct").alias("trend"),
        F.col("service_status").alias("service_impact"), (F.col("mttr_us") / 1_000_000).alias("mttr_seconds"),
        "cascade_count", format_ts(F.col("root_micros")).alias("root_cause_ts"), F.col("root_level").alias("root_cause_level"),
        F.coalesce("root_host", F.lit("N/A")).alias("root_cause_host"), F.col("root_tags").alias("root_cause_tags"),
        "playbook_patterns", "evidence_counts", "network_evidence", F.coalesce("burst_count", F.lit(0)).alias("burst_count"),
        "log_gaps", "duplicate_count", "recovery_timeline", F.lit(report_path).alias("report_path"),
        F.struct(F.lit(False).alias("enabled"), F.lit("disabled").alias("status")).alias("model_review"))


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON record per incident."""
    summary.write.option("ignoreNullFields", False).json(path)


def flat_summary(summary: DataFrame, scope=()) -> DataFrame:
    """The scalar part of the summary."""
    return summary.select(
        *scope, "incident_id", "total_events", "error_events", "warning_events", "anomaly_events", "host_count",
        "precursor_count", F.col("severity.score").alias("severity_score"), F.col("severity.grade").alias("severity_grade"),
        F.col("trend.trend").alias("trend"), "service_impact", "mttr_seconds", "cascade_count", "root_cause_ts",
        "root_cause_level", "root_cause_host", F.array_join("root_cause_tags", "|").alias("root_cause_tags"),
        F.array_join("playbook_patterns", "|").alias("playbook_patterns"), "burst_count",
        F.coalesce(F.size("log_gaps"), F.lit(0)).alias("gap_count"), "duplicate_count",
        F.coalesce(F.size("recovery_timeline"), F.lit(0)).alias("hosts_with_errors"))


def alert_feed(df: DataFrame, roles: Roles | None = None, scope=(), rules: RuleSet = DEFAULT_RULES,
               source: str | None = None, report_path: str | None = None) -> DataFrame:
    """The compact alert record per incident, to be written to a table or a message sink."""
    from causeway.sources.files import table_fingerprint

    roles = roles or resolve_roles(df)
    row = incident.incident(df, roles, scope, rules=rules)
    row = beside(row, table_fingerprint(with_scope(df, scope), S.source_columns(df), scope), scope)
    return row.select(
        *scope, F.concat(F.lit("IR-"), "incident_id").alias("incident_id"), F.current_timestamp().alias("analyzed_at"),
        F.lit(source).alias("source_file"), "severity_grade", "severity_score", "total_events", "error_events",
        (F.col("mttr_us") / 1_000_000).alias("mttr_seconds"), "cascade_count", format_ts(F.col("root_micros")).alias("root_cause_ts"),
        F.coalesce("root_host", F.lit("N/A")).alias("root_cause_host"), F.array_join("root_tags", "|").alias("root_cause_tags"),
        F.lit(report_path).alias("report_path"), F.lit(VERSION).alias("tool_version"))


def model_events(df: DataFrame, roles: Roles | None = None, scope=(), max_events: int = 30, sanitize: bool = True) -> DataFrame:
    """The first errors of each scope (or first events, where there are none) as texts for a model."""
    roles = roles or resolve_roles(df)
    shown = S.display_columns(df)
    rows = with_scope(df, scope).select(*dict.fromkeys([
        *scope, *roles.need("event_id"), S.MICROS, S.LEVEL, S.TAGS, S.IS_ERROR, *shown]))
    top = top_k(rows, scope, [F.col(S.IS_ERROR).desc(), *enrich.time_order(roles)], max_events, "event_no")
    whole = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    # At most max_events rows per scope reach this window.
    top = top.withColumn("_any", F.max(S.IS_ERROR).over(whole)).where(F.col(S.IS_ERROR) | ~F.col("_any"))
    top = top.select(*scope, F.col("event_no").cast("bigint").alias("event_no"), format_ts(F.col(S.MICROS)).alias("ts"),
                     F.col(S.LEVEL).alias("level"), F.col(S.TAGS).alias("tags"), row_to_text(shown).alias("raw"))
    return pseudonymize(top, "raw", "event_no", scope)[0] if sanitize else top


def bursts_ordered(bursts: DataFrame, scope=()) -> DataFrame:
    """Busiest first, then by time: the order of a report."""
    return bursts.orderBy(*scope, F.col("events").desc(), F.col("burst_start").asc())


def root_report(df: DataFrame, roles: Roles | None = None, scope=(), rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Root tags and the tags of errors side by side: the input of cause list and playbook."""
    root = incident.root_cause(df, roles, scope, rules=rules)
    return beside(root, impact.tag_sets(df, scope, rules), scope)


