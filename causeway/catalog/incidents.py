"""Root cause, cascade, recovery, severity, confidence, service level and trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway import schema as S
from causeway.catalog.logview import EN, LV, enriched, log_view, unzoned
from causeway.catalog.registry import query
from causeway.catalog.scalars import duration_sql
from causeway.operators import incident as ops
from causeway.operators.enrich import enrich_levels
from causeway.rules import GRADE_FLOORS, SLA_SECONDS

HOST = ["host"]


def root_ctes(scope: list[str], cascade_us: int = 300_000_000, precursor_us: int = 600_000_000) -> str:
    """CTEs `rt` (root row and totals per scope) and `af` (cascade, precursors, recovery)."""
    part = f"PARTITION BY {', '.join(scope)}" if scope else ""
    keys = "".join(f"{c}, " for c in scope)
    group = f"GROUP BY {', '.join(scope)}" if scope else ""
    on = " AND ".join(f"e.{c} = r.{c}" for c in scope) or "TRUE"
    return f"""{EN}, ranked AS (SELECT *, row_number() OVER ({part} ORDER BY
        CASE WHEN is_error THEN 0 WHEN is_warning THEN 1 ELSE 2 END, us NULLS LAST, event_id) AS rn FROM en),
    tot AS (SELECT {keys}count(*) AS total_events, count(*) FILTER (is_error) AS error_events,
        count(*) FILTER (is_warning) AS warning_events, count(*) FILTER (is_anomaly) AS anomaly_events,
        bool_or(lvl = 'CRITICAL') AS has_critical,
        bool_or(f_oom_killer OR f_kernel_panic OR f_segfault OR f_disk_full OR f_certificate) AS has_high FROM en {group}),
    rt AS (SELECT r.event_id AS root_event_id, r.us AS t0, r.lvl AS root_level, r.tags AS root_tags, r.message AS root_message,
        r.host AS root_host, r.session_id AS root_flow, e.* FROM ranked r JOIN tot e ON {on} WHERE r.rn = 1),
    af AS (SELECT {''.join(f'r.{c}, ' for c in scope)}count(*) FILTER (e.is_error AND e.us > t0 AND e.us <= t0 + {cascade_us}) AS cascade_count,
        count(*) FILTER ((e.is_anomaly OR e.is_warning) AND e.us >= t0 - {precursor_us} AND e.us < t0) AS precursor_count,
        min(CASE WHEN e.is_recovery AND e.us > t0 THEN e.us - t0 END) AS mttr_us
        FROM en e JOIN rt r ON {on} {'GROUP BY ' + ', '.join('r.' + c for c in scope) if scope else ''}),
    inc AS (SELECT e.*, r.cascade_count, r.precursor_count, r.mttr_us FROM rt e JOIN af r ON {on}),
    w AS (SELECT *, least(CASE WHEN has_critical THEN 15 ELSE 0 END + CASE WHEN has_high THEN 10 ELSE 0 END, 25) AS weight FROM inc),
    sc AS (SELECT *, CAST(floor(least(error_events / total_events, 1.0::DOUBLE) * 25
        + least(cascade_count / greatest(total_events * 0.5::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE) * 25
        + CASE WHEN mttr_us IS NULL THEN 15.0::DOUBLE ELSE least(mttr_us / 1000000 / 3600, 1.0::DOUBLE) * 25 END + weight) AS INTEGER) AS severity_score FROM w),
    gr AS (SELECT *, CASE {' '.join(f"WHEN severity_score >= {f} THEN '{g}'" for g, f in GRADE_FLOORS.items())} ELSE 'P5' END AS severity_grade FROM sc),
    cf AS (SELECT *, CASE
        WHEN root_level IN ('CRITICAL', 'FATAL', 'EMERG', 'ALERT') AND len(root_tags) >= 1 THEN 'critical_with_tags'
        WHEN root_level = 'ERROR' AND cascade_count >= 5 THEN 'error_deep_cascade'
        WHEN root_level = 'ERROR' AND len(root_tags) >= 2 AND cascade_count >= 3 THEN 'error_tags_and_cascade'
        WHEN root_level IN ('CRITICAL', 'FATAL') AND len(root_tags) = 0 THEN 'critical_without_tags'
        WHEN root_level = 'ERROR' AND len(root_tags) >= 1 THEN 'error_with_tags'
        WHEN root_level = 'ERROR' THEN 'error_without_tags' ELSE 'other_level' END AS confidence_reason FROM gr),
    fin AS (SELECT *, CASE WHEN confidence_reason IN ('critical_with_tags', 'error_deep_cascade', 'error_tags_and_cascade') THEN 'HIGH'
        WHEN confidence_reason = 'other_level' THEN 'LOW' ELSE 'MEDIUM' END AS confidence,
        CASE severity_grade {' '.join(f"WHEN '{g}' THEN {s}" for g, s in SLA_SECONDS.items())} END AS sla_seconds FROM cf)"""


ROOT_COLUMNS = "root_event_id, make_timestamp(t0) AS root_ts, root_level, root_host, root_message, array_to_string(root_tags, '|') AS root_tags, root_flow"
PARTS_SQL = """CAST((500 * error_events + total_events) // (2 * total_events) / 10 AS DOUBLE) AS part_error_ratio,
    CAST(least(CASE WHEN total_events >= 2 THEN (1000 * cascade_count + total_events) // (2 * total_events) ELSE 250 * cascade_count END, 250) / 10 AS DOUBLE) AS part_cascade_depth,
    CAST(CASE WHEN mttr_us IS NULL THEN 150 ELSE least((500 * mttr_us + 3600000000) // 7200000000, 250) END / 10 AS DOUBLE) AS part_mttr,
    CAST(weight AS DOUBLE) AS part_pattern_weight"""
SIX_HOURS = 21_600_000_000


def _root(df, scope):
    return ops.root_cause(df, scope=scope, flow_key="session_id")


def _shown(df):
    """Root columns as the SQL side gives them."""
    return unzoned(df.withColumn("root_ts", F.timestamp_micros("root_micros")).withColumn(
        "root_tags", F.array_join("root_tags", "|")).drop("root_micros"))


@query("incident", f"""WITH {root_ctes(HOST)} SELECT host, total_events, error_events, warning_events, anomaly_events, {ROOT_COLUMNS},
    cascade_count, precursor_count, mttr_us, severity_score, severity_grade, confidence, confidence_reason,
    mttr_us > sla_seconds::BIGINT * 1000000 AS sla_breach FROM fin""")
def _(spark, sf_dir):
    row = _shown(ops.incident(enriched(spark, sf_dir), scope=HOST, flow_key="session_id"))
    return row.select("host", "total_events", "error_events", "warning_events", "anomaly_events", "root_event_id", "root_ts",
                      "root_level", "root_host", "root_message", "root_tags", "root_flow", "cascade_count", "precursor_count",
                      "mttr_us", "severity_score", "severity_grade", "confidence", "confidence_reason", "sla_breach")


@query("root_cause", f"WITH {root_ctes(HOST)} SELECT host, {ROOT_COLUMNS} FROM rt")
def _(spark, sf_dir):
    return _shown(_root(enriched(spark, sf_dir), HOST)).select(
        "host", "root_event_id", "root_ts", "root_level", "root_host", "root_message", "root_tags", "root_flow")


@query("root_cause_global", f"WITH {root_ctes([])} SELECT {ROOT_COLUMNS} FROM rt")
def _(spark, sf_dir):
    return _shown(_root(enriched(spark, sf_dir), [])).select(
        "root_event_id", "root_ts", "root_level", "root_host", "root_message", "root_tags", "root_flow")


@query("precursors", f"""WITH {root_ctes(HOST)} SELECT e.host, e.event_id, e.message, r.t0 - e.us AS before_us FROM en e JOIN rt r USING (host)
    WHERE (e.is_anomaly OR e.is_warning) AND e.us >= t0 - {SIX_HOURS} AND e.us < t0""")
def _(spark, sf_dir):
    df = enriched(spark, sf_dir)
    rows = ops.precursors(df, _root(df, HOST), scope=HOST, minutes=360)
    return rows.select("host", "event_id", "message", (F.col("t0") - F.col(S.MICROS)).alias("before_us"))


@query("cascade", f"""WITH {root_ctes(HOST)} SELECT e.host, e.event_id, e.message, e.us - r.t0 AS after_us FROM en e JOIN rt r USING (host)
    WHERE e.is_error AND e.us > t0 AND e.us <= t0 + {SIX_HOURS}""")
def _(spark, sf_dir):
    df = enriched(spark, sf_dir)
    rows = ops.cascade(df, _root(df, HOST), scope=HOST, minutes=360)
    return rows.select("host", "event_id", "message", (F.col(S.MICROS) - F.col("t0")).alias("after_us"))


@query("precursors_10_minutes", f"""WITH {root_ctes(['session_id'])} SELECT e.session_id, e.event_id, e.message, r.t0 - e.us AS before_us FROM en e JOIN rt r USING (session_id)
    WHERE (e.is_anomaly OR e.is_warning) AND e.us >= t0 - 600000000 AND e.us < t0""")
def _(spark, sf_dir):
    df = enriched(spark, sf_dir)
    rows = ops.precursors(df, _root(df, ["session_id"]), scope=["session_id"])
    return rows.select("session_id", "event_id", "message", (F.col("t0") - F.col(S.MICROS)).alias("before_us"))


@query("cascade_5_minutes", f"""WITH {root_ctes(['sourcetype'])} SELECT e.sourcetype, e.event_id, e.message, e.us - r.t0 AS after_us FROM en e JOIN rt r USING (sourcetype)
    WHERE e.is_error AND e.us > t0 AND e.us <= t0 + 300000000""")
def _(spark, sf_dir):
    df = enriched(spark, sf_dir)
    rows = ops.cascade(df, _root(df, ["sourcetype"]), scope=["sourcetype"])
    return rows.select("sourcetype", "event_id", "message", (F.col(S.MICROS) - F.col("t0")).alias("after_us"))


@query("cascade_count", f"WITH {root_ctes(HOST, SIX_HOURS, SIX_HOURS)} SELECT host, cascade_count, precursor_count FROM af")
def _(spark, sf_dir):
    df = enriched(spark, sf_dir)
    return ops.aftermath(df, _root(df, HOST), scope=HOST, cascade_minutes=360, precursor_minutes=360).drop("mttr_us")


@query("cascade_count_global", f"WITH {root_ctes([])} SELECT cascade_count, precursor_count FROM af")
def _(spark, sf_dir):
    df = enriched(spark, sf_dir)
    return ops.aftermath(df, _root(df, []), scope=[]).drop("mttr_us")


@query("mttr", f"WITH {root_ctes(HOST)} SELECT host, mttr_us, {duration_sql('mttr_us')} AS mttr_text FROM inc")
def _(spark, sf_dir):
    from causeway.functions.times import format_duration

    df = enriched(spark, sf_dir)
    found = ops.mttr(df, _root(df, HOST), scope=HOST)
    return found.select("host", "mttr_us", format_duration(F.col("mttr_us")).alias("mttr_text"))


def _all_errors_sql(scope: list[str]) -> str:
    keys, group = "".join(f"{c}, " for c in scope), f"GROUP BY {', '.join(scope)}" if scope else ""
    same = "".join(f"e.{c} = r.{c} AND " for c in scope)
    return f"""WITH {EN}, e AS (SELECT * FROM en WHERE is_error), r AS (SELECT * FROM en WHERE is_recovery),
    n AS (SELECT {''.join(f'e.{c}, ' for c in scope)}r.us - e.us AS wait FROM e ASOF LEFT JOIN r ON {same}e.us < r.us)
    SELECT {keys}count(*) AS errors, count(wait) AS recovered, sum(wait)::DOUBLE / nullif(count(wait), 0) AS mean_mttr_us, max(wait) AS longest_mttr_us FROM n {group}"""


@query("mttr_all_errors", _all_errors_sql(HOST))
def _(spark, sf_dir):
    return ops.mttr_all_errors(enriched(spark, sf_dir), HOST)


@query("mttr_all_errors_global", _all_errors_sql([]))
def _(spark, sf_dir):
    return ops.mttr_all_errors(enriched(spark, sf_dir))


@query("severity_score", f"WITH {root_ctes(HOST)} SELECT host, severity_score, severity_grade, {PARTS_SQL} FROM fin")
def _(spark, sf_dir):
    return ops.incident(enriched(spark, sf_dir), scope=HOST).select(
        "host", "severity_score", "severity_grade", "part_error_ratio", "part_cascade_depth", "part_mttr", "part_pattern_weight")


@query("severity_score_per_flow", f"WITH {root_ctes(['session_id'])} SELECT session_id, severity_score, severity_grade, {PARTS_SQL} FROM fin")
def _(spark, sf_dir):
    return ops.incident(enriched(spark, sf_dir), scope=["session_id"]).select(
        "session_id", "severity_score", "severity_grade", "part_error_ratio", "part_cascade_depth", "part_mttr", "part_pattern_weight")


@query("root_cause_confidence", f"WITH {root_ctes(HOST)} SELECT host, confidence, confidence_reason FROM fin")
def _(spark, sf_dir):
    return ops.incident(enriched(spark, sf_dir), scope=HOST).select("host", "confidence", "confidence_reason")


@query("sla_breach", f"WITH {root_ctes(HOST)} SELECT host, severity_grade, sla_seconds, mttr_us > sla_seconds::BIGINT * 1000000 AS sla_breach FROM fin")
def _(spark, sf_dir):
    return ops.incident(enriched(spark, sf_dir), scope=HOST).select("host", "severity_grade", "sla_seconds", "sla_breach")


@query("trend", f"""WITH {LV}, lev AS (SELECT *, upper(trim(log_level)) IN ('CRITICAL', 'ERR', 'ERROR') AS is_error FROM lv),
    sp AS (SELECT host, min(us) + max(us) AS twice FROM lev GROUP BY host),
    h AS (SELECT host, count(*) FILTER (2 * us < twice) AS first_events, count(*) FILTER (2 * us < twice AND is_error) AS first_errors,
        count(*) FILTER (2 * us >= twice) AS second_events, count(*) FILTER (2 * us >= twice AND is_error) AS second_errors
        FROM lev JOIN sp USING (host) GROUP BY host),
    r AS (SELECT *, first_errors / nullif(first_events, 0) AS r1, second_errors / nullif(second_events, 0) AS r2 FROM h)
    SELECT host, first_events, first_errors, second_events, second_errors,
        CASE WHEN first_events + second_events < 4 OR r1 IS NULL OR r2 IS NULL THEN 'N/D' WHEN r2 > r1 * 1.25::DOUBLE THEN 'ESCALATING'
        WHEN r2 < r1 * 0.75::DOUBLE THEN 'RECOVERING' ELSE 'STABLE' END AS trend,
        CAST(floor(r1 * 100 + 0.5::DOUBLE) AS INTEGER) AS first_error_pct, CAST(floor(r2 * 100 + 0.5::DOUBLE) AS INTEGER) AS second_error_pct FROM r""")
def _(spark, sf_dir):
    return ops.trend(enrich_levels(log_view(spark, sf_dir)), HOST)
