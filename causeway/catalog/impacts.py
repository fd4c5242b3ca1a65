"""Counts per host, service, flow and tag."""

from __future__ import annotations

from pyspark.sql import functions as F


from causeway.catalog.incidents import HOST, root_ctes
from causeway.catalog.logview import EN, LV, TAGS, enriched, log_view, quote
from causeway.catalog.registry import query
from causeway.catalog.scalars import duration_sql
from causeway.functions.times import as_time
from causeway.operators import correlate, impact, reports
from causeway.operators.enrich import enrich_levels
from causeway.rules import CAUSE_LABELS, RESPONSE_STEPS, VOLATILE_TOKEN_PATTERN

with_en = f"WITH {EN}\n"


def tenths(part: str) -> str:
    return f"CAST((2000 * {part} + total) // (2 * total) / 10 AS DOUBLE)"


def counts(keys: str) -> str:
    return (f"SELECT {keys}, count(*) AS total, count(*) FILTER (is_error) AS errors, count(*) FILTER (is_warning) AS warnings, "
            f"count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (is_recovery) AS recoveries FROM en GROUP BY {keys}")


EXACT_STATUS = ("CASE WHEN errors * 100 >= total * 50 THEN 'DOWN' WHEN errors * 100 >= total * 15 OR warnings * 100 >= total * 25 "
                "THEN 'DEGRADED' ELSE 'OK' END")


@query("host_impact", f"""{with_en}, c AS ({counts('host')}), p AS (SELECT *, {tenths('errors')} AS err_pct, {tenths('warnings')} AS warn_pct FROM c)
    SELECT *, CASE WHEN err_pct >= 50 THEN 'DOWN' WHEN err_pct >= 15 OR warn_pct >= 25 THEN 'DEGRADED' ELSE 'OK' END AS status FROM p""")
def _(spark, sf_dir):
    return impact.host_impact(enriched(spark, sf_dir))


@query("host_impact_per_service", f"""{with_en}, c AS ({counts('sourcetype, host')}),
    p AS (SELECT *, {tenths('errors')} AS err_pct, {tenths('warnings')} AS warn_pct FROM c)
    SELECT *, CASE WHEN err_pct >= 50 THEN 'DOWN' WHEN err_pct >= 15 OR warn_pct >= 25 THEN 'DEGRADED' ELSE 'OK' END AS status FROM p""")
def _(spark, sf_dir):
    return impact.host_impact(enriched(spark, sf_dir), scope=["sourcetype"])


@query("service_impact", f"{with_en}, c AS ({counts('sourcetype')}) SELECT sourcetype, total, errors, warnings, {tenths('errors')} AS err_pct, {EXACT_STATUS} AS status FROM c")
def _(spark, sf_dir):
    return impact.service_impact(enriched(spark, sf_dir))


@query("worst_service_status", f"""{with_en}, c AS ({counts('host, sourcetype')}), s AS (SELECT host, {EXACT_STATUS} AS status FROM c)
    SELECT host, CASE max(CASE status WHEN 'DOWN' THEN 2 WHEN 'DEGRADED' THEN 1 ELSE 0 END) WHEN 2 THEN 'DOWN' WHEN 1 THEN 'DEGRADED' ELSE 'OK' END
    AS service_status FROM s GROUP BY host""")
def _(spark, sf_dir):
    return impact.worst_service_status(enriched(spark, sf_dir), scope=HOST)


@query("source_breakdown", f"{with_en}, c AS ({counts('sourcetype')}) SELECT sourcetype, total, errors, warnings, {tenths('errors')} AS err_pct FROM c")
def _(spark, sf_dir):
    return impact.source_breakdown(enriched(spark, sf_dir))


@query("flow_summary", f"""{with_en}, c AS ({counts('session_id')}) SELECT * EXCLUDE (recoveries, rn), CAST(rn AS INTEGER) AS flow_rank FROM
    (SELECT *, row_number() OVER (ORDER BY errors DESC, session_id) AS rn FROM c) WHERE rn <= 15""")
def _(spark, sf_dir):
    return impact.flow_summary(enriched(spark, sf_dir), "session_id")


@query("flow_summary_per_host", f"""{with_en}, c AS ({counts('host, session_id')}) SELECT * EXCLUDE (recoveries, rn), CAST(rn AS INTEGER) AS flow_rank FROM
    (SELECT *, row_number() OVER (PARTITION BY host ORDER BY errors DESC, session_id) AS rn FROM c) WHERE rn <= 3""")
def _(spark, sf_dir):
    return impact.flow_summary(enriched(spark, sf_dir), "session_id", HOST, 3)


@query("flow_matrix", f"""{with_en}, c AS ({counts('src_ip, dst_ip')}) SELECT src_ip, dst_ip, total, errors, {tenths('errors')} AS err_pct,
    CAST(rn AS INTEGER) AS pair_rank FROM (SELECT *, row_number() OVER (ORDER BY errors DESC, src_ip, dst_ip) AS rn FROM c) WHERE rn <= 20""")
def _(spark, sf_dir):
    return impact.flow_matrix(enriched(spark, sf_dir))


LABEL_SQL = "CASE tag " + " ".join(f"WHEN '{t}' THEN {quote(label)}" for t, label in CAUSE_LABELS.items()) + " END"
PLACE = "list_position([" + ", ".join(f"'{t}'" for t in TAGS) + "], {})"


@query("anomaly_breakdown", f"{with_en}, t AS (SELECT unnest(tags) AS tag FROM en) SELECT tag, count(*) AS events, {LABEL_SQL} AS label FROM t GROUP BY tag")
def _(spark, sf_dir):
    return impact.anomaly_breakdown(enriched(spark, sf_dir))


@query("tag_cooccurrence", f"""{with_en}, t AS (SELECT event_id, unnest(tags) AS tag FROM en),
    p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS events FROM t a JOIN t b USING (event_id)
        WHERE {PLACE.format('a.tag')} < {PLACE.format('b.tag')} GROUP BY 1, 2)
    SELECT tag_a, tag_b, events, CAST(rn AS INTEGER) AS pair_rank FROM (SELECT *, row_number() OVER (ORDER BY events DESC,
        {PLACE.format('tag_a')}, {PLACE.format('tag_b')}) AS rn FROM p) WHERE rn <= 10""")
def _(spark, sf_dir):
    return impact.tag_cooccurrence(enriched(spark, sf_dir))


DUP_COLUMNS = ["host", "session_id", "sourcetype", "src_ip", "dst_ip", "log_level", "message"]


WHOLE_DUP_COLUMNS = [*DUP_COLUMNS, "source", "timestamp"]


@query("duplicate_count", f"WITH {LV} SELECT host, count(*) - count(DISTINCT ({', '.join(WHOLE_DUP_COLUMNS)})) AS duplicate_count FROM lv GROUP BY host")
@query("duplicate_count_whole", f"WITH {LV} SELECT host, count(*) - count(DISTINCT ({', '.join(WHOLE_DUP_COLUMNS)})) AS duplicate_count FROM lv GROUP BY host")
def _(spark, sf_dir):
    return impact.duplicate_count(log_view(spark, sf_dir), WHOLE_DUP_COLUMNS, HOST)


@query("recovery_timeline", f"""{with_en}, h AS (SELECT host, count(*) FILTER (is_error) AS errors, min(us) FILTER (is_error) AS fe, min(us) FILTER (is_recovery) AS fr
    FROM en GROUP BY host) SELECT host, errors, make_timestamp(fe) AS first_error, make_timestamp(fr) AS first_recovery, fr - fe AS downtime_us,
    coalesce({duration_sql('(fr - fe)')}, 'N/D') AS downtime FROM h WHERE errors > 0""")
def _(spark, sf_dir):
    return impact.recovery_timeline(enriched(spark, sf_dir)).select(
        "host", "errors", as_time(F.col("first_error_us")).alias("first_error"),
        as_time(F.col("first_recovery_us")).alias("first_recovery"), "downtime_us", "downtime")


@query("recovery_timeline_after_error", f"""{with_en}, h AS (SELECT host, count(*) FILTER (is_error) AS errors, min(us) FILTER (is_error) AS fe FROM en GROUP BY host),
    r AS (SELECT h.host, min(us) AS fr FROM en JOIN h USING (host) WHERE is_recovery AND us > fe GROUP BY h.host)
    SELECT host, errors, fe AS first_error_us, fr AS first_recovery_us, fr - fe AS downtime_us, coalesce({duration_sql('(fr - fe)')}, 'N/D') AS downtime
    FROM h LEFT JOIN r USING (host) WHERE errors > 0""")
def _(spark, sf_dir):
    return impact.recovery_timeline(enriched(spark, sf_dir), after_error=True)


@query("top_error_messages", f"""{with_en}, m AS (SELECT trim(regexp_replace(message, {quote(VOLATILE_TOKEN_PATTERN)}, '<N>', 'gi')) AS message_pattern,
    count(*) AS occurrences FROM en WHERE is_error GROUP BY 1) SELECT message_pattern, occurrences, CAST(rn AS INTEGER) AS message_rank,
    (SELECT max(occurrences) = 1 FROM m) AS all_unique
    FROM (SELECT *, row_number() OVER (ORDER BY occurrences DESC, message_pattern) AS rn FROM m) WHERE rn <= 5""")
def _(spark, sf_dir):
    return impact.top_error_messages(enrich_levels(log_view(spark, sf_dir)))


@query("top_error_messages_per_host", f"""{with_en}, m AS (SELECT host, trim(regexp_replace(message, {quote(VOLATILE_TOKEN_PATTERN)}, '<N>', 'gi')) AS message_pattern,
    count(*) AS occurrences FROM en WHERE is_error GROUP BY 1, 2), u AS (SELECT host, max(occurrences) = 1 AS all_unique FROM m GROUP BY host)
    SELECT host, message_pattern, occurrences, CAST(rn AS INTEGER) AS message_rank, all_unique
    FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY occurrences DESC, message_pattern) AS rn FROM m) JOIN u USING (host) WHERE rn <= 5""")
def _(spark, sf_dir):
    return impact.top_error_messages(enrich_levels(log_view(spark, sf_dir)), scope=HOST)


@query("top_error_tags", f"""{with_en}, t AS (SELECT unnest(tags) AS tag FROM en WHERE is_error), c AS (SELECT tag, count(*) AS events FROM t GROUP BY tag)
    SELECT tag, events, CAST(rn AS INTEGER) AS tag_rank FROM (SELECT *, row_number() OVER (ORDER BY events DESC, {PLACE.format('tag')}) AS rn FROM c) WHERE rn <= 5""")
def _(spark, sf_dir):
    return impact.top_error_tags(enriched(spark, sf_dir))


SETS = f"""eo AS (SELECT host, list_sort(list(DISTINCT tag)) AS error_only FROM (SELECT host, unnest(tags) AS tag FROM en
    WHERE is_error AND NOT is_recovery) GROUP BY host),
    al AS (SELECT host, list_sort(list(DISTINCT tag)) AS alert FROM (SELECT host, unnest(tags) AS tag FROM en) WHERE tag <> 'service_restart' GROUP BY host),
    hs AS (SELECT DISTINCT host FROM en),
    st AS (SELECT host, coalesce(error_only, []) AS error_only_tags, coalesce(alert, []) AS alert_tags FROM hs LEFT JOIN eo USING (host) LEFT JOIN al USING (host))"""
WITH_STEPS = "[" + ", ".join(f"'{t}'" for t in RESPONSE_STEPS) + "]"


@query("tag_sets", f"""{with_en}, {SETS} SELECT host, array_to_string(error_only_tags, '|') AS error_only_tags, array_to_string(alert_tags, '|') AS alert_tags,
    array_to_string(list_filter(error_only_tags, lambda x: list_contains({WITH_STEPS}, x)), '|') AS playbook_patterns FROM st""")
def _(spark, sf_dir):
    sets = impact.tag_sets(enriched(spark, sf_dir), HOST)
    return sets.select("host", *[F.array_join(c, "|").alias(c) for c in ("error_only_tags", "alert_tags", "playbook_patterns")])


@query("overview", f"""{with_en}, o AS (SELECT host, count(*) AS total_events, count(*) FILTER (is_error) AS error_events, count(*) FILTER (is_warning) AS warning_events,
    count(*) FILTER (is_anomaly) AS anomaly_events, min(us) AS first_us, max(us) AS last_us, count(DISTINCT session_id) AS unique_flows,
    count(DISTINCT host) AS host_count FROM en GROUP BY host)
    SELECT *, CAST((2000 * anomaly_events + total_events) // (2 * total_events) / 10 AS DOUBLE) AS anomaly_pct, last_us - first_us AS duration_us,
    {duration_sql('(last_us - first_us)')} AS duration, CASE WHEN error_events > 0 THEN 'ERROR' WHEN warning_events > 0 THEN 'WARNING' ELSE 'INFO' END AS event_class FROM o""")
def _(spark, sf_dir):
    return impact.overview(enriched(spark, sf_dir), scope=HOST, flow_key="session_id")


@query("overview_global", f"""{with_en}, o AS (SELECT count(*) AS total_events, count(*) FILTER (is_error) AS error_events, count(*) FILTER (is_warning) AS warning_events,
    count(*) FILTER (is_anomaly) AS anomaly_events, min(us) AS first_us, max(us) AS last_us, count(DISTINCT session_id) AS unique_flows,
    count(DISTINCT host) AS host_count FROM en)
    SELECT *, CAST((2000 * anomaly_events + total_events) // (2 * total_events) / 10 AS DOUBLE) AS anomaly_pct, last_us - first_us AS duration_us,
    {duration_sql('(last_us - first_us)')} AS duration, CASE WHEN error_events > 0 THEN 'ERROR' WHEN warning_events > 0 THEN 'WARNING' ELSE 'INFO' END AS event_class FROM o""")
def _(spark, sf_dir):
    return impact.overview(enriched(spark, sf_dir), flow_key="session_id")


PROFILE_COLUMNS = ["session_id", "src_ip", "host", "sourcetype", "dst_ip", "log_level", "message"]


@query("flow_key_profile", f"WITH {LV} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total, count(DISTINCT {c}) AS distinct_values FROM lv" for c in PROFILE_COLUMNS))
def _(spark, sf_dir):
    return impact.flow_key_profile(log_view(spark, sf_dir), PROFILE_COLUMNS)


STEP_ROWS = ", ".join(f"('{t}', {i}, {quote(s)})" for t, steps in RESPONSE_STEPS.items() for i, s in enumerate(steps, 1))


@query("response_playbook", f"""{with_en}, {SETS}, steps(tag, step_no, step) AS (VALUES {STEP_ROWS}),
    d AS (SELECT host, unnest(error_only_tags) AS tag, generate_subscripts(error_only_tags, 1) AS tag_no FROM st)
    SELECT host, CAST(tag_no AS INTEGER) AS tag_no, tag, step_no, step FROM d JOIN steps USING (tag)""")
def _(spark, sf_dir):
    return correlate.response_playbook(impact.tag_sets(enriched(spark, sf_dir), HOST), scope=HOST)


@query("cause_list", f"""WITH {root_ctes(HOST)}, {SETS},
    lb AS (SELECT host, root_tags, list_sort(list_filter(error_only_tags, lambda x: NOT list_contains(root_tags, x))) AS others, root_level
        FROM rt JOIN st USING (host)),
    ac AS (SELECT host, 'root' AS kind, unnest(root_tags) AS tag, generate_subscripts(root_tags, 1) AS i FROM lb
        UNION ALL SELECT host, 'correlated', unnest(others), 1000 + generate_subscripts(others, 1) FROM lb),
    nm AS (SELECT host, row_number() OVER (PARTITION BY host ORDER BY i) AS cause_no, kind, tag, {LABEL_SQL} AS label FROM ac)
    SELECT host, CAST(cause_no AS INTEGER) AS cause_no, kind, tag, label FROM nm
    UNION ALL SELECT host, 1, 'default', NULL, 'Error event at level ' || root_level FROM lb WHERE len(root_tags) + len(others) = 0""")
def _(spark, sf_dir):
    return correlate.cause_list(reports.root_report(enriched(spark, sf_dir), scope=HOST), HOST)


ISOLATE = """k AS (SELECT session_id, count(*) FILTER (is_error) AS e, count(*) FILTER (is_anomaly) AS a FROM en GROUP BY session_id),
    win AS (SELECT CASE WHEN max(e) > 0 THEN (SELECT session_id FROM k ORDER BY e DESC, session_id LIMIT 1)
        WHEN max(a) > 0 THEN (SELECT session_id FROM k ORDER BY a DESC, session_id LIMIT 1) END AS key FROM k)"""


@query("isolate_flow", f"{with_en}, {ISOLATE} SELECT event_id, session_id, message FROM en, win WHERE key IS NULL OR session_id = key")
def _(spark, sf_dir):
    return correlate.isolate_flow(enriched(spark, sf_dir), "session_id").select("event_id", "session_id", "message")


@query("isolate_flow_per_host", f"""{with_en}, k AS (SELECT host, session_id, count(*) FILTER (is_error) AS e, count(*) FILTER (is_anomaly) AS a FROM en GROUP BY host, session_id),
    b AS (SELECT host, max(e) AS me, max(a) AS ma, first(session_id ORDER BY e DESC, session_id) AS ke, first(session_id ORDER BY a DESC, session_id) AS ka FROM k GROUP BY host),
    win AS (SELECT host, CASE WHEN me > 0 THEN ke WHEN ma > 0 THEN ka END AS key FROM b)
    SELECT host, event_id, session_id FROM en JOIN win USING (host) WHERE key IS NULL OR session_id = key""")
def _(spark, sf_dir):
    return correlate.isolate_flow(enriched(spark, sf_dir), "session_id", scope=HOST).select("host", "event_id", "session_id")


@query("flow_detail", f"""{with_en}, {ISOLATE}, f AS (SELECT event_id, session_id, message, row_number() OVER (ORDER BY us, event_id) AS rn FROM en, win
    WHERE key IS NULL OR session_id = key) SELECT event_id, session_id, message, CAST(rn AS INTEGER) AS event_rank FROM f WHERE rn <= 25""")
def _(spark, sf_dir):
    return correlate.flow_detail(enriched(spark, sf_dir), "session_id").select("event_id", "session_id", "message", "event_rank")


