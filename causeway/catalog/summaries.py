"""Summary, alert, narrative and model context."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.catalog.impacts import EXACT_STATUS, LABEL_SQL, SETS, WITH_STEPS, counts
from causeway.catalog.incidents import HOST, root_ctes
from causeway.catalog.logview import EN, TEXT_COLUMNS, enriched, quote
from causeway.catalog.registry import SQL, query
from causeway.catalog.scalars import duration_sql, iso_sql, relative_sql
from causeway.catalog.sources import print_sql
from causeway.catalog.texts import evidence_sql, pseudonym_ctes
from causeway.catalog.timing import burst_sql, gap_sql
from causeway.operators import incident, model_facts, reports
from causeway.plans.scaling import materialize
from causeway.rules import CLIP_MARKER, IPV4_PATTERN, VOLATILE_TOKEN_PATTERN

_PRINT = print_sql("lv", ["event_id", "timestamp", "host", "session_id", "sourcetype", "source", "src_ip", "dst_ip", "log_level", "message"], HOST)


def written(spark, sf_dir):
    """The enriched log view, written once because the summaries read it many times."""
    return materialize(enriched(spark, sf_dir), "enriched")


@query("incident_summary", f"""WITH {root_ctes(HOST)}, {SETS}, c AS ({counts('host, sourcetype')}),
    ss AS (SELECT host, CASE max(CASE {EXACT_STATUS} WHEN 'DOWN' THEN 2 WHEN 'DEGRADED' THEN 1 ELSE 0 END) WHEN 2 THEN 'DOWN' WHEN 1 THEN 'DEGRADED' ELSE 'OK' END AS service_impact FROM c GROUP BY host),
    tr AS ({SQL['trend']}), bu AS (SELECT host, count(*) AS burst_count FROM ({burst_sql(3600, HOST)}) GROUP BY host),
    ga AS (SELECT host, count(*) AS gap_count FROM ({gap_sql(HOST)}) GROUP BY host), pr AS ({_PRINT}),
    du AS (SELECT host, count(*) - count(DISTINCT ("timestamp", session_id, sourcetype, source, src_ip, dst_ip, log_level, message)) AS duplicate_count FROM lv GROUP BY host)
    SELECT host, 'IR-' || incident_id AS incident_id, total_events, error_events, warning_events, anomaly_events, 1 AS host_count, precursor_count, severity_score,
        severity_grade, trend, service_impact, mttr_us / 1000000 AS mttr_seconds, cascade_count, {iso_sql('t0')} AS root_cause_ts, root_level AS root_cause_level,
        root_host AS root_cause_host, array_to_string(root_tags, '|') AS root_cause_tags,
        array_to_string(list_filter(error_only_tags, lambda x: list_contains({WITH_STEPS}, x)), '|') AS playbook_patterns,
        coalesce(burst_count, 0) AS burst_count, coalesce(gap_count, 0) AS gap_count, duplicate_count, CASE WHEN error_events > 0 THEN 1 ELSE 0 END AS hosts_with_errors
    FROM fin JOIN st USING (host) JOIN ss USING (host) JOIN tr USING (host) LEFT JOIN bu USING (host) LEFT JOIN ga USING (host) JOIN pr USING (host) JOIN du USING (host)""")
def _(spark, sf_dir):
    return reports.flat_summary(reports.incident_summary(written(spark, sf_dir), scope=HOST, burst_seconds=3600), HOST)


@query("alert_feed", f"""WITH {root_ctes(HOST)}, pr AS ({_PRINT}) SELECT host, 'IR-' || incident_id AS incident_id, severity_grade, severity_score, total_events, error_events,
    mttr_us / 1000000 AS mttr_seconds, cascade_count, {iso_sql('t0')} AS root_cause_ts, root_host AS root_cause_host,
    array_to_string(root_tags, '|') AS root_cause_tags FROM fin JOIN pr USING (host)""")
def _(spark, sf_dir):
    feed = reports.alert_feed(written(spark, sf_dir), scope=HOST)
    return feed.drop("analyzed_at", "source_file", "report_path", "tool_version")


SERVICE = ["sourcetype"]


@query("narrative_facts", f"""WITH {root_ctes(SERVICE)},
    wa AS (SELECT sourcetype, arg_min((us, host, substr(message, 1, 100)), (us, event_id)) AS w FROM en WHERE is_warning GROUP BY sourcetype),
    pc AS (SELECT e.sourcetype, arg_min((e.us, e.host), (e.us, e.event_id)) AS p FROM en e JOIN rt r USING (sourcetype)
        WHERE (e.is_anomaly OR e.is_warning) AND e.us >= t0 - 600000000 AND e.us < t0 GROUP BY e.sourcetype),
    bu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sourcetype ORDER BY events DESC, burst_start) AS k FROM ({burst_sql(3600, SERVICE)})) WHERE k = 1),
    h AS (SELECT sourcetype, host, count(*) FILTER (is_error) AS errors, min(us) FILTER (is_error) AS fe, min(us) FILTER (is_recovery) AS fr FROM en GROUP BY sourcetype, host),
    hw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sourcetype ORDER BY errors DESC, fe, host) AS k FROM h WHERE errors > 0) WHERE k = 1)
    SELECT sourcetype, {relative_sql('w[1]', 't0')} AS first_warning, w[2] AS warning_host, w[3] AS warning_message, {iso_sql('t0')} AS root_time, root_host, root_level,
        array_to_string(root_tags[1:3], '|') AS root_tags, cascade_count, precursor_count, coalesce({relative_sql('p[1]', 't0')}, 'N/A') AS first_precursor, p[2] AS precursor_host,
        burst_start AS peak_start, bu.events AS peak_events, {duration_sql('mttr_us')} AS mttr_text, hw.host AS worst_host, hw.errors AS worst_host_errors,
        coalesce({duration_sql('(fr - fe)')}, 'N/D') AS worst_host_downtime, confidence, confidence_reason,
        'First error at ' || {iso_sql('t0')} || ' on ' || root_host || ', followed by ' || cascade_count || ' errors; ' || coalesce('recovered after ' || {duration_sql('mttr_us')}, 'no recovery seen') AS sentence
    FROM fin LEFT JOIN wa USING (sourcetype) LEFT JOIN pc USING (sourcetype) LEFT JOIN bu USING (sourcetype) LEFT JOIN hw USING (sourcetype)""")
def _(spark, sf_dir):
    return reports.narrative_facts(written(spark, sf_dir), scope=SERVICE, burst_seconds=3600)


_ROW = "concat_ws(' | ', 'event_id=' || event_id, 'timestamp=' || \"timestamp\", " + ", ".join(f"CASE WHEN {c} <> '' THEN '{c}=' || {c} END" for c in TEXT_COLUMNS) + ")"
_CLIPPED = f"CASE WHEN length({_ROW}) > 500 THEN substr({_ROW}, 1, 500) || '{CLIP_MARKER}' ELSE {_ROW} END"


def _events_ctes(scope: str) -> str:
    part = f"PARTITION BY {scope} " if scope else ""
    return f"""{EN}, rk AS (SELECT *, row_number() OVER ({part}ORDER BY is_error DESC, us, event_id) AS event_no, max(is_error::INT) OVER ({part}) AS any_error FROM en),
    me AS (SELECT *, {_CLIPPED} AS raw_text FROM rk WHERE event_no <= 30 AND (is_error OR any_error = 0))"""


@query("model_events", f"""WITH {_events_ctes('host')} SELECT host, event_no, {iso_sql('us')} AS ts, lvl AS level, array_to_string(tags, '|') AS tags, raw_text AS raw FROM me""")
def _(spark, sf_dir):
    rows = reports.model_events(enriched(spark, sf_dir), scope=HOST, sanitize=False)
    return rows.withColumn("tags", F.array_join("tags", "|"))


@query("model_events_sanitized", f"""WITH {_events_ctes('')}, {pseudonym_ctes('me', 'event_no', 'raw_text')}
    SELECT event_no, {iso_sql('us')} AS ts, lvl AS level, array_to_string(tags, '|') AS tags, t AS raw FROM me JOIN t4 ON event_no = o""")
def _(spark, sf_dir):
    rows = reports.model_events(enriched(spark, sf_dir))
    return rows.withColumn("tags", F.array_join("tags", "|"))


_CONTEXT = """total_events long, severity_grade string, raw_error_extracts array<string>,
    timeline_excerpt array<struct<event_no: long, ts: string, level: string, raw: string>>"""


@query("model_context", f"""WITH {root_ctes(HOST)}{_events_ctes('host')[len(EN):]}, x AS (SELECT host, count(*) AS excerpt_events, least(count(*), 5) AS extracts,
    string_agg({iso_sql('us')} || ' ' || lvl, '|' ORDER BY event_no) AS excerpt FROM me GROUP BY host)
    SELECT host, total_events, severity_grade, CAST(excerpt_events AS INTEGER) AS excerpt_events, CAST(extracts AS INTEGER) AS extracts, excerpt, FALSE AS shows_address
    FROM fin JOIN x USING (host)""")
def _(spark, sf_dir):
    df = written(spark, sf_dir)
    row = materialize(incident.incident(df, scope=HOST), "incidents")
    context = model_facts.model_context(df, reports.incident_summary(df, scope=HOST, row=row), scope=HOST, row=row)
    parsed = context.select("host", F.from_json("context", _CONTEXT).alias("c"))
    lines = F.transform("c.timeline_excerpt", lambda e: F.concat(e["ts"], F.lit(" "), e["level"]))
    shown = F.array_join(F.concat("c.timeline_excerpt.raw", "c.raw_error_extracts"), " ").rlike(IPV4_PATTERN)
    return parsed.select("host", "c.total_events", "c.severity_grade", F.size("c.timeline_excerpt").alias("excerpt_events"),
                         F.size("c.raw_error_extracts").alias("extracts"), F.array_join(lines, "|").alias("excerpt"),
                         shown.alias("shows_address"))


def facts_ctes(scope: list[str]) -> str:
    """CTEs up to `mf`: the rows of `model_facts` with their texts as they are."""
    keys = "".join(f"{c}, " for c in scope)
    names = ", ".join(scope)
    part = f"PARTITION BY {names} " if scope else ""
    group = f"GROUP BY {names}" if scope else ""
    with_root = f"JOIN rt USING ({names})" if scope else "CROSS JOIN rt"
    evidence_part = f"PARTITION BY {keys}kind"
    return f"""{root_ctes(scope)}{_events_ctes(names)[len(EN):]},
    eo2 AS (SELECT {keys}list(DISTINCT tag) AS error_only FROM (SELECT {keys}unnest(tags) AS tag FROM en WHERE is_error AND NOT is_recovery) {group}),
    lb AS (SELECT {keys}root_tags, root_level, list_sort(list_filter(coalesce(error_only, []), lambda x: NOT list_contains(root_tags, x))) AS others
        FROM rt LEFT JOIN eo2 {f'USING ({names})' if scope else 'ON TRUE'}),
    ac AS (SELECT {keys}'root' AS kind, unnest(root_tags) AS tag, generate_subscripts(root_tags, 1) AS i FROM lb
        UNION ALL SELECT {keys}'correlated', unnest(others), 1000 + generate_subscripts(others, 1) FROM lb),
    cs AS (SELECT {keys}row_number() OVER ({part}ORDER BY i) AS n, kind, tag, {LABEL_SQL} AS label FROM ac
        UNION ALL SELECT {keys}1, 'default', NULL, 'Error event at level ' || root_level FROM lb WHERE len(root_tags) + len(others) = 0),
    pw AS (SELECT en.*, t0 FROM en {with_root}),
    pc AS (SELECT *, {_CLIPPED} AS raw_text, row_number() OVER ({part}ORDER BY us, event_id) AS n FROM pw
        WHERE (is_anomaly OR is_warning) AND us >= t0 - 600000000 AND us < t0),
    vk AS (SELECT *, row_number() OVER ({evidence_part} ORDER BY value) AS k FROM ({evidence_sql('lv', TEXT_COLUMNS, keys)})),
    vn AS (SELECT *, row_number() OVER ({part}ORDER BY kind, value) AS n FROM vk WHERE k <= 30),
    mp AS (SELECT {keys}trim(regexp_replace(message, {quote(VOLATILE_TOKEN_PATTERN)}, '<N>', 'gi')) AS message_pattern, count(*) AS occurrences
        FROM en WHERE is_error GROUP BY ALL),
    mn AS (SELECT *, row_number() OVER ({part}ORDER BY occurrences DESC, message_pattern) AS n FROM mp),
    bn2 AS (SELECT *, row_number() OVER ({part}ORDER BY events DESC, burst_start) AS n FROM ({burst_sql(3600, scope)})),
    mf AS (SELECT {keys}1000000 + n AS fact_no, 'cause' AS section, kind, NULL AS ts, tag AS tags, label AS txt FROM cs
        UNION ALL SELECT {keys}2000000 + event_no, 'timeline', lvl, {iso_sql('us')}, array_to_string(tags, '|'), raw_text FROM me
        UNION ALL SELECT {keys}3000000 + n, 'precursor', lvl, {iso_sql('us')}, array_to_string(tags, '|'), raw_text FROM pc WHERE n <= 10
        UNION ALL SELECT {keys}4000000 + n, 'evidence', kind, NULL, NULL, value FROM vn
        UNION ALL SELECT {keys}5000000 + n, 'recurring', CAST(occurrences AS VARCHAR), NULL, NULL, message_pattern FROM mn WHERE n <= 5
        UNION ALL SELECT {keys}6000000 + n, 'burst', CAST(events AS VARCHAR), {iso_sql('epoch_us(burst_start)')}, NULL, events || ' events, ' || errors || ' errors'
            FROM bn2 WHERE n <= 5)"""


@query("model_facts", f"WITH {facts_ctes(HOST)} SELECT * EXCLUDE (txt), txt AS text FROM mf")
def _(spark, sf_dir):
    return model_facts.model_facts(written(spark, sf_dir), scope=HOST, burst_seconds=3600, sanitize=False)


@query("model_facts_sanitized", f"""WITH {facts_ctes([])}, {pseudonym_ctes('mf', 'fact_no', 'txt')}
    SELECT fact_no, section, kind, ts, tags, t AS text FROM mf JOIN t4 ON fact_no = o""")
def _(spark, sf_dir):
    return model_facts.model_facts(written(spark, sf_dir), burst_seconds=3600)
