"""Bursts, gaps, density, event chain, cross-host cascades and drill-downs."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway import schema as S
from causeway.catalog.incidents import HOST, root_ctes
from causeway.catalog.logview import EN, LV, RANK_SQL, enriched, log_view, quote, unzoned
from causeway.catalog.registry import query
from causeway.catalog.scalars import iso_sql
from causeway.operators import correlate, enrich, incident, reports, series
from causeway.operators.enrich import enrich_levels
from causeway.rules import DRILLDOWN_DEFAULT, DRILLDOWN_PATTERNS, DRILLDOWN_SEVERITY

LEV = f"{LV}, lev AS (SELECT *, upper(trim(log_level)) IN ('CRITICAL', 'ERR', 'ERROR') AS is_error FROM lv)"


def leveled(spark, sf_dir):
    return enrich_levels(log_view(spark, sf_dir))


def burst_sql(seconds: int, scope: list[str]) -> str:
    """Over bins that are really laid out, the empty ones too."""
    w = seconds * 1_000_000
    keys = "".join(f"{c}, " for c in scope)
    using = f"USING ({', '.join([*scope, 'b'])})"
    on = f"USING ({', '.join(scope)})" if scope else "ON TRUE"
    group = f"GROUP BY {', '.join(scope)}" if scope else ""
    return f"""WITH {LEV}, bn AS (SELECT {keys}us // {w} AS b, count(*) AS c, count(*) FILTER (is_error) AS errors FROM lev GROUP BY {keys}b),
    sp AS (SELECT {keys}min(b) AS lo, max(b) AS hi FROM bn {group}),
    g AS (SELECT {keys}unnest(generate_series(lo, hi)) AS b FROM sp),
    de AS (SELECT {keys}b, coalesce(c, 0)::HUGEINT AS c, coalesce(errors, 0) AS errors FROM g LEFT JOIN bn {using}),
    f AS (SELECT {keys}count(*)::HUGEINT AS bins, sum(c)::HUGEINT AS n, sum(c * c)::HUGEINT AS sq FROM de {group})
    SELECT {keys}make_timestamp((b * {w})::BIGINT) AS burst_start, make_timestamp(((b + 1) * {w})::BIGINT) AS burst_end, c::BIGINT AS events, errors,
        floor((bins * c - n)::DOUBLE / sqrt(bins::DOUBLE * ((bins * sq - n * n)::DOUBLE / (bins - 1)::DOUBLE)) * 10 + 0.5::DOUBLE) / 10 AS z_score,
        floor(c::DOUBLE * bins::DOUBLE / n::DOUBLE * 10 + 0.5::DOUBLE) / 10 AS rate_factor
    FROM de JOIN f {on} WHERE n >= 5 AND bins * c > n AND (bins * c - n) * (bins * c - n) * (bins - 1) > 4 * bins * (bins * sq - n * n)"""


@query("burst_windows", burst_sql(3600, []))
def _(spark, sf_dir):
    return reports.bursts_ordered(series.burst_windows(leveled(spark, sf_dir), resample_seconds=3600))


@query("burst_windows_30s", burst_sql(30, []))
def _(spark, sf_dir):
    return series.burst_windows(leveled(spark, sf_dir))


@query("burst_windows_per_host", burst_sql(3600, HOST))
def _(spark, sf_dir):
    return series.burst_windows(leveled(spark, sf_dir), HOST, 3600)


def gap_sql(scope: list[str]) -> str:
    keys = "".join(f"{c}, " for c in scope)
    part = f"PARTITION BY {', '.join(scope)} " if scope else ""
    on = f"USING ({', '.join(scope)})" if scope else "ON TRUE"
    group = f"GROUP BY {', '.join(scope)}" if scope else ""
    return f"""WITH {LV}, d AS (SELECT {keys}lag(us) OVER ({part}ORDER BY us) AS from_us, us AS to_us FROM lv),
    g AS (SELECT *, to_us - from_us AS gap_us FROM d WHERE from_us IS NOT NULL),
    q AS (SELECT {keys}quantile_cont(gap_us::DOUBLE, 0.75) AS p75, avg(gap_us) AS mean, count(*) AS n FROM g {group}),
    x AS (SELECT g.*, CASE WHEN p75 > 0 THEN p75 ELSE mean END AS base FROM g JOIN q {on} WHERE n >= 2),
    r AS (SELECT *, row_number() OVER ({part}ORDER BY gap_us DESC, from_us) AS rn FROM x WHERE base > 0 AND gap_us >= greatest(base * 5, 60000000))
    SELECT {keys}CAST(rn AS INTEGER) AS gap_rank, make_timestamp(from_us) AS gap_from, make_timestamp(to_us) AS gap_to, gap_us,
        floor(gap_us / 60000000 * 10 + 0.5::DOUBLE) / 10 AS gap_minutes, floor(gap_us / base * 10 + 0.5::DOUBLE) / 10 AS gap_factor FROM r WHERE rn <= 10"""


@query("log_gaps", gap_sql([]))
def _(spark, sf_dir):
    return series.log_gaps(enrich.normalize_time(log_view(spark, sf_dir)))


@query("log_gaps_per_host", gap_sql(HOST))
def _(spark, sf_dir):
    return series.log_gaps(enrich.normalize_time(log_view(spark, sf_dir)), HOST)


def density_sql(scope: list[str]) -> str:
    keys = "".join(f"{c}, " for c in scope)
    using = f"USING ({', '.join([*scope, 'b'])})"
    group = f"GROUP BY {', '.join(scope)}" if scope else ""
    return f"""WITH {LEV}, bn AS (SELECT {keys}us // 60000000 AS b, count(*) AS events, count(*) FILTER (is_error) AS errors FROM lev GROUP BY {keys}b),
    sp AS (SELECT {keys}min(b) AS lo, max(b) AS hi, max(events) AS peak FROM bn {group}),
    g AS (SELECT {keys}unnest(generate_series(lo, hi)) AS b, peak FROM sp),
    d AS (SELECT {keys}b, peak, coalesce(events, 0) AS events, coalesce(errors, 0) AS errors FROM g LEFT JOIN bn {using})
    SELECT {keys}make_timestamp(b * 60000000) AS bin_start, events, errors,
        CAST(CASE WHEN events > 0 THEN greatest(floor(events / peak * 24), 1) ELSE 0 END AS INTEGER) AS bar FROM d"""


@query("error_density", density_sql([]))
def _(spark, sf_dir):
    return series.error_density(leveled(spark, sf_dir))


@query("error_density_per_service", density_sql(["sourcetype"]))
def _(spark, sf_dir):
    return series.error_density(leveled(spark, sf_dir), ["sourcetype"])


CHAIN_SQL = f"""WITH {root_ctes(HOST)}, a AS (SELECT e.*, r.t0 FROM en e JOIN rt r USING (host) WHERE e.is_anomaly),
    bf AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us DESC, event_id DESC) AS k FROM a WHERE us < t0),
    ft AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us, event_id) AS k FROM a WHERE us >= t0),
    nb AS (SELECT host, count(*) FILTER (us < t0 AND k <= 6) AS n FROM (SELECT * FROM bf UNION ALL SELECT * FROM ft) GROUP BY host),
    ch AS (SELECT * FROM bf WHERE k <= 6 UNION ALL SELECT ft.* FROM ft JOIN nb USING (host) WHERE k <= 12 - n),
    ps AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us, event_id) AS pos, us - lag(us) OVER (PARTITION BY host ORDER BY us, event_id) AS gap FROM ch)
    SELECT host, CAST(pos AS INTEGER) AS position, event_id, CASE WHEN us = t0 THEN 'root' WHEN is_error THEN 'error' ELSE 'other' END AS marker,
        CASE WHEN gap >= 30000000 THEN gap END AS gap_before_us, array_to_string(tags, '|') AS tags FROM ps"""


@query("event_chain", CHAIN_SQL)
def _(spark, sf_dir):
    df = enriched(spark, sf_dir)
    chain = series.event_chain(df, incident.root_cause(df, scope=HOST), scope=HOST)
    return chain.select("host", "position", "event_id", "marker", "gap_before_us", F.array_join(S.TAGS, "|").alias("tags"))


def cross_sql(seconds: int, limit: int, scope: list[str], by_day: bool = False) -> str:
    """Brute force over all pairs of errors; with `by_day` seeds are ranked by their day, pairs know no days."""
    w = seconds * 1_000_000
    keys = "".join(f"{c}, " for c in scope)
    ranked = [*scope, "strftime(make_timestamp(sus), '%Y-%m-%d')"] if by_day else scope
    part = f"PARTITION BY {', '.join(ranked)} " if ranked else ""
    day = "strftime(make_timestamp(sus), '%Y-%m-%d') AS day, " if by_day else ""
    same = "".join(f" AND a.{c} = b.{c}" for c in scope)
    return f"""WITH {EN}, er AS (SELECT * FROM en WHERE is_error),
    pr AS (SELECT {''.join(f'a.{c}, ' for c in scope)}a.event_id AS sid, a.us AS sus, a.host AS sh, a.lvl AS sl, a.message AS sm, b.us, b.event_id AS id, b.host AS h, b.lvl AS l
        FROM er a JOIN er b ON b.us <= a.us + {w} AND (b.us > a.us OR (b.us = a.us AND b.event_id > a.event_id)) AND a.host <> b.host{same}),
    sd AS (SELECT DISTINCT {keys}sid, sus, sh, sl, sm FROM pr),
    s1 AS (SELECT *, row_number() OVER (PARTITION BY {keys}sus // 1000 ORDER BY sus, sid) AS k FROM sd),
    s2 AS (SELECT *, row_number() OVER ({part}ORDER BY sus // 1000) AS rn FROM s1 WHERE k = 1),
    hh AS (SELECT sid, h, min((us, id)) AS first_pos FROM pr GROUP BY sid, h),
    ho AS (SELECT sid, list(h ORDER BY first_pos) AS hs FROM hh GROUP BY sid),
    ll AS (SELECT pr.sid, l, min((us, id)) AS first_pos FROM pr WHERE l <> sl GROUP BY pr.sid, l),
    lo AS (SELECT sid, list(l ORDER BY first_pos) AS ls FROM ll GROUP BY sid)
    SELECT {keys}{day}CAST(rn AS INTEGER) AS group_rank, sid AS seed_event_id, {iso_sql('sus')} AS "start", sh || '|' || array_to_string(hs, '|') AS hosts,
        sl || coalesce('|' || array_to_string(ls, '|'), '') AS levels, substr(sm, 1, 80) AS "trigger" FROM s2 JOIN ho USING (sid) LEFT JOIN lo USING (sid) WHERE rn <= {limit}"""


def cross(df, **params):
    out = correlate.cross_host_cascade(df, **params)
    day = ["day"] if params.get("by_day") else []
    return out.select(*params.get("scope", []), *day, "group_rank", "seed_event_id", "start", F.array_join("hosts", "|").alias("hosts"),
                      F.array_join("levels", "|").alias("levels"), "trigger")


@query("cross_host_cascade", cross_sql(30, 10, []))
def _(spark, sf_dir):
    return cross(leveled(spark, sf_dir), window_seconds=30)


@query("cross_host_cascade_2s", cross_sql(2, 10, []))
def _(spark, sf_dir):
    return cross(leveled(spark, sf_dir))


@query("cross_host_cascade_per_service", cross_sql(300, 10, ["sourcetype"]))
def _(spark, sf_dir):
    return cross(leveled(spark, sf_dir), window_seconds=300, scope=["sourcetype"])


@query("cross_host_cascade_by_day", cross_sql(300, 10, [], by_day=True))
def _(spark, sf_dir):
    return cross(leveled(spark, sf_dir), window_seconds=300, by_day=True)


SOURCES = """so AS (SELECT host, source, min((us, event_id)) AS first_pos FROM en GROUP BY host, source),
    s3 AS (SELECT host, list(source) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY first_pos) AS k FROM so) WHERE k <= 3 GROUP BY host)"""
SEVERITY_SQL = "CASE e.lvl " + " ".join(f"WHEN '{n}' THEN {r}" for n, r in DRILLDOWN_SEVERITY.items()) + " ELSE 1 END"
WIDE_US = 86_400_000_000


@query("incident_window", f"""WITH {root_ctes(HOST)}, {SOURCES} SELECT e.host, e.event_id, e.message, {SEVERITY_SQL} AS severity
    FROM en e JOIN rt r USING (host) JOIN s3 USING (host) WHERE e.us BETWEEN t0 - {WIDE_US} AND t0 + {WIDE_US} AND list_contains(sources, e.source)
    AND e.session_id = r.root_flow AND {SEVERITY_SQL} >= 3""")
def _(spark, sf_dir):
    df = enriched(spark, sf_dir)
    root = incident.root_cause(df, scope=HOST, flow_key="session_id")
    rows = correlate.incident_window(df, root, scope=HOST, flow_key="session_id", minutes=1440)
    return rows.select("host", "event_id", "message", "severity")


@query("root_host_drilldown", f"""WITH {root_ctes(['sourcetype'])} SELECT e.sourcetype, e.host, e.event_id, {SEVERITY_SQL} AS severity FROM en e JOIN rt r USING (sourcetype)
    WHERE e.us BETWEEN t0 - {WIDE_US} AND t0 + {WIDE_US} AND e.host = r.root_host""")
def _(spark, sf_dir):
    df = enriched(spark, sf_dir)
    scope = ["sourcetype"]
    rows = correlate.root_host_drilldown(df, incident.root_cause(df, scope=scope), scope=scope, minutes=1440)
    return rows.select("sourcetype", "host", "event_id", "severity")


@query("pattern_drilldown", f"""WITH {root_ctes(HOST)}, {SOURCES} SELECT e.host, e.event_id, e.message FROM en e JOIN rt r USING (host) JOIN s3 USING (host)
    WHERE e.us BETWEEN t0 - {WIDE_US} AND t0 + {WIDE_US} AND list_contains(sources, e.source) AND CASE coalesce(root_tags[1], '')
    {' '.join(f"WHEN '{t}' THEN regexp_matches(e.message, {quote(p)}, 'i')" for t, p in DRILLDOWN_PATTERNS.items())}
    ELSE regexp_matches(e.message, {quote(DRILLDOWN_DEFAULT)}, 'i') END""")
def _(spark, sf_dir):
    df = enriched(spark, sf_dir)
    rows = correlate.pattern_drilldown(df, incident.root_cause(df, scope=HOST), scope=HOST, minutes=1440)
    return rows.select("host", "event_id", "message")


@query("chronological", f"WITH {LV} SELECT event_id, host, message FROM lv")
def _(spark, sf_dir):
    return enrich.chronological(enrich.normalize_time(log_view(spark, sf_dir))).select("event_id", "host", "message")


CELLS = ["session_id", "sourcetype", "source", "src_ip", "dst_ip", "log_level", "message"]


def _cells(names) -> str:
    return ", ".join(f"translate(substr({c}, 1, 100), '|' || chr(10), '¦ ') AS {c}" for c in names)


@query("timeline", f"""WITH {EN}, t AS (SELECT *, row_number() OVER (ORDER BY us, event_id) AS rn FROM en WHERE is_anomaly)
    SELECT CAST(rn AS INTEGER) AS row_no, {iso_sql('us')} AS time_text, event_id, "timestamp", {_cells(['host', *CELLS])} FROM t WHERE rn <= 30""")
def _(spark, sf_dir):
    return unzoned(reports.timeline(enriched(spark, sf_dir)))


@query("timeline_min_level_per_host", f"""WITH {EN}, t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us, event_id) AS rn FROM en WHERE rnk >= 5)
    SELECT host, CAST(rn AS INTEGER) AS row_no, {iso_sql('us')} AS time_text, event_id, "timestamp", {_cells(CELLS)} FROM t WHERE rn <= 10""")
def _(spark, sf_dir):
    return unzoned(reports.timeline(leveled(spark, sf_dir), scope=HOST, max_rows=10, min_level="ERROR"))


@query("top_raw_errors", f"""WITH {EN}, t AS (SELECT *, {RANK_SQL} AS r, row_number() OVER (PARTITION BY host ORDER BY rnk DESC, us, event_id) AS rn FROM en WHERE is_error)
    SELECT host, CAST(rn AS INTEGER) AS row_no, event_id, {iso_sql('us')} AS time_text, lvl AS level, CAST(r AS INTEGER) AS severity_rank,
    concat_ws(chr(10), 'event_id: ' || event_id, 'timestamp: ' || "timestamp", {', '.join(f"'{c}: ' || substr({c}, 1, 200)" for c in ['host', *CELLS])}) AS extract FROM t WHERE rn <= 5""")
def _(spark, sf_dir):
    return reports.top_raw_errors(leveled(spark, sf_dir), scope=HOST)

