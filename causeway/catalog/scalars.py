"""Projections, filters and scalar functions over the log view."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway import schema as S
from causeway.catalog.logview import (EN, LEVEL_WORD, LV, TAG_PATTERNS, TAGS, VIEW_COLUMNS, canonical_sql, enriched,
                                      log_view, quote, sliced, table, unzoned)
from causeway.catalog.registry import query
from causeway.functions import levels
from causeway.functions.hosts import INTERNAL_V4_PATTERN, INTERNAL_V6_PATTERN, V4_PATTERN
from causeway.functions.text import clip_marked, normalize_message, row_to_text, table_cell
from causeway.functions.times import format_duration, format_relative, format_ts
from causeway.operators import enrich as ops
from causeway.operators import evidence
from causeway.rules import CLIP_MARKER, DEFAULT_RULES, VOLATILE_TOKEN_PATTERN

from causeway.sources.timestamps import parse_timestamps

with_en = f"WITH {EN}\n"
with_lv = f"WITH {LV}\n"

# Renderings of one instant: (name, Spark pattern, strftime pattern, precision that survives).
_RENDERED = [
    ("iso_fraction_zone", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "microsecond"),
    ("iso_zone", "yyyy-MM-dd'T'HH:mm:ssXXX", "second"),
    ("iso_fraction", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "microsecond"),
    ("iso", "yyyy-MM-dd'T'HH:mm:ss", "second"),
    ("sql_fraction", "yyyy-MM-dd HH:mm:ss.SSSSSS", "microsecond"),
    ("sql_comma_fraction", "yyyy-MM-dd HH:mm:ss,SSSSSS", "microsecond"),
    ("sql", "yyyy-MM-dd HH:mm:ss", "second"),
    ("access_log", "dd/MMM/yyyy:HH:mm:ss Z", "second"),
    ("syslog", "MMM dd HH:mm:ss", "second"),
    ("us", "MM/dd/yyyy HH:mm:ss", "second"),
    ("day_first", "dd-MM-yyyy HH:mm:ss", "second"),
]


def timestamp_strings(spark, sf_dir):
    """Event times as text in each known format and as epoch seconds and milliseconds."""
    events = sliced(table(spark, sf_dir, "events").select("event_id", "ts"))
    at = F.col("ts").cast("timestamp")
    return events.select(
        "event_id", *[F.date_format(at, p).alias(n) for n, p, _ in _RENDERED],
        F.unix_seconds(at).cast("string").alias("epoch_seconds"), F.unix_millis(at).cast("string").alias("epoch_millis"))


@query("parse_timestamps", "SELECT event_id, " + ", ".join(
    f"date_trunc('{p}', ts) AS {n}" for n, _, p in _RENDERED)
    + ", date_trunc('second', ts) AS epoch_seconds, date_trunc('millisecond', ts) AS epoch_millis FROM events")
def _(spark, sf_dir):
    df = timestamp_strings(spark, sf_dir)
    return unzoned(parse_timestamps(df, df.columns[1:], year=2024))


@query("extract_level", f"{with_en}SELECT event_id, lvl AS level FROM en")
def _(spark, sf_dir):
    return ops.enrich_levels(log_view(spark, sf_dir)).select("event_id", F.col(S.LEVEL).alias("level"))


@query("extract_level_from_text", f"""{with_lv}, w AS (SELECT event_id, upper(regexp_extract(
    concat_ws(' ', host, session_id, sourcetype, source, src_ip, dst_ip, message), {LEVEL_WORD}, 1, 'i')) AS word FROM lv)
    SELECT event_id, CASE WHEN word = '' THEN 'UNKNOWN' ELSE {canonical_sql('word')} END AS level FROM w""")
def _(spark, sf_dir):
    df = log_view(spark, sf_dir).drop("log_level")
    return ops.enrich_levels(df).select("event_id", F.col(S.LEVEL).alias("level"))


@query("severity_rank", f"{with_en}SELECT event_id, CAST(rnk AS INTEGER) AS severity_rank FROM en")
def _(spark, sf_dir):
    df = ops.enrich_levels(log_view(spark, sf_dir))
    return df.select("event_id", levels.severity_rank(F.col(S.LEVEL)).alias("severity_rank"))


@query("combine_text", f"{with_en}SELECT event_id, rc AS combined FROM en")
def _(spark, sf_dir):
    return enriched(spark, sf_dir).select("event_id", F.col(S.COMBINED).alias("combined"))


@query("flag_levels", f"{with_en}SELECT event_id, is_error, is_warning FROM en")
def _(spark, sf_dir):
    df = ops.enrich_levels(log_view(spark, sf_dir))
    return df.select("event_id", F.col(S.IS_ERROR).alias("is_error"), F.col(S.IS_WARNING).alias("is_warning"))


@query("flag_recovery", f"{with_en}SELECT event_id, is_recovery FROM en")
def _(spark, sf_dir):
    return enriched(spark, sf_dir).select("event_id", F.col(S.IS_RECOVERY).alias("is_recovery"))


@query("flag_patterns", f"{with_en}SELECT event_id, " + ", ".join(f"f_{t} AS {t}" for t in TAGS) + " FROM en")
def _(spark, sf_dir):
    return enriched(spark, sf_dir).select("event_id", *[F.col(S.FLAG_PREFIX + t).alias(t) for t in TAGS])


@query("assemble_tags", f"{with_en}SELECT event_id, array_to_string(tags, '|') AS tags FROM en")
def _(spark, sf_dir):
    return enriched(spark, sf_dir).select("event_id", F.array_join(S.TAGS, "|").alias("tags"))


@query("flag_anomaly", f"{with_en}SELECT event_id, is_anomaly FROM en")
def _(spark, sf_dir):
    return enriched(spark, sf_dir).select("event_id", F.col(S.IS_ANOMALY).alias("is_anomaly"))


CUSTOM_RULES = """{"patterns": {"purchase_flow": "\\\\bpurchase\\\\s+\\\\d+", "slow_query": "query\\\\s+time"},
    "labels": {"purchase_flow": "Purchase seen"}, "remediation": {"purchase_flow": ["Check the shop"]}}"""
_CUSTOM = {**TAG_PATTERNS, "slow_query": r"query\s+time", "purchase_flow": r"\bpurchase\s+\d+"}
_CUSTOM_ORDER = [t for t in TAGS if t in TAGS[:10]] + ["purchase_flow"] + TAGS[10:]


@query("custom_rules", f"{with_en}, cu AS (SELECT event_id, list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(rc, {quote(_CUSTOM[t])}, 'i') THEN '{t}' END" for t in _CUSTOM_ORDER)
    + "], lambda x: x IS NOT NULL) AS tags FROM en) SELECT event_id, array_to_string(tags, '|') AS tags, "
      "CASE WHEN list_contains(tags, 'purchase_flow') THEN 'Purchase seen' END AS label FROM cu")
def _(spark, sf_dir):
    rules = DEFAULT_RULES.from_json(CUSTOM_RULES)
    df = ops.enrich(log_view(spark, sf_dir), rules=rules)
    label = F.when(F.array_contains(S.TAGS, "purchase_flow"), rules.labels["purchase_flow"])
    return df.select("event_id", F.array_join(S.TAGS, "|").alias("tags"), label.alias("label"))


@query("time_range", f"""{with_lv}SELECT {', '.join(VIEW_COLUMNS)} FROM lv
    WHERE "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-12 12:00:00'""")
def _(spark, sf_dir):
    return ops.time_range(log_view(spark, sf_dir), "timestamp", "2024-01-05 00:00:00", "2024-01-12 12:00:00")


@query("min_level", f"{with_en}SELECT event_id, lvl AS level FROM en WHERE rnk >= 4")
def _(spark, sf_dir):
    return ops.min_level(ops.enrich_levels(log_view(spark, sf_dir)), "WARNING").select("event_id", F.col(S.LEVEL).alias("level"))


@query("first_n_events", f"""{with_lv}SELECT event_id, CAST(rn AS INTEGER) AS event_rank, message FROM (
    SELECT *, row_number() OVER (ORDER BY us NULLS LAST, event_id) AS rn FROM lv) WHERE rn <= 100""")
def _(spark, sf_dir):
    df = ops.normalize_time(log_view(spark, sf_dir))
    return ops.first_n_events(df, 100).select("event_id", "event_rank", "message")


@query("first_n_events_per_host", f"""{with_lv}SELECT host, event_id, CAST(rn AS INTEGER) AS event_rank, message FROM (
    SELECT *, row_number() OVER (PARTITION BY host ORDER BY us NULLS LAST, event_id) AS rn FROM lv) WHERE rn <= 5""")
def _(spark, sf_dir):
    df = ops.normalize_time(log_view(spark, sf_dir))
    return ops.first_n_events(df, 5, scope=["host"]).select("host", "event_id", "event_rank", "message")


@query("normalize_message", f"""{with_lv}SELECT event_id, trim(regexp_replace(message, {quote(VOLATILE_TOKEN_PATTERN)}, '<N>', 'gi'),
    E' \\t\\n\\r\\x0b\\x0c') AS message_pattern FROM lv""")
def _(spark, sf_dir):
    return log_view(spark, sf_dir).select("event_id", normalize_message(F.col("message")).alias("message_pattern"))


def _iso(t: str, us: str) -> str:
    return f"(CASE WHEN {us} % 1000000 <> 0 THEN strftime({t}, '%Y-%m-%dT%H:%M:%S.%gZ') ELSE strftime({t}, '%Y-%m-%dT%H:%M:%SZ') END)"


def duration_sql(us: str) -> str:
    s = f"(abs({us}) // 1000000)"
    return (f"(CASE WHEN {s} >= 3600 THEN ({s} // 3600) || 'h ' || (({s} % 3600) // 60) || 'm ' || ({s} % 60) || 's' "
            f"WHEN {s} >= 60 THEN ({s} // 60) || 'm ' || ({s} % 60) || 's' ELSE {s} || 's' END)")


def iso_sql(us: str) -> str:
    return _iso(f"make_timestamp({us})", us)


@query("format_ts", f"{with_lv}SELECT event_id, {iso_sql('us')} AS time_text, {iso_sql('us // 1000000 * 1000000')} AS second_text FROM lv")
def _(spark, sf_dir):
    df = ops.normalize_time(log_view(spark, sf_dir))
    whole = F.col(S.MICROS) - F.col(S.MICROS) % 1_000_000
    return df.select("event_id", format_ts(F.col(S.MICROS)).alias("time_text"), format_ts(whole).alias("second_text"))


@query("format_duration", f"""{with_lv}, d AS (SELECT event_id, us - 1705000000000000 AS gap FROM lv)
    SELECT event_id, {duration_sql('gap')} AS duration, {duration_sql('gap // 1000')} AS short FROM d""")
def _(spark, sf_dir):
    df = ops.normalize_time(log_view(spark, sf_dir))
    gap = F.col(S.MICROS) - 1_705_000_000_000_000
    # Whole-number division as the SQL side does it: cut off towards zero, also for negative gaps.
    short = F.call_function("div", gap, F.lit(1000))
    return df.select("event_id", format_duration(gap).alias("duration"), format_duration(short).alias("short"))


def relative_sql(us: str, base: str) -> str:
    return (f"(strftime(make_timestamp({us}), '%H:%M:%S') || CASE WHEN {us} < {base} THEN ' (T-' || {duration_sql(f'({us} - {base})')} || ')' "
            f"WHEN {us} > {base} THEN ' (T+' || {duration_sql(f'({us} - {base})')} || ')' ELSE '' END)")


@query("format_relative", f"{with_lv}SELECT event_id, {relative_sql('us', '1705000000000000')} AS relative FROM lv")
def _(spark, sf_dir):
    df = ops.normalize_time(log_view(spark, sf_dir))
    return df.select("event_id", format_relative(F.col(S.MICROS), F.lit(1_705_000_000_000_000)).alias("relative"))


@query("clip_text", f"""SELECT page_id, translate(substr(html, 1, 100), '|' || chr(10), '¦ ') AS cell,
    CASE WHEN length(html) > 500 THEN substr(html, 1, 500) || '{CLIP_MARKER}' ELSE html END AS clipped FROM pages""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", table_cell(F.col("html")).alias("cell"), clip_marked(F.col("html")).alias("clipped"))


@query("row_to_text", f"""{with_lv}, p AS (SELECT event_id, concat_ws(' | ', 'event_id=' || event_id, 'timestamp=' || "timestamp", """ + ", ".join(
    f"CASE WHEN {c} <> '' THEN '{c}=' || {c} END" for c in VIEW_COLUMNS[2:]) + """) AS t FROM lv)
    SELECT event_id, t AS row_text FROM p""")
def _(spark, sf_dir):
    df = log_view(spark, sf_dir)
    return df.select("event_id", row_to_text(df.columns).alias("row_text"))


_HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1))"


def host_class_sql(h: str) -> str:
    return (f"CASE WHEN {h} = 'localhost' OR {h} LIKE '%.local' OR (regexp_matches({h}, {quote(V4_PATTERN)}) AND "
            f"regexp_matches({h}, {quote(INTERNAL_V4_PATTERN)})) OR ({h} LIKE '%:%' AND "
            f"regexp_matches({h}, {quote(INTERNAL_V6_PATTERN)})) THEN 'internal' ELSE 'external' END")


@query("classify_host", f"""WITH h AS (SELECT page_id, {_HOST_SQL} AS url_host FROM pages)
    SELECT page_id, url_host, {host_class_sql('url_host')} AS host_class FROM h""")
def _(spark, sf_dir):
    return evidence.classify_url_hosts(table(spark, sf_dir, "pages"), "url").select("page_id", "url_host", "host_class")


@query("classify_address", f"{with_lv}SELECT event_id, src_ip, {host_class_sql('src_ip')} AS host_class FROM lv")
def _(spark, sf_dir):
    df = evidence.classify_addresses(log_view(spark, sf_dir), "src_ip")
    return df.select("event_id", "src_ip", "host_class")


