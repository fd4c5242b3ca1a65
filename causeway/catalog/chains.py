"""The whole way from files to incidents: load, roles, times, flow key, enrichment, incident."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway import schema as S
from causeway.catalog.incidents import HOST, _shown
from causeway.catalog.logview import LV, log_view, quote, unzoned
from causeway.catalog.registry import SQL, query
from causeway.catalog.sources import RAW, RECORDS, raw_lines
from causeway.operators import impact, incident, rule_table
from causeway.operators.enrich import enrich
from causeway.plans.scaling import materialize, shared_dir
from causeway.rules import RECOVERY_PATTERN
from causeway.sources import files


@query("pipeline_csv", SQL["incident"])
def _(spark, sf_dir):
    """The log view as CSV files of text columns; ids are padded, so that they sort as the numbers do."""
    path = shared_dir(spark, "chain-csv")
    rows = log_view(spark, sf_dir).withColumn("event_id", F.lpad(F.col("event_id").cast("string"), 18, "0"))
    rows = rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    events = materialize(enrich(files.load_events(spark, path)), "chain-events")
    found = _shown(incident.incident(events, scope=HOST, flow_key=impact.detect_flow_key(events)))
    return found.select("host", "total_events", "error_events", "warning_events", "anomaly_events", F.col("root_event_id").cast("long").alias("root_event_id"),
                        "root_ts", "root_level", "root_host", "root_message", "root_tags", "root_flow", "cascade_count", "precursor_count",
                        "mttr_us", "severity_score", "severity_grade", "confidence", "confidence_reason", "sla_breach")


@query("pipeline_raw", f"""WITH {RAW}, rc AS (SELECT r.*, fi.rec FROM (SELECT *, row_number() OVER () AS i FROM ({RECORDS})) r JOIN (SELECT *, row_number() OVER () AS i FROM fi) fi USING (i)),
    t AS (SELECT source AS service, rec, epoch_us(strptime("timestamp", '%Y-%m-%d %H:%M:%S,%g')) AS us, log_level, message, log_level IN ('CRITICAL', 'ERROR') AS is_error,
        log_level = 'WARNING' AS is_warning, regexp_matches("_raw", {quote(RECOVERY_PATTERN)}, 'i') AS is_recovery FROM rc),
    o AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY CASE WHEN is_error THEN 0 WHEN is_warning THEN 1 ELSE 2 END, us NULLS LAST, rec) AS rn FROM t),
    r AS (SELECT service, us AS t0, log_level, message FROM o WHERE rn = 1)
    SELECT service, count(*) AS total_events, count(*) FILTER (is_error) AS error_events, count(*) FILTER (is_warning) AS warning_events, make_timestamp(any_value(t0)) AS root_ts,
        any_value(r.log_level) AS root_level, any_value(r.message) AS root_message, count(*) FILTER (is_error AND us > t0 AND us <= t0 + 300000000) AS cascade_count,
        min(CASE WHEN is_recovery AND us > t0 THEN us - t0 END) AS mttr_us FROM t JOIN r USING (service)
    WHERE service NOT IN (SELECT service FROM t WHERE rec = 0) GROUP BY service""")
def _(spark, sf_dir):
    """The same as raw logs, a file per service. A file whose first line is no record's is not taken for a raw log."""
    path = shared_dir(spark, "chain-raw")
    lines = raw_lines(spark, sf_dir).repartition("file").sortWithinPartitions("file", "line_no")
    lines.select("file", "line").write.partitionBy("file").text(path)
    service = F.regexp_extract("source", "file=([^/]+)/", 1)
    events = materialize(enrich(files.load_events(spark, path)).withColumn("service", service), "chain-raw-events")
    found = incident.incident(events, scope=["service"])
    return unzoned(found.select("service", "total_events", "error_events", "warning_events", F.timestamp_micros("root_micros").alias("root_ts"),
                                "root_level", "root_message", "cascade_count", "mttr_us"))


# Three hundred rules; of those with the same number one is without a literal.
_RULES = [(f"r{k:03d}", *rule) for k, rule in enumerate(
    [(rf"kill process {i}\b", f"process {i}") for i in range(100)] + [(rf"^(view|click) {i}$", f" {i}") for i in range(100)]
    + [(rf"query time: 0*{i}\b", None if i == 7 else "query time") for i in range(100)])]


@query("custom_rules_table", f"""WITH {LV}, ru(tag, pattern) AS (VALUES {", ".join(f"({quote(t)}, {quote(p)})" for t, p, _ in _RULES)}),
    h AS (SELECT event_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM lv JOIN ru ON regexp_matches(message, pattern, 'i') GROUP BY event_id)
    SELECT event_id, coalesce(tags, '') AS tags FROM lv LEFT JOIN h USING (event_id)""")
def _(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "tag string, pattern string, literal string")
    tagged = rule_table.tag_by_rules(log_view(spark, sf_dir).select("event_id", "message"), rules, "message")
    return tagged.select("event_id", F.array_join("rule_tags", "|").alias("tags"))
