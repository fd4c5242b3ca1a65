"""The log view: an event log with levels, hosts and messages derived from the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from causeway.operators.enrich import enrich
from causeway.rules import (APPLICATION_PATTERNS, ERROR_LEVELS, EVIDENCE_PATTERNS, LEVEL_PATTERN, LEVEL_RANKS,
                            NETWORK_TAGS, RECOVERY_PATTERN, WARNING_LEVELS)


def prepare(spark: SparkSession) -> None:
    """Event times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def spread(df: DataFrame) -> DataFrame:
    """A small file that Spark reads in fewer tasks than there are cores is dealt out to all of them,
    as regular expressions cost far more than the reading. Larger tables stay as they are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sliced(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Dealt out so that no task gets more than about `rows` rows, for queries with much work on each row. A scan
    makes as many tasks as there are cores of a table of a few GB, so that its tasks would grow with the table."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# Messages of failing events by k % 12, and of the other events; the same texts in both languages.
FAILURES = [
    ("'connection timeout to 10.1.0.' || CAST(k % 8 AS STRING) || ' port=5432'"),
    ("'Out of memory: kill process ' || CAST(k AS STRING)"),
    ("'no space left on device'"),
    ("'Exception in worker'"),
    ("'slow query, query time: ' || CAST(k AS STRING)"),
    ("'connection pool exhausted, request timed out'"),
    ("'authentication failed for u' || CAST(user_id AS STRING) || '@example.com'"),
    ("'NXDOMAIN for db.internal'"),
    ("'packet loss, retransmit'"),
    ("'TLS handshake fail'"),
    ("'segfault at 0x7f3a'"),
    ("'kernel panic'"),
]
LEVEL_SQL = """CASE
    WHEN event_type = 'error' AND user_id % 12 = 5 THEN 'INFO'
    WHEN event_type = 'error' AND k % 10 = 0 THEN 'CRITICAL'
    WHEN event_type = 'error' OR (user_id % 12 = 3 AND event_type IN ('click', 'view')) THEN 'ERR'
    WHEN event_type = 'signup' THEN 'WARN'
    WHEN event_type = 'click' THEN 'DEBUG'
    ELSE 'INFO' END"""
MESSAGE_SQL = "CASE WHEN event_type = 'error' AND user_id % 12 <> 5 THEN CASE k % 12 " + " ".join(
    f"WHEN {i} THEN {text}" for i, text in enumerate(FAILURES)) + """ END
    WHEN event_type = 'purchase' AND k % 20 = 0 THEN 'service recovered'
    WHEN event_type = 'signup' AND k % 10 = 5 THEN 'worker restarted by supervisor'
    WHEN event_type = 'view' AND k = 0 THEN 'GET https://h' || CAST(user_id % 12 AS STRING) || '.example.com/a from 00:1b:44:11:3a:b7'
    WHEN event_type = 'view' AND k = 50 THEN 'fetch http://192.168.1.9/b via fe80::1:2'
    WHEN event_type = 'signup' AND k % 10 = 0 THEN 'load average: ' || CAST(k AS STRING)
    ELSE event_type || ' ' || CAST(k AS STRING) END"""
COLUMNS_SQL = {
    "host": "'h' || CAST(user_id % 12 AS STRING)",
    "session_id": "'sess-' || CAST(user_id AS STRING)",
    "sourcetype": "'svc' || CAST(user_id % 5 AS STRING)",
    "source": "'/var/log/app' || CAST(user_id % 6 AS STRING)",
    "src_ip": "'10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 50 AS STRING)",
    "dst_ip": "'10.1.0.' || CAST(k % 8 AS STRING)",
    "log_level": LEVEL_SQL,
    "message": MESSAGE_SQL,
}
VIEW_COLUMNS = ["event_id", "timestamp", *COLUMNS_SQL]


def view_of(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The log view of a table or stream of events."""
    keyed = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return keyed.select("event_id", F.col("ts").alias("timestamp"), *extra,
                        *[F.expr(sql).alias(name) for name, sql in COLUMNS_SQL.items()])


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_of(table(spark, sf_dir, "events"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(log_view(spark, sf_dir))


def unzoned(df: DataFrame) -> DataFrame:
    """Times as un-zoned timestamps, as the SQL side gives them."""
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, TimestampType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


# ---- the same in SQL ----

def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(quote(v) for v in values)


TAG_PATTERNS = {**APPLICATION_PATTERNS, **{t: EVIDENCE_PATTERNS[t] for t in NETWORK_TAGS}}
TAGS = list(TAG_PATTERNS)

LV = ("ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),\n"
      "lv AS (SELECT event_id, ts AS \"timestamp\", epoch_us(ts) AS us, "
      + ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS_SQL.items()).replace("AS STRING", "AS VARCHAR") + " FROM ev)")


def canonical_sql(x: str) -> str:
    return f"(CASE {x} WHEN 'ERR' THEN 'ERROR' WHEN 'WARN' THEN 'WARNING' ELSE {x} END)"


TEXT_COLUMNS = list(COLUMNS_SQL)
RANK_SQL = "CASE lvl " + " ".join(f"WHEN '{n}' THEN {r}" for n, r in LEVEL_RANKS.items()) + " ELSE -1 END"
EN = (
    LV + ",\nl1 AS (SELECT *, " + canonical_sql("upper(trim(log_level))") + " AS lvl FROM lv),\n"
    "l2 AS (SELECT *, concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in [*TEXT_COLUMNS, "lvl"]) + ") AS rc FROM l1),\n"
    f"l3 AS (SELECT *, {RANK_SQL} AS rnk, lvl IN ({in_list(ERROR_LEVELS)}) AS is_error, lvl IN ({in_list(WARNING_LEVELS)}) AS is_warning, "
    f"regexp_matches(rc, {quote(RECOVERY_PATTERN)}, 'i') AS is_recovery, "
    + ", ".join(f"regexp_matches(rc, {quote(p)}, 'i') AS f_{t}" for t, p in TAG_PATTERNS.items()) + " FROM l2),\n"
    "en AS (SELECT *, is_error OR " + " OR ".join(f"f_{t}" for t in TAGS) + " AS is_anomaly, "
    "list_filter([" + ", ".join(f"CASE WHEN f_{t} THEN '{t}' END" for t in TAGS) + "], lambda x: x IS NOT NULL) AS tags FROM l3)"
)
LEVEL_WORD = quote(LEVEL_PATTERN)

