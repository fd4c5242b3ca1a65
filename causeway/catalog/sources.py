"""Files written from the given tables and read back, raw lines, fingerprints, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway import schema as S
from causeway.catalog.logview import EN, LV, TAGS, enriched, log_view, quote, table, unzoned, view_of
from causeway.catalog.registry import query
from causeway.operators import reports
from causeway.plans.scaling import shared_dir
from causeway.rules import RAW_LINE_PATTERN
from causeway.sources import custody, files, rawlog


@query("csv_source", f"""WITH {LV} SELECT event_id, "timestamp", host, session_id, sourcetype, source, src_ip, dst_ip, log_level, message FROM lv""")
def _(spark, sf_dir):
    df = log_view(spark, sf_dir)
    path = shared_dir(spark, "csv-source")
    df.write.option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return files.read_csv(spark, path, schema=df.schema, multi_line=False)


@query("csv_source_multiline", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    path = shared_dir(spark, "csv-documents")
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_csv(spark, path, schema=df.schema).drop("event_id")


# One header line per event (none for some views), two more lines after every exception.
_HEAD = """CASE WHEN event_type = 'view' AND k % 10 = 9 THEN '  more of the same ' || CAST(k AS {s})
    ELSE {time} || ' ' || {level} || '  [' || source || '] (worker-' || CAST(k AS {s}) || ') ' || message END"""
_LINES = [(0, None), (1, "CASE WHEN message = 'Exception in worker' THEN {tab} || 'at com.example.Job.run(Job.java:' || CAST(k AS {s}) || ')' END"),
          (2, "CASE WHEN message = 'Exception in worker' THEN {tab} || '... ' || CAST(k AS {s}) || ' more' END"),
          (3, "CASE WHEN k % 7 = 0 THEN '   ' END")]


def _lines_of(s: str, time: str, tab: str, level: str) -> list[str]:
    head = _HEAD.format(s=s, time=time, level=level)
    return [head if t is None else t.format(s=s, tab=tab) for _, t in _LINES]


def raw_lines(spark, sf_dir):
    """(file, line_no, line): the log view as raw application logs, one file per service."""
    rows = view_of(table(spark, sf_dir, "events"), ("event_type", "k"))
    texts = _lines_of("STRING", "date_format(timestamp, 'yyyy-MM-dd HH:mm:ss,SSS')", "'\\t'", "log_level")
    lines = F.array(*[F.struct(F.lit(i).alias("i"), F.expr(t).alias("line")) for i, t in enumerate(texts)])
    return rows.select(F.col("sourcetype").alias("file"), "event_id", F.explode(lines).alias("l")).where("l.line IS NOT NULL").select(
        "file", (F.col("event_id") * 4 + F.col("l.i")).alias("line_no"), F.col("l.line").alias("line"))


_SQL_LINES = " UNION ALL ".join(
    f"SELECT sourcetype AS file, event_id * 4 + {i} AS line_no, {t} AS line FROM lw WHERE ({t}) IS NOT NULL"
    for i, t in enumerate(_lines_of("VARCHAR", "strftime(ts, '%Y-%m-%d %H:%M:%S,%g')", "chr(9)", "log_level")))
_P = quote("(?i)" + RAW_LINE_PATTERN)
RAW = f"""{LV}, lw AS (SELECT ev.ts, ev.event_type, ev.k, lv.* FROM ev JOIN lv USING (event_id)), rl AS ({_SQL_LINES}),
    nb AS (SELECT *, regexp_matches(line, {_P}) AS head FROM rl WHERE trim(line) <> ''),
    nr AS (SELECT *, sum(head::INT) OVER (PARTITION BY file ORDER BY line_no) AS rec FROM nb),
    fi AS (SELECT file, rec, arg_min(line, line_no) AS h, string_agg(line, chr(10) ORDER BY line_no) AS raw,
        string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT head) AS rest FROM nr GROUP BY file, rec)"""


def _g(i: int) -> str:
    return f"regexp_extract(h, {_P}, {i})"


RECORDS = f"""SELECT file AS source, CASE WHEN rec > 0 THEN {_g(1)} END AS "timestamp",
    CASE WHEN rec = 0 THEN 'UNKNOWN' ELSE CASE upper({_g(2)}) WHEN 'ERR' THEN 'ERROR' WHEN 'WARN' THEN 'WARNING' ELSE upper({_g(2)}) END END AS log_level,
    CASE WHEN rec > 0 THEN trim({_g(3)}, '[]') ELSE '' END AS logger, CASE WHEN rec > 0 THEN trim({_g(4)}, '()') ELSE '' END AS thread,
    CASE WHEN rec = 0 THEN raw WHEN rest IS NULL THEN {_g(5)} ELSE {_g(5)} || chr(10) || rest END AS message, raw AS "_raw" FROM fi"""


@query("raw_log_assemble", f"WITH {RAW} {RECORDS}")
def _(spark, sf_dir):
    lines = raw_lines(spark, sf_dir).withColumn("block", F.call_function("div", F.col("line_no"), F.lit(4096)))
    return rawlog.assemble_records(lines, "file", "block", "line_no", "line").drop("record_no", "part")


@query("raw_log_source", f"WITH {RAW}, rc AS ({RECORDS}) SELECT \"timestamp\", log_level, logger, thread, message, \"_raw\" FROM rc")
def _(spark, sf_dir):
    path = shared_dir(spark, "raw-logs")
    lines = raw_lines(spark, sf_dir).repartition("file").sortWithinPartitions("file", "line_no")
    lines.select("file", "line").write.partitionBy("file").text(path)
    return files.read_raw(spark, path).select("timestamp", "log_level", "logger", "thread", "message", "_raw")


@query("sniff_format", f"""WITH {LV}, lw AS (SELECT ev.ts, ev.event_type, ev.k, lv.* FROM ev JOIN lv USING (event_id)),
    rl AS (SELECT file, line_no, CASE WHEN file = 'svc4' THEN 'x,' || line ELSE line END AS line FROM ({_SQL_LINES})),
    f AS (SELECT file, arg_min(trim(line, E' \\t\\r'), line_no) AS first_line FROM rl WHERE trim(line) <> '' GROUP BY file)
    SELECT file, first_line, CASE WHEN regexp_matches(first_line, {_P}) THEN 'raw' ELSE 'csv' END AS format FROM f""")
def _(spark, sf_dir):
    lines = raw_lines(spark, sf_dir).withColumn(
        "line", F.when(F.col("file") == "svc4", F.concat(F.lit("x,"), "line")).otherwise(F.col("line")))
    return rawlog.sniff_format(lines, "file", ["line_no"], "line")


@query("detect_encoding", """SELECT lang, 'written as utf-8' AS written, 'utf-8' AS encoding FROM documents GROUP BY lang
    UNION ALL SELECT lang, 'written as latin-1', CASE WHEN bool_or(regexp_matches(text, '[\\x{80}-\\x{ff}]')) THEN 'latin-1' ELSE 'utf-8' END FROM documents GROUP BY lang""")
def _(spark, sf_dir):
    # Each task writes its own files of the languages it meets; a folder is one source.
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    folder = F.regexp_extract("_metadata.file_path", "lang=([^/]+)/", 1)
    out = []
    for encoding, spark_name in (("utf-8", "UTF-8"), ("latin-1", "ISO-8859-1")):
        path = shared_dir(spark, f"encoding-{encoding}")
        docs.write.partitionBy("lang").option("encoding", spark_name).csv(path)
        found = files.detect_encoding(spark, path, source=folder)
        out.append(found.select(F.col("file").alias("lang"), F.lit(f"written as {encoding}").alias("written"), "encoding"))
    return out[0].unionByName(out[1])


PRINT_COLUMNS = ["event_id", "host", "session_id", "sourcetype", "src_ip", "dst_ip", "log_level", "message"]


def print_sql(source: str, columns, scope) -> str:
    keys = "".join(f"{c}, " for c in scope)
    group = f"GROUP BY {', '.join(scope)}" if scope else ""
    line = "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in columns) + ")"
    words = ", ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT))::HUGEINT AS w{i}" for i in range(4))
    return f"""SELECT {keys}upper(substr(md5(s), 1, 8)) AS incident_id, sha256(s) AS sha256 FROM (SELECT {keys}concat_ws('-', n, w0, w1, w2, w3) AS s FROM
        (SELECT {keys}count(*) AS n, {words} FROM (SELECT {keys}md5({line}) AS h FROM {source}) {group}))"""


WHOLE_PRINT_COLUMNS = [*PRINT_COLUMNS, "timestamp", "source"]


@query("source_fingerprint", f"WITH {LV} {print_sql('lv', WHOLE_PRINT_COLUMNS, ['host'])}")
@query("source_fingerprint_whole", f"WITH {LV} {print_sql('lv', WHOLE_PRINT_COLUMNS, ['host'])}")
def _(spark, sf_dir):
    return files.table_fingerprint(log_view(spark, sf_dir), WHOLE_PRINT_COLUMNS, ["host"])


@query("source_fingerprint_global", print_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"], []))
def _(spark, sf_dir):
    return files.table_fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


# Small leaves and branches, so that the files here have several of either.
@query("file_tree_fingerprint", f"""WITH {RAW}, n AS (SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS i FROM rl),
    le AS (SELECT file, i // 64 AS leaf, sha256(string_agg(sha256(line), '' ORDER BY i)) AS h FROM n GROUP BY file, leaf),
    br AS (SELECT file, leaf // 16 AS branch, sha256(string_agg(h, '' ORDER BY leaf)) AS h FROM le GROUP BY file, branch),
    s AS (SELECT file, sum(strlen(line) + 1)::BIGINT AS n_bytes, count(*) AS n_lines FROM n GROUP BY file)
    SELECT file AS service, n_bytes, n_lines, sha256(n_bytes || ':' || n_lines || ':' || string_agg(h, '' ORDER BY branch)) AS tree_sha256
    FROM br JOIN s USING (file) GROUP BY file, n_bytes, n_lines""")
def _(spark, sf_dir):
    path = shared_dir(spark, "tree-logs")
    lines = raw_lines(spark, sf_dir).repartition("file").sortWithinPartitions("file", "line_no")
    lines.select("file", "line").write.partitionBy("file").text(path)
    found = custody.tree_fingerprints(spark, path, 64, 16)
    return found.select(F.regexp_extract("file", "file=([^/]+)/", 1).alias("service"), "n_bytes", "n_lines", "tree_sha256")


@query("export_enriched", f"""WITH {EN} SELECT event_id, "timestamp", host, message, lvl AS _log_level, is_error AS _is_error, is_warning AS _is_warning,
    is_recovery AS _is_recovery, is_anomaly AS _is_anomaly, {', '.join(f'f_{t} AS _anomaly_{t}' for t in TAGS)}, array_to_string(tags, '|') AS _anomaly_tags FROM en""")
def _(spark, sf_dir):
    path = shared_dir(spark, "enriched")
    reports.write_enriched(enriched(spark, sf_dir), path)
    flags = [S.LEVEL, S.IS_ERROR, S.IS_WARNING, S.IS_RECOVERY, S.IS_ANOMALY, *[S.FLAG_PREFIX + t for t in TAGS], S.TAGS]
    # The written table keeps the tags as lists; only the comparison joins them.
    return unzoned(reports.export_enriched(spark.read.parquet(path)).select("event_id", "timestamp", "host", "message", *flags))
