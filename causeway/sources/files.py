"""Log files: lines with their place, encodings, CSV, routing by format, fingerprints."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from causeway.sources import segments
from causeway.sources.rawlog import assemble_records, sniff_format

# Names Spark's readers know the encodings by.
SPARK_ENCODING = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "windows-1252",
                  "ascii": "US-ASCII"}


def read_lines(spark: SparkSession, path, encoding: str = "utf-8", separator: str | None = None) -> DataFrame:
    """(file, block, seq, line): every line of every file with its place in the file.

    A block is the split Spark reads in one task, known by its offset; `seq` grows within it.
    """
    reader = spark.read.option("encoding", SPARK_ENCODING[encoding])
    if separator is not None:
        reader = reader.option("lineSep", separator)
    raw = reader.text(path if isinstance(path, list) else [path])
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), _decoded(F.col("value"), encoding).alias("line"))


def _decoded(value: Column, encoding: str) -> Column:
    if encoding in ("utf-8", "utf-8-sig"):
        return F.regexp_replace(value, "^﻿", "") if encoding == "utf-8-sig" else value
    return F.decode(value.cast("binary"), SPARK_ENCODING[encoding])


def _fits(value: Column, encoding: str) -> Column:
    """Can the bytes of this line be read in the encoding?"""
    bytes_ = value.cast("binary")
    if encoding in ("utf-8", "utf-8-sig"):
        return F.is_valid_utf8(value)
    if encoding == "ascii":
        return ~F.decode(bytes_, "ISO-8859-1").rlike(r"[^\x00-\x7f]")
    if encoding == "cp1252":
        return ~F.decode(bytes_, "ISO-8859-1").rlike(r"[\x81\x8d\x8f\x90\x9d]")
    return F.lit(True)


def detect_encoding(spark: SparkSession, path, requested: str = "utf-8", source: Column | None = None) -> DataFrame:
    """The first of (requested, utf-8-sig, latin-1) that every line of the file can be read in.

    Lines are tested one by one, so a file of any size is split among tasks. Where one log lies in many files,
    `source`, an expression over `_metadata`, tells what belongs together and is given as `file`.
    """
    order = list(dict.fromkeys([requested, "utf-8-sig", "latin-1"]))
    raw = spark.read.text(path if isinstance(path, list) else [path])
    name = F.col("_metadata.file_path") if source is None else source
    checked = raw.groupBy(name.alias("file")).agg(
        *[F.min(_fits(F.col("value"), e)).alias(f"fits_{i}") for i, e in enumerate(order)])
    chosen = F
    for i, e in enumerate(order):
        chosen = chosen.when(F.col(f"fits_{i}"), e)
    return checked.select("file", chosen.otherwise("latin-1").alias("encoding"))


def read_csv(spark: SparkSession, path, encoding: str = "utf-8", infer: bool = True, schema=None,
             multi_line: bool = True, header: str | None = None) -> DataFrame:
    """CSV files with a header. Pass a schema at scale: types are inferred by one task per file, and
    without a schema or `header`, the files' first line, names are looked up in a pass of their own.

    With `multi_line` quoted values may hold line breaks. Files are split all the same: a first pass
    counts the quotes of every split, so that each task knows whether its split begins inside quotes. Quotes
    then have to be paired, as in RFC 4180; lines end with a line feed, a carriage return before it is
    dropped at the end of a record and kept inside quotes. Rows get an `event_id`, unless they have one.
    """
    reader = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
              .option("encoding", SPARK_ENCODING[encoding]))
    if not multi_line:
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)
        return with_row_id(reader.csv(path))
    records = csv_records(spark, path, encoding)
    if schema is None:
        if header is None or header.count('"') % 2:
            header = (records.where(F.col("part") == segments.HEADER).select(F.min_by("text", "file")).first() or [None])[0] or ""
        names = _column_names(header)
        found = reader.option("inferSchema", True).csv(path).schema.fields if infer else []
        kinds = [f.dataType for f in found] if len(found) == len(names) else [StringType()] * len(names)
        schema = StructType([StructField(n, k) for n, k in zip(names, kinds)])
    kind = schema if isinstance(schema, str) else schema.toDDL()
    row = F.from_csv(F.regexp_replace("text", "\r$", ""), kind, {"escape": '"', "multiLine": "true"})
    rows = records.where(F.col("part") != segments.HEADER).select(_row_id(F.col("file"), F.col("record_no")).alias("event_id"), row.alias("row"))
    names = rows.schema["row"].dataType.names
    return rows.select("row.*") if "event_id" in names else rows.select("event_id", "row.*")


def _column_names(header: str) -> list[str]:
    """Names of a header record; empty ones are named by their place, repeated ones get it as ending."""
    names = next(csv.reader(io.StringIO(header.rstrip("\r"), newline="")), [])
    named = [n or f"_c{i}" for i, n in enumerate(names)]
    return [f"{n}{i}" if named.count(n) > 1 else n for i, n in enumerate(named)]


def csv_records(spark: SparkSession, path, encoding: str = "utf-8") -> DataFrame:
    """`file, record_no, part, text` of the records of CSV files; the number is that of the record's first line,
    the part of the header is segments.HEADER."""
    lines = read_lines(spark, path, encoding, "\n")
    quotes = F.char_length("line") - F.char_length(F.replace("line", F.lit('"'), F.lit("")))
    lines = lines.withColumn("mark", quotes)
    splits = lines.groupBy("file", "block").agg(
        F.sum("mark").alias("_quotes"), F.count("*").alias("_lines"), F.count_if(F.col("line").rlike(r"\S")).alias("_filled"))
    earlier = segments.before(splits, {"_quotes": "quotes", "_lines": "lines", "_filled": "records"})
    # One row per split, of all of which the driver keeps a list itself.
    placed = lines.join(F.broadcast(earlier), ["file", "block"])
    return segments.records(placed.withColumn("odd", F.col("quotes") % 2 == 1), quoted=True)


def _row_id(file: Column, number: Column) -> Column:
    return F.concat_ws(":", file, F.lpad(number.cast("string"), 15, "0"))


def with_row_id(df: DataFrame) -> DataFrame:
    """Rows of files with an `event_id` of the file and the row's number in it, unless they have one.

    The number counts the rows of the file, however it is split and however splits are packed into tasks:
    rows are numbered within their task, and the first number of each split, and the rows of the splits
    before it, come from a pass over the same scan.
    """
    if "event_id" in df.columns:
        return df
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), at.alias("_at"))
    splits = rows.groupBy(F.col("_file").alias("file"), F.col("_block").alias("block")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = segments.before(splits, {"_rows": "rows"}).join(splits.select("file", "block", "_first"), ["file", "block"])
    keyed = earlier.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "_first", F.col("rows").alias("_rows"))
    # One row per split, of all of which the driver keeps a list itself.
    placed = rows.join(F.broadcast(keyed), ["_file", "_block"])
    return placed.select(_row_id(F.col("_file"), F.col("_rows") + F.col("_at") - F.col("_first") + 1).alias("event_id"), *[F.col(f"`{c}`") for c in df.columns])


def read_raw(spark: SparkSession, path, encoding: str = "utf-8") -> DataFrame:
    """The records of raw logs, with an `event_id` made of the file, the record's number and, before the first, the part."""
    records = assemble_records(read_lines(spark, path, encoding), "file", "block", "seq", "line", in_order=True)
    part = F.when(F.col("part") > 0, F.lpad(F.col("part").cast("string"), 10, "0"))
    return records.select(F.concat_ws(":", _row_id(F.col("source"), F.col("record_no")), part).alias("event_id"), "*")


def route_files(spark: SparkSession, path, requested: str = "utf-8") -> DataFrame:
    """(file, format, encoding, multi_line, header) of every file; the header is the first line of a CSV file.

    A record that goes on over a line break leaves an odd number of quotes on its first line.
    """
    lines = read_lines(spark, path)
    formats = sniff_format(lines, "file", ["block", "seq"], "line").select(
        "file", "format", F.when(F.col("format") == "csv", F.col("first_line")).alias("header"))
    quotes = F.char_length("line") - F.char_length(F.replace("line", F.lit('"'), F.lit("")))
    spanning = lines.groupBy("file").agg(F.max(quotes % 2 == 1).alias("multi_line"))
    return formats.join(detect_encoding(spark, path, requested), "file").join(spanning, "file")


def load_logs(spark: SparkSession, path, requested: str = "utf-8", infer: bool = True) -> dict[tuple[str, str, bool, str | None], DataFrame]:
    """One table per (format, encoding, multi_line, header) that occurs; `load_events` makes one of them.

    Only file names come to the driver, as they do for any read of a list of files.
    """
    routed: dict[tuple[str, str, bool, str | None], list[str]] = {}
    for r in route_files(spark, path, requested).collect():
        spanning = r.format == "csv" and r.multi_line
        routed.setdefault((r.format, r.encoding, spanning, r.header), []).append(r.file)
    return {(fmt, enc, spanning, header): read_raw(spark, files, enc) if fmt == "raw"
            else read_csv(spark, files, enc, infer=infer, multi_line=spanning, header=header)
            for (fmt, enc, spanning, header), files in routed.items()}


def load_events(spark: SparkSession, path, requested: str = "utf-8") -> DataFrame:
    """All log files as one table of text columns, matched by name; columns that a file lacks are null."""
    tables = list(load_logs(spark, path, requested, infer=False).values())
    if not tables:
        raise ValueError(f"no log file at {path}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def file_fingerprints(spark: SparkSession, path) -> DataFrame:
    """Incident id and SHA-256 of each file's bytes. One file is one value here, so this is for
    files of up to 2 GB; tables and larger inputs take `table_fingerprint`."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("file"), F.upper(F.substring(F.md5("content"), 1, 8)).alias("incident_id"),
                      F.sha2("content", 256).alias("sha256"))


def table_fingerprint(df: DataFrame, columns: list[str] | None = None, scope=()) -> DataFrame:
    """Incident id and SHA-256 of the rows of each scope, whatever their order.

    Each row is hashed; the four words of the hashes are summed, which merges in any order and
    counts repeated rows.
    """
    columns = columns or df.columns
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in columns])
    rows = df.select(*scope, F.md5(line).alias("h"))

    def word(i: int) -> Column:
        return F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("bigint").cast("decimal(38,0)"))

    sums = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), *[word(i).alias(f"w{i}") for i in range(4)])
    text = F.concat_ws("-", *[F.col(c).cast("string") for c in ("n", "w0", "w1", "w2", "w3")])
    return sums.select(*scope, F.upper(F.substring(F.md5(text), 1, 8)).alias("incident_id"), F.sha2(text, 256).alias("sha256"))
