"""Raw application logs: lines to records, over files that are split among many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.levels import canonical_level
from causeway.rules import RAW_LINE_PATTERN
from causeway.sources import segments

_HEADER = "(?i)" + RAW_LINE_PATTERN


def is_header(line: Column) -> Column:
    return line.rlike(_HEADER)


def _part(line: Column, group: int) -> Column:
    return F.regexp_extract(line, _HEADER, group)


def assemble_records(lines: DataFrame, file: str, block: str, seq: str, line: str, in_order: bool = False) -> DataFrame:
    """Records of `timestamp, log_level, logger, thread, message, source, _raw` per file, with `record_no, part`.

    Lines that do not start a record belong to the record before, also when that one began in an
    earlier block; lines before the first header form one record without a time, in parts of 65,536
    lines. A file may be of any size: record numbers are running counts of header lines, and only the
    pieces at the ends of blocks are moved. `block` tells bounded parts of the file apart (an offset or
    a line number range) and `seq` orders the lines of a block. Lines that come in the order of their
    scan (`in_order`) stay where they are; others are dealt out by block once. Blank lines are dropped.
    """
    text = F.col(line)
    kept = lines.where(text.rlike(r"\S")).select(
        F.col(file).alias("file"), F.col(block).alias("block"), F.col(seq).alias("seq"), text.alias("line"),
        is_header(text).cast("int").alias("mark"))
    splits = kept.groupBy("file", "block").agg(F.sum("mark").alias("_heads"), F.count("*").alias("_lines"))
    earlier = segments.before(splits, {"_heads": "records", "_lines": "lines"})
    if in_order:  # one row per split, of all of which the driver keeps a list itself
        placed = kept.join(F.broadcast(earlier), ["file", "block"])
    else:
        placed = kept.repartition("file", "block").join(earlier, ["file", "block"]).sortWithinPartitions("file", "block", "seq")
    whole = segments.records(placed.withColumn("odd", F.lit(False)), quoted=False)
    raw = F.col("text")
    first, headed = F.substring_index(raw, "\n", 1), F.col("record_no") > 0
    rest = F.substring(raw, F.length(first) + 1, F.length(raw))
    return whole.select(
        F.col("file").alias("source"), "record_no", "part",
        F.when(headed, _part(first, 1)).alias("timestamp"),
        F.when(headed, canonical_level(F.upper(_part(first, 2)))).otherwise("UNKNOWN").alias("log_level"),
        F.when(headed, F.trim(_part(first, 3), F.lit("[]"))).otherwise("").alias("logger"),
        F.when(headed, F.trim(_part(first, 4), F.lit("()"))).otherwise("").alias("thread"),
        F.when(headed, F.concat(_part(first, 5), rest)).otherwise(raw).alias("message"), raw.alias("_raw"))


def sniff_format(lines: DataFrame, file: str, order: list[str], line: str) -> DataFrame:
    """`raw` or `csv` per file, from its first line that is not blank."""
    text = F.col(line)
    first = lines.where(text.rlike(r"\S")).groupBy(file).agg(
        F.min_by(F.trim(text, F.lit(" \t\r")), F.struct(*order)).alias("first_line"))
    return first.withColumn("format", F.when(is_header(F.col("first_line")), "raw").otherwise("csv"))
