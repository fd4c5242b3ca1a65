"""Ids for tables that come without any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16  # copies of one row that one task writes out


def content_hash(df: DataFrame) -> Column:
    """128 bits of a row's values, as 32 hexadecimal digits. The place of a value counts, so nulls do too."""
    parts = []
    for i, (name, kind) in enumerate(df.dtypes):
        column = F.col(f"`{name}`")
        parts.append(F.lit(i))
        if "map<" not in kind:
            parts.append(column)
        if "<" in kind:  # nested nulls count in the text form alone
            parts.append(column.cast("string"))
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in ("a", "b")])


def with_event_id(df: DataFrame) -> DataFrame:
    """Rows with an `event_id` of their content and a running number among equal rows, unless they have one.

    Equal rows are counted and written out again with their numbers, so the ids are the same however the
    table is split, and rows that repeat very often cost one row per task before the shuffle. Of events at
    the same time the one of smaller hash comes first.
    """
    if "event_id" in df.columns:
        return df
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_hash", content_hash(df))
    few = counted.where(F.col("_copies") <= CHUNK).withColumn("_no", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    many = counted.where(F.col("_copies") > CHUNK)
    many = many.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {CHUNK}")))).repartition("_hash", "_chunk")
    first = F.col("_chunk") * CHUNK
    many = many.withColumn("_no", F.explode(F.sequence(first + 1, F.least(first + CHUNK, "_copies")))).drop("_chunk")
    number = F.lpad(F.col("_no").cast("string"), 12, "0")
    return few.unionByName(many).select(F.concat_ws(":", "_hash", number).alias("event_id"), *columns)
