"""Addresses, ports, URLs and failure words found in the texts; internal and external hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway import schema as S
from causeway.functions.hosts import host_class, url_host
from causeway.functions.text import holds
from causeway.plans.once import compute_once
from causeway.plans.scaling import top_k, with_scope
from causeway.rules import EVIDENCE_PATTERNS

# No evidence pattern can match across a double quote, so the columns of a row joined by it are
# searched once per pattern instead of once per pattern and column.
_BARRIER = '"'
# What every value of a kind holds in any case, and how often: texts without it skip the pattern.
_SIGNS = {"ipv4": (".", 3), "ipv6": (":", 2), "url": ("://", 1)}


def network_evidence(df: DataFrame, scope=(), columns: list[str] | None = None, ignore_case: bool = False) -> DataFrame:
    """Distinct (kind, value) pairs per scope. Case-sensitive unless asked otherwise."""
    columns = S.text_columns(df) if columns is None else columns
    text = f"concat_ws('{_BARRIER}', {', '.join(f'`{c}`' for c in columns)})"
    prefix = "(?i)" if ignore_case else ""
    rows = compute_once(with_scope(df, scope), {"_text": text}).select(*scope, "_text")

    def values(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all("_text", F.lit(prefix + pattern), F.lit(0))
        if kind in _SIGNS:
            hits = F.when(holds(F.col("_text"), *_SIGNS[kind]), hits).otherwise(F.array().cast("array<string>"))
        return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(*[values(kind, p) for kind, p in EVIDENCE_PATTERNS.items()])
    return rows.select(*scope, F.explode(found).alias("e")).select(*scope, "e.kind", "e.value").distinct()


def evidence_summary(evidence: DataFrame, scope=(), shown: int | None = 30) -> DataFrame:
    """Per kind the number of distinct values and the first ones in text order; all of them for `None`."""
    number, values = F.count(F.lit(1)).alias("distinct_values"), F.sort_array(F.collect_list("value")).alias("shown_values")
    if shown is None:
        # Both in one aggregation: a join of the two would search all texts twice.
        return evidence.groupBy(*scope, "kind").agg(number, values)
    first = top_k(evidence, [*scope, "kind"], [F.col("value").asc()], shown, "_r")
    return evidence.groupBy(*scope, "kind").agg(number).join(first.groupBy(*scope, "kind").agg(values), [*scope, "kind"])


def classify_url_hosts(df: DataFrame, url: str) -> DataFrame:
    """Host of each URL and whether it lies inside the own network."""
    return df.withColumn("url_host", url_host(F.col(url))).withColumn("host_class", host_class(F.col("url_host")))


def classify_addresses(df: DataFrame, address: str) -> DataFrame:
    return df.withColumn("host_class", host_class(F.lower(F.trim(F.col(address)))))
