"""Consistent pseudonyms for addresses, UUIDs, session ids and mail addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.text import holds
from causeway.plans.once import compute_once
from causeway.plans.scaling import attach, materialize, running_total
from causeway.rules import PSEUDONYM_KINDS

BLOCK = 65_536
# What every value of a kind holds, and how often: texts without it skip the pattern.
_SIGNS = {"ip": (".", 3), "uuid": ("-", 4), "sid": ("-", 1), "mail": ("@", 1)}


def _pattern(kind: str) -> tuple[str, str]:
    pattern, any_case, prefix = PSEUDONYM_KINDS[kind]
    return ("(?i)" if any_case else "") + pattern, prefix


def _found(text: Column, kind: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(_pattern(kind)[0]), F.lit(0))
    return F.when(holds(text, *_SIGNS[kind]), hits).otherwise(F.array().cast("array<string>"))


def number_values(rows: DataFrame, found: str, order: str, kind: str, scope=()) -> DataFrame:
    """(scope, kind, value, pseudonym, uses): distinct values numbered by first appearance.

    `order` is a bigint that orders the rows, `found` the column of the values found in each. Numbers are built
    from blocks of `order`, so neither the rows nor the dictionary go through one task.
    """
    _, prefix = _pattern(kind)
    found = rows.select(*scope, order, F.posexplode(found).alias("_pos", "value"))
    first = found.groupBy(*scope, "value").agg(
        F.min(F.struct(F.col(order).alias("row"), "_pos")).alias("at"), F.count(F.lit(1)).alias("uses"))
    # Written, since running numbers read it twice.
    first = materialize(first, f"pseudonyms-{kind}-values")
    blocks = first.withColumn("_block", F.call_function("div", F.col("at.row"), F.lit(BLOCK)))
    numbered = running_total(blocks, scope, "_block", [F.col("at")], F.lit(1), "n")
    return numbered.select(*scope, F.lit(kind).alias("kind"), "value",
                           F.concat(F.lit(prefix + "-"), F.col("n").cast("string")).alias("pseudonym"), "uses")


def _replaced(text: Column, found: Column, pattern: str, names: Column) -> Column:
    """The pieces between the matches, each followed by the pseudonym of the match after it.

    `found` must be a column: inside the function an expression would be evaluated for every piece.
    """
    return F.array_join(F.transform(F.split(text, pattern, -1), lambda piece, i: F.concat(
        piece, F.coalesce(F.try_element_at(names, F.coalesce(F.get(found, i), F.lit(""))), F.lit("")))), "")


def replace_values(rows: DataFrame, names: DataFrame, text: str, found: str, order: str, kind: str, scope=()) -> DataFrame:
    """Rows with the values of one kind, which column `found` lists, replaced. Only distinct values per row are joined;
    the values used most are served apart, since one address may occur in a third of all rows."""
    pattern, _ = _pattern(kind)
    values = rows.select(*scope, order, F.explode(F.array_distinct(found)).alias("value"))
    known = attach(values, names.select(*scope, "value", "pseudonym", "uses"), [*scope, "value"], "p", F.col(order), "uses")
    per_row = known.groupBy(*scope, order).agg(
        F.map_from_entries(F.collect_list(F.struct("value", "p.pseudonym"))).alias("_names"))
    out = rows.join(per_row, [*scope, order], "left")
    new = F.when(F.col("_names").isNull(), F.col(text)).otherwise(_replaced(F.col(text), F.col(found), pattern, F.col("_names")))
    return out.withColumn(text, new).drop("_names")


def pseudonymize(df: DataFrame, text: str, order: str, scope=()) -> tuple[DataFrame, DataFrame]:
    """Replace all four kinds, one after the other, and give (table, dictionary).

    `order` must be a bigint that is unique within the scope. Each kind is searched in the text left
    by the one before, so the rows with any hit are written between the steps, with the values found; rows
    without any hit are not touched.
    """
    scope = list(scope)
    any_hit = reduce(lambda a, b: a | b, [holds(F.col(text), *_SIGNS[k]) & F.col(text).rlike(_pattern(k)[0]) for k in PSEUDONYM_KINDS])
    work = compute_once(df.select(*scope, order, text), {text: f"`{text}`"}).where(any_hit)
    names = []
    for kind in PSEUDONYM_KINDS:
        work = materialize(work.withColumn("_found", _found(F.col(text), kind)), f"pseudonyms-{kind}-text")
        numbered = materialize(number_values(work, "_found", order, kind, scope), f"pseudonyms-{kind}")
        names.append(numbered)
        work = replace_values(work, numbered, text, "_found", order, kind, scope).drop("_found")
    changed = work.withColumnRenamed(text, "_new_text")
    out = df.join(changed, [*scope, order], "left").withColumn(text, F.coalesce("_new_text", F.col(text))).drop("_new_text")
    return out.select(*df.columns), reduce(DataFrame.unionByName, names).drop("uses")
