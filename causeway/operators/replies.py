"""Audit of a table of model replies that should be JSON reviews."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.rules import REPLY_KEYS, REPLY_SECTIONS


def _salvage(text: str) -> tuple[str, object] | None:
    """The object that begins at the first brace, found in one scan; an object can end at one place only."""
    start = text.find("{")
    if start < 0:
        return None
    try:
        value, stop = json.JSONDecoder().raw_decode(text, start)
    except ValueError:
        return None
    return text[start:stop], value


_REPAIRED = T.StructType([
    T.StructField("body", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType())),
    T.StructField("kind", T.StringType())])


@F.pandas_udf(_REPAIRED)
def _repair(texts: pd.Series) -> pd.DataFrame:
    def one(text):
        if text is None:
            return None, None, None
        try:
            body, value = text, json.loads(text)
        except ValueError:
            body, value = _salvage(text) or (None, None)
            if body is None:
                return None, None, "unreadable"
        if not isinstance(value, dict):
            return None, None, "not_an_object"
        return body, list(value), "object"

    return pd.DataFrame([one(t) for t in texts], columns=["body", "keys", "kind"])


def _apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are not copied into later filters or projections (see `compute_once`)."""
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def audit_replies(df: DataFrame, text: str) -> DataFrame:
    """Status, reason, missing keys and the usable JSON text of every reply.

    Plain objects are recognised natively. Python gets the texts of the other replies alone and looks for the
    object in them; plain ones pass it as nulls, since splitting the table in two would parse every reply twice.
    A filter on the status stays above all this: pushed down, it would read every reply, and make it, many times.
    """
    kept = df.columns
    df = _apart(df, _text=F.col(f"`{text}`"))
    c = F.col("_text")
    # Strict JSON with nothing around it: as the only element of an array it must still parse.
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    df = _apart(df, _listed=listed, _own=F.json_object_keys(c))
    whole = (F.col("_listed").isNotNull() & F.try_variant_get("_listed", "$[1]", "variant").isNull()
             & F.col("_own").isNotNull())
    df = _apart(df, _whole=F.coalesce(whole, F.lit(False))).drop("_listed")
    df = df.withColumn("_fix", _repair(F.when(~F.col("_whole") & (c != ""), c)))
    keys = F.when(F.col("_whole"), F.col("_own")).otherwise(F.col("_fix.keys"))
    required = F.array(*[F.lit(k) for k in REPLY_KEYS])
    df = _apart(df, missing_keys=F.array_except(required, F.coalesce(keys, F.array().cast("array<string>"))))
    df = _apart(df, reason=F.when(F.coalesce(c, F.lit("")) == "", "empty")
                .when(F.col("_fix.kind") == "unreadable", "unreadable")
                .when(F.size("missing_keys") > 0, "missing_keys"))
    body = F.when(F.col("_whole"), c).otherwise(F.col("_fix.body"))
    return df.select(
        *[F.col(f"`{name}`") for name in kept], "reason", "missing_keys",
        F.when(F.col("reason").isNull(), "ok").otherwise("error").alias("status"),
        F.when(F.col("reason").isNull(), body).alias("analysis"))


def flatten_review(audited: DataFrame, keys: list[str]) -> DataFrame:
    """One row per item of the list sections of a valid reply; blank items are dropped."""
    sections = F.array(*[F.struct(F.lit(k).alias("section"), F.get_json_object("analysis", f"$.{k}").alias("raw"))
                         for k in REPLY_SECTIONS])
    rows = audited.where(F.col("status") == "ok").select(*keys, F.explode(sections).alias("s"))
    items = F.when(F.col("s.raw").startswith("["), F.from_json("s.raw", "array<string>")).otherwise(F.array("s.raw"))
    flat = rows.select(*keys, "s.section", F.posexplode(F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != ""))).alias("_i", "item"))
    return flat.select(*keys, "section", (F.col("_i") + 1).alias("item_no"), "item")
