"""Level, flags and tags of every event: one narrow projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from causeway import schema as S
from causeway.functions import levels, tags
from causeway.plans.once import compute_once
from causeway.plans.scaling import top_k
from causeway.rules import DEFAULT_RULES, RuleSet
from causeway.schema import Roles, resolve_roles
from causeway.sources.ids import with_event_id
from causeway.sources.timestamps import TimeFormat, parse_timestamps


def normalize_time(df: DataFrame, roles: Roles | None = None, year: int = 1970,
                   time_format: TimeFormat | None = None) -> DataFrame:
    """Add the event time and its microseconds; a text or number column is voted on first, unless its format is given."""
    (source,) = (roles or resolve_roles(df)).need("timestamp")
    field = df.schema[source].dataType
    df = df.withColumn(S.EVENT_TIME, F.col(f"`{source}`"))
    if not isinstance(field, (TimestampType, TimestampNTZType)):
        df = parse_timestamps(df, S.EVENT_TIME, year, formats=time_format and {S.EVENT_TIME: time_format})
    return (df.withColumn(S.EVENT_TIME, F.col(S.EVENT_TIME).cast("timestamp"))
            .withColumn(S.MICROS, F.unix_micros(S.EVENT_TIME)))


def enrich_levels(df: DataFrame, roles: Roles | None = None, year: int = 1970,
                  time_format: TimeFormat | None = None) -> DataFrame:
    """Time, level and level flags: enough for operators that look at errors and warnings only."""
    roles = roles or resolve_roles(df)
    if roles.timestamp and S.MICROS not in df.columns:
        df = normalize_time(df, roles, year, time_format)
    df = compute_once(df, {S.LEVEL: levels.find_level(roles.level, S.text_columns(df))})
    word = F.col(S.LEVEL)
    return df.withColumns({S.LEVEL: levels.canonical_level(word), S.IS_ERROR: levels.is_error(word),
                           S.IS_WARNING: levels.is_warning(word)})


def with_tags(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Flags and tags from the combined text, which must be present."""
    df = compute_once(df, {S.LOWERED: f"lower({S.COMBINED})"})
    named = {S.FLAG_PREFIX + t: sql for t, sql in tags.tag_flags(S.COMBINED, S.LOWERED, rules).items()}
    named[S.IS_RECOVERY] = tags.recovery_flag(S.COMBINED, S.LOWERED, rules)
    df = compute_once(df, named)
    listed = tags.assemble_tags({t: S.FLAG_PREFIX + t for t in rules.tags})
    return df.selectExpr(f"* EXCEPT ({S.LOWERED})", f"{listed} AS {S.TAGS}")


def enrich(df: DataFrame, roles: Roles | None = None, rules: RuleSet = DEFAULT_RULES, year: int = 1970,
           time_format: TimeFormat | None = None) -> DataFrame:
    """The whole normalisation: time, level, combined text, flags, tags.

    A table without an `event_id` gets one from its contents, which takes a shuffle; streams need their own.
    A table that brings time, level, flags and tags already keeps them and gets what else is missing.
    Write the result (`write_enriched`) and run the operators on the written table: they then read
    only the columns they need and push their filters into the scan.
    """
    if roles is None and not df.isStreaming:
        df = with_event_id(df)
    texts = S.text_columns(df)
    if {S.EVENT_TIME, S.LEVEL, S.IS_ERROR, S.IS_WARNING, S.IS_RECOVERY, S.IS_ANOMALY, S.TAGS} <= set(df.columns):
        missing = {S.MICROS: F.unix_micros(F.col(S.EVENT_TIME).cast("timestamp")), S.COMBINED: F.expr(tags.combine_text([*texts, S.LEVEL])),
                   **{S.FLAG_PREFIX + t: F.array_contains(S.TAGS, t) for t in rules.tags}}
        return df.withColumns({c: value for c, value in missing.items() if c not in df.columns})
    df = enrich_levels(df, roles, year, time_format)
    df = with_tags(compute_once(df, {S.COMBINED: tags.combine_text([*texts, S.LEVEL])}), rules)
    flags = " OR ".join([S.IS_ERROR, *[f"`{S.FLAG_PREFIX}{t}`" for t in rules.tags]])
    return df.selectExpr("*", f"({flags}) AS {S.IS_ANOMALY}")


def time_range(df: DataFrame, column: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Both ends included; rows without a time are dropped by either bound."""
    kind = df.schema[column].dataType.simpleString()
    if since is not None:
        df = df.where(F.col(column) >= F.lit(since).cast(kind))
    if until is not None:
        df = df.where(F.col(column) <= F.lit(until).cast(kind))
    return df


def min_level(df: DataFrame, level: str) -> DataFrame:
    """Rows of at least the given level."""
    from causeway.rules import LEVEL_RANKS

    return df.where(levels.severity_rank(F.col(S.LEVEL)) >= LEVEL_RANKS.get(level.upper(), -1))


def time_order(roles: Roles) -> list[Column]:
    """The total order of events: time, those without one last, then the event id."""
    (event_id,) = roles.need("event_id")
    return [F.col(S.MICROS).asc_nulls_last(), F.col(event_id).asc()]


def chronological(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Time order of the whole table; a range-partitioned sort, meant for sinks only."""
    return df.orderBy(*time_order(roles or resolve_roles(df)))


def first_n_events(df: DataFrame, n: int, roles: Roles | None = None, scope=()) -> DataFrame:
    """The first n events of each scope."""
    return top_k(df, scope, time_order(roles or resolve_roles(df)), n, "event_rank")
