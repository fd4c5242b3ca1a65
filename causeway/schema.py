"""Which column plays which role. Resolved on the driver from the schema alone; no job is run."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from causeway import rules as R

EVENT_TIME = "_timestamp_parsed"
MICROS = "_micros"
LEVEL = "_log_level"
COMBINED = "_raw_combined"
LOWERED = "_raw_lowered"
IS_ERROR, IS_WARNING, IS_RECOVERY, IS_ANOMALY = "_is_error", "_is_warning", "_is_recovery", "_is_anomaly"
TAGS = "_anomaly_tags"
FLAG_PREFIX = "_anomaly_"


class MissingRole(ValueError):
    """An operator needs a role that no column of the table fills."""


@dataclass(frozen=True)
class Roles:
    event_id: str | None = None
    timestamp: str | None = None
    level: str | None = None
    host: str | None = None
    cross_host: str | None = None
    service: str | None = None
    src: str | None = None
    dst: str | None = None
    message: str | None = None
    error_message: str | None = None
    source: str | None = None
    raw: str | None = None

    def need(self, *names: str) -> tuple[str, ...]:
        missing = [n for n in names if getattr(self, n) is None]
        if missing:
            raise MissingRole(f"no column fills the role(s): {', '.join(missing)}")
        return tuple(getattr(self, n) for n in names)


def _first(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def _timestamp_column(columns: list[str]) -> str | None:
    by_lower = {c.lower(): c for c in columns}
    folded = next((by_lower[c] for c in R.TIMESTAMP_CANDIDATES if c in by_lower), None)
    return _first(columns, R.TIMESTAMP_CANDIDATES) or folded


def _level_column(columns: list[str]) -> str | None:
    for candidate in R.LEVEL_CANDIDATES:
        if candidate in columns:
            return candidate
        folded = next((c for c in columns if c.lower() == candidate), None)
        if folded:
            return folded
    return None


def resolve_roles(columns, **overrides: str) -> Roles:
    """Bind roles by column name; a named override wins and must exist."""
    columns = list(columns.columns if isinstance(columns, DataFrame) else columns)
    unknown = [c for c in overrides.values() if c is not None and c not in columns]
    if unknown:
        raise MissingRole(f"no such column(s): {', '.join(unknown)}")
    roles = Roles(
        event_id=_first(columns, ("event_id",)),
        timestamp=_timestamp_column(columns),
        level=_level_column(columns),
        host=_first(columns, R.HOST_CANDIDATES),
        cross_host=_first(columns, R.CROSS_HOST_CANDIDATES),
        service=_first(columns, R.SERVICE_CANDIDATES),
        src=_first(columns, R.SRC_CANDIDATES),
        dst=_first(columns, R.DST_CANDIDATES),
        message=_first(columns, R.MESSAGE_CANDIDATES),
        error_message=_first(columns, (*R.MESSAGE_CANDIDATES, "_raw")),
        source=_first(columns, ("source",)),
        raw=_first(columns, ("_raw",)),
    )
    return replace(roles, **overrides)


_DERIVED = {EVENT_TIME, MICROS, LEVEL, COMBINED, LOWERED, IS_ERROR, IS_WARNING, IS_RECOVERY, IS_ANOMALY, TAGS, "event_date"}


def is_derived(column: str) -> bool:
    return column in _DERIVED or column.startswith(FLAG_PREFIX)


def source_columns(df: DataFrame) -> list[str]:
    """Columns that came with the data, in schema order."""
    return [c for c in df.columns if not is_derived(c)]


def display_columns(df: DataFrame) -> list[str]:
    return [c for c in source_columns(df) if not c.startswith("_")]


def text_columns(df: DataFrame) -> list[str]:
    """String columns of the data but the event id: the only ones regular expressions are run on."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and not is_derived(f.name) and f.name != "event_id"]
