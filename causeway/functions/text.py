"""Message normalisation, clipping and row texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.rules import CLIP_MARKER, VOLATILE_TOKEN_PATTERN


def holds(c: Column, sign: str, times: int = 1) -> Column:
    """Whether a text holds a sign at least so many times; far cheaper than a pattern that needs it."""
    return F.substring_index(c, sign, times) != c


def normalize_message(c: Column) -> Column:
    """UUIDs, IPv4 addresses, hex literals and bare integers become `<N>`."""
    return F.trim(F.regexp_replace(c, "(?i)" + VOLATILE_TOKEN_PATTERN, "<N>"), F.lit(" \t\n\r\x0b\x0c"))


def table_cell(c: Column, limit: int = 100) -> Column:
    """Text fit for a table cell: clipped, no column separator, no line break."""
    return F.translate(F.substring(F.coalesce(c, F.lit("")), 1, limit), "|\n", "¦ ")


def clip(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit)


def clip_marked(c: Column, limit: int = 500, marker: str = CLIP_MARKER) -> Column:
    """Clipped text that shows it was clipped; null becomes the empty text."""
    full = F.coalesce(c, F.lit(""))
    return F.when(F.char_length(full) > limit, F.concat(F.substring(full, 1, limit), F.lit(marker))).otherwise(full)


def row_to_text(columns: list[str], limit: int | None = 500) -> Column:
    """`name=value | name=value` over the filled columns."""
    def part(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        return F.when((value != "") & (F.lower(value) != "nan"), F.concat(F.lit(f"{name}="), value))

    joined = F.concat_ws(" | ", *[part(c) for c in columns])
    return joined if limit is None else clip_marked(joined, limit)
