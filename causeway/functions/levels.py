"""Log level columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway import rules as R
from causeway.plans.once import literal

_BLANKS = " \t\n\r\x0b\x0c"


def canonical_level(up: Column) -> Column:
    """An upper-case level name with the two short spellings written out."""
    return F.when(up == "ERR", "ERROR").when(up == "WARN", "WARNING").otherwise(up)


def find_level(level: str | None, texts: list[str]) -> str:
    """The level column in upper case where it is filled, else the first level word of the texts.

    A level word cannot reach over a blank, so the first hit in the joined texts is the first hit
    from left to right. Given as SQL text.
    """
    joined = "concat_ws(' ', " + ", ".join(f"`{c}`" for c in texts) + ")"
    word = f"upper(regexp_extract({joined}, {literal('(?i)' + R.LEVEL_PATTERN)}, 1))"
    found = f"coalesce(nullif({word}, ''), 'UNKNOWN')"
    if level is None:
        return found
    text = f"CAST(`{level}` AS STRING)"
    return f"IF(`{level}` IS NOT NULL, upper(trim(BOTH {literal(_BLANKS)} FROM {text})), {found})"


def severity_rank(level: Column, ranks: dict[str, int] = R.LEVEL_RANKS, default: int = -1) -> Column:
    up = F.upper(level)
    names_of = {r: [n for n in ranks if ranks[n] == r] for r in ranks.values() if r != default}
    out = F
    for rank, names in names_of.items():
        out = out.when(up.isin(*names), rank)
    return out.otherwise(default)


def is_error(level: Column) -> Column:
    return F.upper(level).isin(*R.ERROR_LEVELS)


def is_warning(level: Column) -> Column:
    return F.upper(level).isin(*R.WARNING_LEVELS)
