"""Timestamps of a text or number column: one format per column, chosen by count of hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats that are tried, in order of preference.
FORMATS = {
    "iso_fraction_zone": "yyyy-M-d'T'H:m:s.SSSSSS[XXX][XX]",
    "iso_zone": "yyyy-M-d'T'H:m:s[XXX][XX]",
    "iso_fraction": "yyyy-M-d'T'H:m:s.SSSSSS",
    "iso": "yyyy-M-d'T'H:m:s",
    "sql_fraction": "yyyy-M-d H:m:s.SSSSSS",
    "sql_comma_fraction": "yyyy-M-d H:m:s,SSSSSS",
    "sql": "yyyy-M-d H:m:s",
    "access_log": "d/MMM/yyyy:H:m:s Z",
    "syslog": "yyyy MMM d H:m:s",
    "us": "M/d/yyyy H:m:s",
    "day_first": "d-M-yyyy H:m:s",
}
# What a text of each format looks like. Only texts of the right shape are parsed: a failed attempt
# costs far more than a look at the shape.
_ZONE = r"(Z|[+-]\d{2}:?\d{2})"
_DAY, _CLOCK, _FRACTION = r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}:\d{1,2}:\d{1,2}", r"\d{1,6}"
SHAPES = {
    "iso_fraction_zone": rf"^{_DAY}T{_CLOCK}\.{_FRACTION}{_ZONE}$",
    "iso_zone": rf"^{_DAY}T{_CLOCK}{_ZONE}$",
    "iso_fraction": rf"^{_DAY}T{_CLOCK}\.{_FRACTION}$",
    "iso": rf"^{_DAY}T{_CLOCK}$",
    "sql_fraction": rf"^{_DAY} {_CLOCK}\.{_FRACTION}$",
    "sql_comma_fraction": rf"^{_DAY} {_CLOCK},{_FRACTION}$",
    "sql": rf"^{_DAY} {_CLOCK}$",
    "access_log": rf"^\d{{1,2}}/[A-Za-z]{{3}}/\d{{4}}:{_CLOCK} [+-]\d{{4}}$",
    "syslog": rf"^[A-Za-z]{{3}}\s+\d{{1,2}} {_CLOCK}$",
    "us": rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}} {_CLOCK}$",
    "day_first": rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}} {_CLOCK}$",
}
# Between these the median of a column of numbers must lie.
EPOCH_RANGES = {"seconds": (1e9, 2e9), "millis": (1e12, 2e12)}
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


@dataclass(frozen=True)
class TimeFormat:
    """How one column is read: epoch unit, a named format, or Spark's own cast."""

    kind: str
    year: int = 1970


def _by_format(c: Column, name: str, year: int) -> Column:
    text = F.concat(F.lit(f"{year} "), F.regexp_replace(c, r"\s+", " ")) if name == "syslog" else c
    return F.when(c.rlike(SHAPES[name]), F.try_to_timestamp(text, F.lit(FORMATS[name])))


def _number(c: Column) -> Column:
    text = c.cast("string")
    # A colon is in every text of a time and in no number: a look for it spares the pattern.
    return F.when(~text.contains(":") & text.rlike(_NUMBER), text.try_cast("double"))


def parse_column(c: Column, fmt: TimeFormat) -> Column:
    if fmt.kind in ("seconds", "millis"):
        scale = 1_000_000 if fmt.kind == "seconds" else 1000
        return F.timestamp_micros(F.round(_number(c) * scale).cast("bigint"))
    if fmt.kind == "inferred":
        return c.try_cast("timestamp")
    return _by_format(c.cast("string"), fmt.kind, fmt.year)


def _median_inside(row, kind: str) -> bool:
    """Whether the median lies between the bounds, told from how many numbers lie below and above them."""
    n, below, above = row["numbers"], row[f"{kind}_below"], row[f"{kind}_above"]
    if 2 * below < n and 2 * above < n:
        return True
    if 2 * below != n and 2 * above != n:
        return False
    # A bound parts the two middle numbers; the median is their mean.
    pair = ("low", "up") if 2 * below == n else ("down", "high")
    first, second = (row[f"{kind}_{x}"] for x in pair)
    if first is None or second is None:
        return False
    low, high = EPOCH_RANGES[kind]
    return low < (first + second) / 2 < high


# A sign that a text holds, and the only formats whose shape may hold it; the last are those of texts with neither.
_SIGNS = {"/": ("access_log", "us"), "T": ("iso_fraction_zone", "iso_zone", "iso_fraction", "iso", "syslog"),
          "": ("sql_fraction", "sql_comma_fraction", "sql", "syslog", "day_first")}


def _format_number(c: Column, year: int) -> Column:
    """The place in FORMATS of the one format that a text is written in, if it can be read so; shapes exclude each other.

    Every shape holds a colon; a look for few signs leaves few patterns to be tried.
    """
    places = list(FORMATS)

    def among(names) -> Column:
        chain = F
        for name in names:
            chain = chain.when(c.rlike(SHAPES[name]), F.when(_by_format(c, name, year).isNotNull(), places.index(name)))
        return chain

    chain = F.when(~c.contains(":"), F.lit(None).cast("int"))
    for sign, names in _SIGNS.items():
        chain = chain.when(c.contains(sign), among(names))
    return chain


def choose_formats(df: DataFrame, columns: list[str], year: int = 1970) -> dict[str, TimeFormat]:
    """One pass over the table gives all votes; only the counts come to the driver, one row per column.

    Each value is looked at once, for its number and its format; what is counted are these. The columns
    are gone through as one array, so that the expressions are there once and not once per column.
    """
    texts = F.array(*[F.col(f"`{name}`").cast("string") for name in columns])
    seen = F.transform(texts, lambda c: F.struct(_number(c).alias("number"), _format_number(c, year).alias("form")))
    number, form = F.col("s.number"), F.col("s.form")
    votes = [F.count(number).alias("numbers"), F.count(F.lit(1)).alias("rows")]
    for kind, (low, high) in EPOCH_RANGES.items():
        votes += [F.count_if(number <= low).alias(f"{kind}_below"), F.count_if(number >= high).alias(f"{kind}_above"),
                  F.max(F.when(number <= low, number)).alias(f"{kind}_low"), F.min(F.when(number > low, number)).alias(f"{kind}_up"),
                  F.max(F.when(number < high, number)).alias(f"{kind}_down"), F.min(F.when(number >= high, number)).alias(f"{kind}_high")]
    votes += [F.count_if(form == k).alias(f) for k, f in enumerate(FORMATS)]
    rows = df.select(F.posexplode(seen).alias("i", "s")).groupBy("i").agg(*votes).collect()
    counted = {row["i"]: row for row in rows}
    out = {}
    for i, name in enumerate(columns):
        row = counted.get(i)
        if row is None:  # an empty table
            out[name] = TimeFormat("inferred", year)
            continue
        if row["numbers"] > 0.8 * row["rows"]:
            unit = next((kind for kind in EPOCH_RANGES if _median_inside(row, kind)), None)
            if unit:
                out[name] = TimeFormat(unit)
                continue
        best = max(FORMATS, key=lambda f: row[f])
        out[name] = TimeFormat(best if row[best] else "inferred", year)
    return out


def parse_timestamps(df: DataFrame, columns, year: int = 1970, per_row: bool = False,
                     formats: dict[str, TimeFormat] | None = None) -> DataFrame:
    """Replace text or number columns by timestamps.

    The format is chosen once per column, so rows written in another format become null; with
    `per_row` each row takes the first format that fits instead. `formats`, as `choose_formats` gives
    them, spare the vote; a stream needs them, as it cannot be counted beforehand.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    if per_row:
        return df.withColumns({
            n: F.coalesce(*[_by_format(F.col(f"`{n}`").cast("string"), f, year) for f in FORMATS],
                          F.col(f"`{n}`").try_cast("timestamp")) for n in columns})
    if formats is None and df.isStreaming:
        raise ValueError(f"a stream needs `formats` for its text times {columns}: take choose_formats of a table like it")
    chosen = choose_formats(df, columns, year) if formats is None else formats
    return df.withColumns({n: parse_column(F.col(f"`{n}`"), chosen[n]) for n in columns})
