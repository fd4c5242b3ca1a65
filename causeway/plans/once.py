"""Expressions that must be evaluated once per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def literal(text: str) -> str:
    """A text as SQL literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def compute_once(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns, given as SQL expressions, that are not copied into later expressions.

    A filter or projection on a computed column normally pulls the whole expression into itself; with
    a chain of regular expressions over a joined text the copies multiply. Unfolding a one-element
    array stops that, while filters on the other columns still reach the scan.
    """
    replaced = [f"`{c}`" for c in columns if c in df.columns]
    kept = f"* EXCEPT ({', '.join(replaced)})" if replaced else "*"
    fields = ", ".join(f"{literal(name)}, {sql}" for name, sql in columns.items())
    return df.selectExpr(kept, f"inline(array(named_struct({fields})))")
