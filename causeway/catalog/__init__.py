"""The registered queries with their equivalent SQL."""

from __future__ import annotations

from causeway.catalog import (  # noqa: F401
    chains, impacts, incidents, scalars, sources, streams, summaries, texts, timing)
from causeway.catalog.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
