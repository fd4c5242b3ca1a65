import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from causeway.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture(scope="session")
def events(spark):
    """Build an enriched table from (seconds, host, level, message) rows."""
    from datetime import datetime, timedelta, timezone

    from causeway.operators.enrich import enrich

    base = datetime(2024, 3, 15, 8, 0, 0, tzinfo=timezone.utc)

    def build(rows, extra=None):
        data = [(i, None if r[0] is None else base + timedelta(seconds=r[0]), *r[1:]) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, "event_id long, timestamp timestamp, host string, log_level string, message string")
        return enrich(df)

    return build
