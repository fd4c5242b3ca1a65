import pytest

from causeway import schema as S
from causeway.operators import impact, reports
from causeway.schema import MissingRole, resolve_roles


def test_timestamp_exact_names_win_over_folded_ones():
    assert resolve_roles(["TIME", "datetime"]).timestamp == "datetime"
    assert resolve_roles(["DateTime", "Time"]).timestamp == "Time"
    assert resolve_roles(["x"]).timestamp is None


def test_level_is_matched_per_candidate():
    assert resolve_roles(["severity", "Level"]).level == "Level"
    assert resolve_roles(["priority", "log level"]).level == "log level"


def test_host_roles_differ():
    roles = resolve_roles(["source", "src"])
    assert (roles.host, roles.cross_host, roles.service) == ("src", None, "source")


def test_overrides_must_exist():
    assert resolve_roles(["a", "host"], host="a").host == "a"
    with pytest.raises(MissingRole):
        resolve_roles(["host"], host="gone")
    with pytest.raises(MissingRole):
        resolve_roles(["x"]).need("timestamp")


def test_text_columns_leave_out_derived_ones(events):
    df = events([(0, "a", "INFO", "x")])
    assert S.text_columns(df) == ["host", "log_level", "message"]
    assert S.display_columns(df) == ["event_id", "timestamp", "host", "log_level", "message"]


def test_operators_without_their_role_say_so(spark):
    df = spark.createDataFrame([(1, "x")], "event_id long, note string")
    with pytest.raises(MissingRole):
        impact.host_impact(df)
    with pytest.raises(MissingRole):
        reports.timeline(df.drop("event_id"))


def test_flow_key_detection(spark):
    rows = [(i, f"s{i % 3}", "same", f"t{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, Session_ID string, request_id string, note string")
    assert impact.detect_flow_key(df) == "Session_ID"
    assert impact.detect_flow_key(df, "note") == "note"
    assert impact.detect_flow_key(df.drop("Session_ID")) == "note"
    assert impact.detect_flow_key(df.select("event_id", "request_id")) is None
    with pytest.raises(MissingRole):
        impact.detect_flow_key(df, "gone")
