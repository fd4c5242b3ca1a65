import json
import re

import pytest
from pyspark.sql import functions as F

from causeway.operators import evidence, model_facts, reports
from causeway.operators.pseudonyms import pseudonymize
from causeway.operators.replies import audit_replies, flatten_review
from causeway.rules import PSEUDONYM_KINDS, REPLY_KEYS


def test_evidence_is_case_sensitive_unless_asked(spark):
    df = spark.createDataFrame([(1, "Timeout at 10.0.0.1", "timeout PORT=80"), (2, None, "port 80 10.0.0.1")],
                               "event_id long, a string, b string")
    found = {(r.kind, r.value) for r in evidence.network_evidence(df).collect()}
    assert found == {("ipv4", "10.0.0.1"), ("timeout", "timeout"), ("port", "port 80")}
    wide = {(r.kind, r.value) for r in evidence.network_evidence(df, ignore_case=True).collect()}
    assert wide - found == {("timeout", "Timeout"), ("port", "PORT=80")}


def test_evidence_does_not_reach_over_columns(spark):
    df = spark.createDataFrame([(1, "http://a", "b"), (2, "port", "80")], "event_id long, a string, b string")
    assert {(r.kind, r.value) for r in evidence.network_evidence(df).collect()} == {("url", "http://a")}


TEXTS = ["a 10.0.0.2 b 10.0.0.1 sess-abc", "10.0.0.1 me@x.org req-3f2504e0-4f89-11d3-9a0c-0305e82c3301",
         "nothing", "", "3F2504E0-4F89-11D3-9A0C-0305E82C3301 at 10.0.0.2, SESS-abc, txn-10.0.0.9"]


def test_pseudonyms_number_by_first_appearance(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "n long, t string")
    out, names = pseudonymize(df, "t", "n")
    got = [r.t for r in out.orderBy("n").collect()]
    assert got == ["a ANON-IP-1 b ANON-IP-2 ANON-SID-1", "ANON-IP-2 ANON-MAIL-1 ANON-SID-2", "nothing", "",
                   "ANON-UUID-2 at ANON-IP-1, ANON-SID-3, ANON-SID-4"]
    assert names.where("kind = 'sid'").count() == 4
    left = [k for k, (p, any_case, _) in PSEUDONYM_KINDS.items() for t in got if re.search(p, t, re.I if any_case else 0)]
    assert left == []


def test_values_are_found_once_per_kind(spark, monkeypatch):
    from causeway.operators import pseudonyms

    df = spark.createDataFrame(list(enumerate(TEXTS)), "n long, t string")
    plans, write = [], pseudonyms.materialize

    def seen(df, purpose):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, purpose)

    monkeypatch.setattr(pseudonyms, "materialize", seen)
    out, _ = pseudonymize(df, "t", "n")
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    # Written with the text of each kind, and taken from there by the numbers and the replacement.
    assert sum(p.count("regexp_extract_all") for p in plans) == len(PSEUDONYM_KINDS)


def test_pseudonyms_restart_per_scope(spark):
    df = spark.createDataFrame([("x", 1, "10.0.0.1"), ("y", 2, "10.0.0.2 10.0.0.1")], "s string, n long, t string")
    out, _ = pseudonymize(df, "t", "n", ["s"])
    assert {r.s: r.t for r in out.collect()} == {"x": "ANON-IP-1", "y": "ANON-IP-1 ANON-IP-2"}


FULL = {k: ([k, " "] if k.startswith("e") else k) for k in REPLY_KEYS}


@pytest.mark.parametrize("reply, status, reason", [
    (json.dumps(FULL), "ok", None), (json.dumps(FULL, indent=1), "ok", None),
    ("noise " + json.dumps(FULL) + " tail}", "ok", None), (json.dumps(FULL)[:-3] + " garbage", "error", "unreadable"),
    (json.dumps({k: v for k, v in FULL.items() if k != "confidenza"}), "error", "missing_keys"),
    ('noise {"a": 1} tail}', "error", "missing_keys"), ("no json", "error", "unreadable"), ("", "error", "empty"),
    (None, "error", "empty"), ("[1]", "error", "missing_keys"), ("{'a': 1}", "error", "unreadable"),
    (json.dumps({**FULL, "extra": float("nan")}), "ok", None)])
def test_reply_audit(spark, reply, status, reason):
    df = spark.createDataFrame([(1, reply)], "reply_id long, reply string")
    row = audit_replies(df, "reply").first()
    assert (row.status, row.reason) == (status, reason)
    if reason == "missing_keys" and "confidenza" not in (reply or ""):
        assert "confidenza" in row.missing_keys


def test_review_items(spark):
    body = {**FULL, "cause_alternative": "only one", "prossimi_controlli": []}
    df = spark.createDataFrame([(1, json.dumps(body))], "reply_id long, reply string")
    rows = flatten_review(audit_replies(df, "reply"), ["reply_id"]).collect()
    assert {(r.section, r.item_no, r.item) for r in rows} == {
        ("cause_alternative", 1, "only one"), ("evidenze_chiave", 1, "evidenze_chiave"),
        ("evidenze_deboli", 1, "evidenze_deboli"), ("evidenze_mancanti", 1, "evidenze_mancanti")}


def test_replies_are_read_once(spark):
    from causeway.catalog.texts import model_replies

    rows = flatten_review(audit_replies(model_replies(spark, "/root/testdata/sf0.001"), "reply"), ["reply_id"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == plan.count("parseJson") == plan.count("ArrowEvalPython") == 1


def test_model_context_hides_addresses(events):
    df = events([(0, "web01", "INFO", "ok login 10.0.0.5"), (10, "db01", "ERROR", "connection timeout to 10.0.0.9:5432")])
    clean = reports.model_events(df).collect()
    raw = reports.model_events(df, sanitize=False).collect()
    assert len(clean) == len(raw) == 1
    assert "10.0.0.9" not in clean[0].raw and "ANON-IP-1" in clean[0].raw and "10.0.0.9" in raw[0].raw
    calm = events([(i, "a", "INFO", "x") for i in range(40)])
    assert reports.model_events(calm, sanitize=False).count() == 30


def test_model_context_searches_evidence_once(events, monkeypatch):
    df = events([(0, "web01", "INFO", "ok login 10.0.0.5"), (10, "db01", "ERROR", "connection timeout to 10.0.0.9 port=5432 by fe80::1:2")])
    made, real = [], evidence.network_evidence
    monkeypatch.setattr(evidence, "network_evidence", lambda *args, **kw: made.append(args) or real(*args, **kw))
    text = model_facts.model_context(df, reports.incident_summary(df), sanitize=False).first().context
    assert len(made) == 1
    assert json.loads(text)["network_evidence"] == {
        "ipv4": ["10.0.0.5", "10.0.0.9"], "ipv6": ["::1:2"], "port": ["port=5432"], "timeout": ["timeout"]}
    plan = evidence.evidence_summary(real(df), shown=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_model_context_holds_all_facts(events):
    rows = [(0, "web", "WARNING", "retry to 10.0.0.9"), (10, "db", "ERROR", "connection timeout to 10.0.0.9 port=5432"),
            (11, "db", "ERROR", "connection timeout to 10.0.0.9 port=5432"), (12, "db", "ERROR", "out of memory"), (90, "db", "INFO", "service recovered")]
    df = events(rows)
    summary = reports.incident_summary(df)
    raw = json.loads(model_facts.model_context(df, summary, sanitize=False).first().context)
    assert (raw["confidence"], raw["confidence_reason"]) == ("MEDIUM", "error_with_tags")
    assert [c["tag"] for c in raw["causes"]][0] == "timeout" and {c["tag"] for c in raw["causes"]} == {"timeout", "oom_killer"}
    assert [e["level"] for e in raw["timeline_excerpt"]] == ["ERROR"] * 3 and len(raw["raw_error_extracts"]) == 3
    assert [p["level"] for p in raw["precursors"]] == ["WARNING"]
    assert raw["network_evidence"]["ipv4"] == ["10.0.0.9"]
    assert raw["top_recurring_errors"][0]["occurrences"] == 2
    assert [r["host"] for r in raw["recovery_timeline"]] == ["db"] and raw["mttr_seconds"] == 80.0
    text = model_facts.model_context(df, summary).first().context
    clean = json.loads(text)
    assert "10.0.0.9" not in text
    # One name in the timeline and among the evidence.
    assert clean["network_evidence"]["ipv4"] == ["ANON-IP-1"] and "ANON-IP-1" in clean["timeline_excerpt"][0]["raw"]
    assert {k: v for k, v in clean.items() if k in ("causes", "confidence", "total_events", "mttr_seconds")} == {
        k: v for k, v in raw.items() if k in ("causes", "confidence", "total_events", "mttr_seconds")}
    none = df.where("false")
    empty = json.loads(model_facts.model_context(none, reports.incident_summary(none)).first().context)
    assert empty["total_events"] == 0 and empty["timeline_excerpt"] == [] and empty["causes"] == []


def test_summary_record(spark, events, tmp_path):
    rows = [(0, "lb", "ERROR", "timeout to 10.0.0.1")] + [(i, "db", "ERROR", "out of memory") for i in range(1, 11)] + [
        (75, "lb", "INFO", "service recovered")]
    reports.write_summary(reports.incident_summary(events(rows)), str(tmp_path / "out"))
    # 11/12 of 25 for errors, 25 for the cascade, 75/3600 of 25 for recovery, 10 for a grave tag.
    severity = spark.read.json(str(tmp_path / "out")).first().severity
    assert (severity.score, severity.grade) == (58, "P3")
    row = reports.incident_summary(events(rows)).first()
    assert (row.total_events, row.error_events, row.host_count, row.cascade_count, row.mttr_seconds) == (12, 11, 2, 10, 75.0)
    assert row.root_cause_host == "lb" and row.root_cause_tags == ["timeout"]
    assert sorted(row.playbook_patterns) == ["oom_killer", "timeout"]
    assert row.network_evidence["ipv4"] == ["10.0.0.1"] and row.evidence_counts["ipv4"] == 1
    assert [(r.host, r.downtime) for r in row.recovery_timeline] == [("lb", "1m 15s"), ("db", "N/D")]


def test_raw_extract_prefers_the_raw_line(events):
    df = events([(0, "a", "ERROR", "x"), (1, "a", "CRITICAL", "y")]).withColumn("_raw", F.lit("r" * 600))
    rows = reports.top_raw_errors(df).orderBy("row_no").collect()
    assert [(r.event_id, len(r.extract)) for r in rows] == [(1, 500), (0, 500)]


def test_rule_table_is_every_pattern_tried(spark):
    import random
    import re

    from causeway.operators.rule_table import tag_by_rules

    rng = random.Random(2)
    words = ["Disk", "full", "node7", "ERROR", "x", "é", "timeout", "retry 12"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(200)] + [None, ""]
    rules = [(f"t{k}", rf"{a}.*{b}", a.lower()) for k, (a, b) in enumerate((a, b) for a in words for b in words)]
    rules += [("any", "^$", None), ("t0", "full$", "full"), ("none", "absent", "absent")]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, body string").withColumn("clash", F.lit("x"))
    got = {r.n: r.rule_tags for r in tag_by_rules(df, spark.createDataFrame(rules, "tag string, pattern string, literal string"), "body").collect()}
    for n, t in enumerate(texts):
        want = [] if t is None else list(dict.fromkeys(tag for tag, p, _ in sorted(rules) if re.search(p, t, re.I)))
        assert got[n] == want, t
    assert tag_by_rules(df, spark.createDataFrame([], "tag string, pattern string, literal string"), "body").first().rule_tags == []
