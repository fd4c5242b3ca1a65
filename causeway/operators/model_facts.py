"""What a language model is told of an incident: every fact one row, then all of them one JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway import schema as S
from causeway.functions.text import row_to_text
from causeway.functions.times import format_ts
from causeway.operators import correlate, enrich, evidence, impact, incident, reports, series
from causeway.operators.incident import beside
from causeway.operators.pseudonyms import pseudonymize
from causeway.plans.scaling import materialize, top_k
from causeway.rules import DEFAULT_RULES, RuleSet
from causeway.schema import Roles, resolve_roles

SECTIONS = ("cause", "timeline", "precursor", "evidence", "recurring", "burst")
SECTION_WIDTH = 1_000_000


def model_facts(df: DataFrame, roles: Roles | None = None, scope=(), rules: RuleSet = DEFAULT_RULES, max_events: int = 30,
                precursors: int = 10, shown: int = 30, recurring: int = 5, bursts: int = 5, burst_seconds: float = 30,
                sanitize: bool = True, row: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(scope, fact_no, section, kind, ts, tags, text) of each incident, in reading order.

    The numbers bound what a prompt can hold per scope (of evidence `shown` values per kind); they are cut
    before the shuffle and counts over all rows stand in the summary. With `sanitize` all texts of a scope are
    pseudonymised together, so that an address has one name in the timeline and among the evidence.
    `row` is the result of `incident` and `found` that of `network_evidence` where they have been computed.
    """
    roles, scope = roles or resolve_roles(df), list(scope)
    if row is None:
        row = incident.incident(df, roles, scope, rules=rules)
    columns = S.display_columns(df)
    nothing = F.lit(None).cast("string")

    def section(name: str, rows: DataFrame, number, kind, text, ts=nothing, tags=nothing) -> DataFrame:
        at = F.lit((SECTIONS.index(name) + 1) * SECTION_WIDTH) + F.col(number)
        return rows.select(*scope, at.cast("bigint").alias("fact_no"), F.lit(name).alias("section"), kind.cast("string").alias("kind"),
                           ts.alias("ts"), tags.alias("tags"), text.alias("text"))

    tagged = beside(row.select(*scope, "root_tags", "root_level"), impact.tag_sets(df, scope, rules), scope)
    causes = correlate.cause_list(tagged.where("root_level is not null"), scope, rules)
    events = reports.model_events(df, roles, scope, max_events, sanitize=False)
    before = top_k(incident.precursors(df, row, roles, scope), scope, enrich.time_order(roles), precursors, "_n")
    found = evidence.network_evidence(df, scope) if found is None else found
    values = top_k(found, [*scope, "kind"], [F.col("value").asc()], shown, "_k")
    # At most `shown` values of each kind reach this window.
    values = values.withColumn("_n", F.row_number().over(Window.partitionBy(*(scope or [F.lit(0)])).orderBy("kind", "value")))
    messages = impact.top_error_messages(df, roles, scope, recurring)
    busy = top_k(series.burst_windows(df, scope, burst_seconds), scope,
                 [F.col("events").desc(), F.col("burst_start").asc()], bursts, "_n")
    level, joined = F.col(S.LEVEL), F.array_join(S.TAGS, "|")
    parts = [
        section("cause", causes, "cause_no", F.col("kind"), F.col("label"), tags=F.col("tag")),
        section("timeline", events, "event_no", F.col("level"), F.col("raw"), F.col("ts"), F.array_join("tags", "|")),
        section("precursor", before, "_n", level, row_to_text(columns), format_ts(F.col(S.MICROS)), joined),
        section("evidence", values, "_n", F.col("kind"), F.col("value")),
        section("recurring", messages, "message_rank", F.col("occurrences"), F.col("message_pattern")),
        section("burst", busy, "_n", F.col("events"),
                F.concat(F.col("events").cast("string"), F.lit(" events, "), F.col("errors").cast("string"), F.lit(" errors")),
                format_ts(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', burst_start)"))),
    ]
    facts = reduce(DataFrame.unionByName, parts)
    if not sanitize:
        return facts
    # Bounded per scope; written because each kind of pseudonym reads it.
    return pseudonymize(materialize(facts, "model-facts"), "text", "fact_no", scope)[0]


def model_context(df: DataFrame, summary: DataFrame, roles: Roles | None = None, scope=(), rules: RuleSet = DEFAULT_RULES,
                  extracts: int = 5, sanitize: bool = True, row: DataFrame | None = None, **bounds) -> DataFrame:
    """(scope, context): the summary's facts, confidence, causes, evidence, bursts, precursors, recurring errors, gaps,
    recovery per host and a short excerpt of the timeline, as one JSON text per incident. No model is called.

    `bounds` are those of `model_facts`; `row` is the result of `incident` where it has been written.
    """
    roles, scope = roles or resolve_roles(df), list(scope)
    # One row per incident each, written because several parts read them.
    row = materialize(incident.incident(df, roles, scope, rules=rules), "incidents") if row is None else row
    summary = materialize(summary.drop("version", "analyzed_at", "source_file", "sha256", "report_path", "model_review"), "summaries")
    # The summary has searched all texts for evidence already and holds the values, each kind as one list.
    lists = summary.select(*scope, F.explode("network_evidence").alias("kind", "_values"))
    values = lists.select(*scope, "kind", F.explode("_values").alias("value"))
    facts = model_facts(df, roles, scope, rules, sanitize=sanitize, row=row, found=values, **bounds)
    fact = F.struct("fact_no", "section", "kind", "ts", "tags", "text")
    lists = facts.groupBy(*scope).agg(F.array_sort(F.collect_list(fact)).alias("_facts"))
    whole = beside(reports.flat_summary(summary, scope).drop("root_cause_tags", "playbook_patterns", "gap_count", "hosts_with_errors"),
                   summary.select(*scope, "root_cause_tags", "playbook_patterns", "evidence_counts", "log_gaps", "recovery_timeline"), scope)
    whole = beside(beside(whole, row.select(*scope, "confidence", "confidence_reason"), scope), lists, scope)
    known = F.coalesce("_facts", F.array().cast(lists.schema["_facts"].dataType))

    def of(name: str, shape):
        return F.transform(F.filter(known, lambda f: f["section"] == name), shape)

    event = lambda f: F.struct((f["fact_no"] % SECTION_WIDTH).alias("event_no"), f["ts"], f["kind"].alias("level"),
                               F.split(f["tags"], r"\|").alias("tags"), f["text"].alias("raw"))
    found = of("evidence", lambda f: F.struct(f["kind"].alias("kind"), f["text"].alias("text")))
    kinds = F.array_distinct(F.transform(found, lambda f: f["kind"]))
    by_kind = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.transform(F.filter(found, lambda f: f["kind"] == k), lambda f: f["text"])))
    whole = whole.withColumns({
        "causes": of("cause", lambda f: F.struct(f["kind"].alias("kind"), f["tags"].alias("tag"), f["text"].alias("label"))),
        "timeline_excerpt": of("timeline", event), "precursors": of("precursor", event), "network_evidence": by_kind,
        "top_recurring_errors": of("recurring", lambda f: F.struct(f["text"].alias("message"), f["kind"].cast("bigint").alias("occurrences"))),
        "bursts": of("burst", lambda f: F.struct(f["ts"].alias("start"), f["text"].alias("size"))),
    }).drop("_facts").withColumn("raw_error_extracts", F.slice(F.col("timeline_excerpt.raw"), 1, extracts))
    return whole.select(*scope, F.to_json(F.struct(*[F.col(c) for c in whole.columns if c not in scope])).alias("context"))
