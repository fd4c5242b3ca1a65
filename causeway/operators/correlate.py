"""Failures that spread across hosts, drill-downs around the root event, the critical flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway import rules as R
from causeway import schema as S
from causeway.functions import levels
from causeway.functions.text import clip
from causeway.functions.times import MINUTE, as_time, floor_div, format_ts, micros
from causeway.plans.scaling import HEAVY_KEYS, attach, salted_join, top_k, with_scope, within_keys, within_range
from causeway.rules import DEFAULT_RULES, RuleSet
from causeway.schema import Roles, resolve_roles


def _first_two(firsts: DataFrame, keys, host: str, order, prefix: str) -> DataFrame:
    """Per key the leading event and the leading event of any other host."""
    ranked = top_k(firsts, keys, order, 2, "_r")
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col(host))).alias(f"{prefix}_host"),
        F.max(F.when(F.col("_r") == 1, F.struct("us", "id"))).alias(f"{prefix}_1"),
        F.max(F.when(F.col("_r") == 2, F.struct("us", "id"))).alias(f"{prefix}_2"))


def cross_host_cascade(df: DataFrame, roles: Roles | None = None, scope=(), window_seconds: float = 2.0,
                       limit: int = 10, by_day: bool = False) -> DataFrame:
    """Errors followed by errors on other hosts within the window; the first `limit` per scope.

    With `by_day` it is the first `limit` of every UTC day, in column `day`; the day is that of the seed,
    its followers may fall on the next one.

    One row per (scope, millisecond): the lowest event that has followers. Whether an event has any
    is decided without pairing events: of each bucket as wide as the window, the last and the first
    errors of the two leading hosts tell whether another host follows in the same bucket or in the
    next one. Followers are looked up for the chosen seeds only, and per host and level, not per
    event.
    """
    roles = roles or resolve_roles(df)
    event_id, host = roles.need("event_id", "cross_host")
    width = micros(window_seconds)
    scope = list(scope)
    at = [*scope, "bucket"]
    errors = with_scope(df, scope).where(F.col(S.IS_ERROR) & F.col(S.MICROS).isNotNull()).select(
        *[F.col(c) for c in scope], F.col(host).cast("string").alias("error_host"), F.col(S.LEVEL).alias("error_level"),
        F.col(S.MICROS).alias("us"), F.col(event_id).alias("id"),
        floor_div(F.col(S.MICROS), width).alias("bucket"))
    # Copies of one instant on one host collapse: as a seed or follower only the lowest id matters.
    moments = errors.groupBy(*at, "error_host", "error_level", "us").agg(F.min("id").alias("id"), F.max("id").alias("last_id"))
    place = F.struct("us", "id")
    per_host = moments.groupBy(*at, "error_host").agg(
        F.min(place).alias("first"), F.max(F.struct("us", F.col("last_id").alias("id"))).alias("last"))
    lasts = _first_two(per_host.select(*at, "error_host", "last.*"), at, "error_host",
                       [F.col("us").desc(), F.col("id").desc()], "last")
    firsts = _first_two(per_host.select(*at, "error_host", "first.*"), at, "error_host",
                        [F.col("us").asc(), F.col("id").asc()], "next")
    firsts = firsts.withColumn("bucket", F.col("bucket") - 1)
    near = lasts.join(firsts, at, "left")
    # A bucket holds no more moments than hosts, levels and microseconds allow, so the join is an
    # ordinary one.
    rows = moments.join(near, at)

    def other(prefix: str):
        return F.when(F.col(f"{prefix}_host") == F.col("error_host"), F.col(f"{prefix}_2")).otherwise(F.col(f"{prefix}_1"))

    follows = F.coalesce(other("last") > place, F.lit(False)) | F.coalesce(
        other("next").getField("us") <= F.col("us") + width, F.lit(False))
    seeds = rows.where(follows).groupBy(*scope, floor_div(F.col("us"), 1000).alias("_ms")).agg(
        F.min(F.struct("us", "id", "error_host", "error_level", "bucket")).alias("seed"))
    ranked = scope
    if by_day:
        seeds, ranked = seeds.withColumn("day", F.date_format(F.timestamp_millis("_ms"), "yyyy-MM-dd")), [*scope, "day"]
    seeds = top_k(seeds, ranked, [F.col("_ms").asc()], limit, "group_rank")
    seeds = seeds.withColumn("bucket", F.explode(F.array("seed.bucket", F.col("seed.bucket") + 1)))
    pairs = salted_join(moments, seeds, at, F.col("id")).where(
        (F.col("us") <= F.col("seed.us") + width) & (F.col("error_host") != F.col("seed.error_host"))
        & (place > F.struct("seed.us", "seed.id")))
    found = pairs.groupBy(*ranked, "group_rank", "seed", "error_host", "error_level").agg(F.min(place).alias("at"))
    groups = found.groupBy(*ranked, "group_rank", "seed").agg(
        F.array_sort(F.collect_list(F.struct("at", "error_host", "error_level"))).alias("m"))
    hosts = F.array_distinct(F.concat(F.array("seed.error_host"), F.col("m.error_host")))
    names = F.array_distinct(F.concat(F.array("seed.error_level"), F.col("m.error_level")))
    out = groups.select(*ranked, "group_rank", F.col("seed.id").alias("seed_event_id"), format_ts(F.col("seed.us")).alias("start"),
                        as_time(F.col("seed.us")).alias("seed_ts"), hosts.alias("hosts"), names.alias("levels"))
    if roles.message is None:
        return out.withColumn("trigger", F.lit(""))
    texts = df.where(F.col(S.IS_ERROR)).select(
        F.col(event_id).alias("seed_event_id"), clip(F.coalesce(F.col(roles.message), F.lit("")), 80).alias("trigger"))
    # Without scope columns and days there are at most `limit` seeds.
    return texts.join(F.broadcast(out) if not ranked and limit <= HEAVY_KEYS else out, "seed_event_id")


def first_sources(df: DataFrame, roles: Roles, scope=(), k: int = 3) -> DataFrame:
    """The first k sources by first appearance, as one short array per scope."""
    source, event_id = roles.need("source", "event_id")
    seen = with_scope(df, [*scope, source]).groupBy(*scope, F.col(source).alias("_s")).agg(
        F.min(F.struct(F.col(S.MICROS).isNull(), F.coalesce(S.MICROS, F.lit(0)), F.col(event_id))).alias("_at"))
    first = top_k(seen, scope, [F.col("_at").asc()], k, "_r")
    return first.groupBy(*scope).agg(F.collect_set("_s").alias("sources"))


def _near_root(df, root, roles, scope, minutes, extra=()):
    """Events within ± minutes of their scope's root event, both ends included.

    What lies outside goes before any shuffle: all root events' span is a filter of the scan, on the day of a
    written table too, and the ranges of the scopes' hash buckets follow.
    """
    (event_id,) = roles.need("event_id")
    width = round(minutes * MINUTE)
    at, low, high = F.col(S.MICROS), F.col("root_micros") - width, F.col("root_micros") + width
    first, last = root.select(F.min(low)).scalar(), root.select(F.max(high)).scalar()
    near = with_scope(df, scope).where((at >= first) & (at <= last))
    if "event_date" in df.columns:
        day = lambda us: F.to_date(F.timestamp_micros(us))
        near = near.where((F.col("event_date") >= day(first)) & (F.col("event_date") <= day(last)))
    facts = root.select(*scope, "root_micros", "root_host", "root_flow", "root_tags", "total_events", *extra)
    near = within_range(near, root.select(*scope, "root_micros"), scope, at, low, high) if scope else near
    rows = attach(near, facts, scope, "r", F.col(event_id), "total_events")
    return rows.where(F.col(S.MICROS).between(F.col("r.root_micros") - width, F.col("r.root_micros") + width))


def _with_sources(root, df, roles, scope):
    if roles.source is None:
        return root.withColumn("sources", F.lit(None).cast("array<string>"))
    sources = first_sources(df, roles, scope)
    if scope:
        return root.join(sources, list(scope), "left")
    return attach(root, sources, (), "_s", how="left").withColumn("sources", F.col("_s.sources")).drop("_s")


def _from_sources(rows, roles):
    if roles.source is None:
        return rows
    return rows.where(F.col("r.sources").isNull() | F.array_contains("r.sources", F.col(roles.source)))


def drilldown_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", levels.severity_rank(F.col(S.LEVEL), R.DRILLDOWN_SEVERITY, 1))


def incident_window(df: DataFrame, root: DataFrame, roles: Roles | None = None, scope=(), flow_key: str | None = None,
                    minutes: float = 10) -> DataFrame:
    """Warnings and worse around the root event, of its flow and of the first three sources."""
    roles = roles or resolve_roles(df)
    rows = _from_sources(_near_root(df, _with_sources(root, df, roles, scope), roles, scope, minutes, ["sources"]), roles)
    if flow_key is not None:
        rows = rows.where((F.col("r.root_flow") == "N/A") | (F.col(flow_key).cast("string") == F.col("r.root_flow")))
    return drilldown_severity(rows.drop("r")).where(F.col("severity") >= 3)


def root_host_drilldown(df: DataFrame, root: DataFrame, roles: Roles | None = None, scope=(), minutes: float = 5) -> DataFrame:
    """Everything on the root host close to the root event."""
    roles = roles or resolve_roles(df)
    (host,) = roles.need("host")
    rows = _near_root(df, root, roles, scope, minutes)
    return drilldown_severity(rows.where(F.col(host).cast("string") == F.col("r.root_host")).drop("r"))


def pattern_drilldown(df: DataFrame, root: DataFrame, roles: Roles | None = None, scope=(), minutes: float = 10) -> DataFrame:
    """Messages around the root event that look like its first tag."""
    roles = roles or resolve_roles(df)
    (message,) = roles.need("message")
    rows = _from_sources(_near_root(df, _with_sources(root, df, roles, scope), roles, scope, minutes, ["sources"]), roles)
    tag = F.try_element_at("r.root_tags", F.lit(1))
    hit = F
    for name, pattern in R.DRILLDOWN_PATTERNS.items():
        hit = hit.when(tag == name, F.col(message).rlike("(?i)" + pattern))
    hit = hit.otherwise(F.col(message).rlike("(?i)" + R.DRILLDOWN_DEFAULT))
    return rows.withColumn("_hit", hit).where("_hit").drop("r", "_hit")


def isolate_flow(df: DataFrame, flow_key: str, value: str | None = None, scope=()) -> DataFrame:
    """The events of one flow per scope: the given one, else the one with the most errors, else with
    the most anomalies, else everything. Ties go to the smallest key."""
    if flow_key not in df.columns:
        raise S.MissingRole(f"no such flow column: {flow_key}")
    key, spread = F.col(f"`{flow_key}`"), resolve_roles(df).event_id or S.MICROS
    if value is not None:
        return df.where(key.cast("string") == str(value))
    known = with_scope(df, scope)
    counts = known.groupBy(*scope, key.alias("_key")).agg(
        F.count_if(F.col(S.IS_ERROR) & key.isNotNull()).alias("e"), F.count_if(F.col(S.IS_ANOMALY) & key.isNotNull()).alias("a"),
        F.count(F.lit(1)).alias("n"))
    winner = counts.groupBy(*scope).agg(
        F.max("e").alias("e"), F.max("a").alias("a"), F.sum("n").alias("n"),
        F.min_by("_key", F.struct(-F.col("e"), "_key")).alias("by_errors"),
        F.min_by("_key", F.struct(-F.col("a"), "_key")).alias("by_anomalies"))
    chosen = F.when(F.col("e") > 0, F.col("by_errors")).when(F.col("a") > 0, F.col("by_anomalies"))
    facts = winner.select(*scope, chosen.alias("key"), "n")
    near = within_keys(known, facts, scope, key, F.col("key")) if scope else known  # other flows' rows go before any shuffle
    rows = attach(near, facts, scope, "w", F.col(spread), "n", "left")
    return rows.where(F.col("w.key").isNull() | (key == F.col("w.key"))).drop("w")


def flow_detail(df: DataFrame, flow_key: str, value: str | None = None, roles: Roles | None = None, scope=(),
                n: int = 25) -> DataFrame:
    """The first events of the isolated flow."""
    from causeway.operators.enrich import first_n_events

    return first_n_events(isolate_flow(df, flow_key, value, scope), n, roles or resolve_roles(df), scope)


def _array_table(pairs: dict[str, tuple[str, ...]]):
    return F.create_map(*[x for t, steps in pairs.items() for x in (F.lit(t), F.array(*[F.lit(s) for s in steps]))])


def response_playbook(tagged: DataFrame, tags: str = "error_only_tags", scope=(), rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Ordered steps for the detected tags; the steps are a literal map, so nothing is joined."""
    known = {t: s for t, s in rules.steps.items() if s}
    rows = tagged.select(*scope, F.posexplode(tags).alias("tag_no", "tag"))
    steps = F.try_element_at(_array_table(known), F.col("tag"))
    return rows.select(*scope, (F.col("tag_no") + 1).alias("tag_no"), "tag", F.posexplode(steps).alias("_i", "step")) \
        .select(*scope, "tag_no", "tag", (F.col("_i") + 1).alias("step_no"), "step")


def cause_list(tagged: DataFrame, scope=(), rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Labels of the root's tags, then of the other tags of errors; one default row if there are none.

    `tagged` holds `root_tags`, `error_only_tags` and `root_level` per scope.
    """
    labels = F.create_map(*[F.lit(x) for pair in rules.labels.items() for x in pair])
    known = F.array(*[F.lit(t) for t in rules.labels])

    def labelled(tags, kind: str):
        return F.transform(F.filter(tags, lambda t: F.array_contains(known, t)),
                           lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("tag"), F.element_at(labels, t).alias("label")))

    causes = F.concat(labelled(F.col("root_tags"), "root"),
                      labelled(F.sort_array(F.array_except("error_only_tags", "root_tags")), "correlated"))
    default = F.array(F.struct(F.lit("default").alias("kind"), F.lit(None).cast("string").alias("tag"),
                               F.concat(F.lit("Error event at level "), F.col("root_level")).alias("label")))
    rows = tagged.select(*scope, F.posexplode(F.when(F.size(causes) > 0, causes).otherwise(default)).alias("_i", "c"))
    return rows.select(*scope, (F.col("_i") + 1).alias("cause_no"), "c.kind", "c.tag", "c.label")
