"""One row per incident: root cause, cascade, recovery, severity, confidence, service level, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway import rules as R
from causeway import schema as S
from causeway.functions.times import MINUTE, SECOND, floor_div, format_duration
from causeway.operators.enrich import with_tags
from causeway.plans.scaling import attach, with_scope
from causeway.rules import DEFAULT_RULES, RuleSet
from causeway.schema import Roles, resolve_roles


def beside(facts: DataFrame, more: DataFrame, scope) -> DataFrame:
    """Put two one-row-per-scope tables side by side."""
    scope = list(scope)
    if scope:
        return facts.join(more, scope, "left")
    names = more.columns
    both = attach(facts, more, (), "_more", how="left")
    return both.select(*facts.columns, *[F.col(f"_more.{c}").alias(c) for c in names])


def _root_pick(roles: Roles, extra: list[str]) -> Column:
    """The first error, else the first warning, else the first event, as one mergeable aggregate."""
    (event_id,) = roles.need("event_id")

    def role(column: str | None, name: str) -> str:
        return f"'{name}', " + (f"CAST(`{column}` AS STRING)" if column else "CAST(NULL AS STRING)")

    order = f"""struct(CASE WHEN {S.IS_ERROR} THEN 0 WHEN {S.IS_WARNING} THEN 1 ELSE 2 END,
        {S.MICROS} IS NULL, coalesce({S.MICROS}, 0), `{event_id}`)"""
    fields = [f"'event_id', `{event_id}`, 'micros', {S.MICROS}, 'level', {S.LEVEL}", role(roles.host, "host"),
              role(roles.message, "message"), f"'combined', {S.COMBINED}", *[role(c, f"x_{c}") for c in extra]]
    return F.expr(f"min_by(named_struct({', '.join(fields)}), {order})")


def root_cause(df: DataFrame, roles: Roles | None = None, scope=(), flow_key: str | None = None,
               rules: RuleSet = DEFAULT_RULES, high_severity=R.HIGH_SEVERITY_TAGS) -> DataFrame:
    """Root event and totals of each scope in one pass; tags are computed on the root rows only."""
    roles = roles or resolve_roles(df)
    extra = [flow_key] if flow_key else []
    high = " OR ".join(["false", *[f"`{S.FLAG_PREFIX}{t}`" for t in high_severity if t in rules.patterns]])
    df = with_scope(df, scope)
    facts = df.groupBy(*scope).agg(
        F.expr("count(1) AS total_events"),
        F.expr(f"count_if({S.IS_ERROR}) AS error_events"),
        F.expr(f"count_if({S.IS_WARNING}) AS warning_events"),
        F.expr(f"count_if({S.IS_ANOMALY}) AS anomaly_events"),
        F.expr(f"max({S.LEVEL} = 'CRITICAL') AS has_critical"),
        F.expr(f"max({high}) AS has_high_severity"),
        _root_pick(roles, extra).alias("root"),
    )
    facts = with_tags(facts.selectExpr("*", f"root.combined AS {S.COMBINED}"), rules)
    flow = f"coalesce(root.`x_{flow_key}`, 'N/A')" if flow_key else "'N/A'"
    return facts.selectExpr(
        *[f"`{c}`" for c in scope], "total_events", "error_events", "warning_events", "anomaly_events", "has_critical",
        "has_high_severity", "root.event_id AS root_event_id", "root.micros AS root_micros", "root.level AS root_level",
        "root.host AS root_host", "root.message AS root_message", f"{S.TAGS} AS root_tags", f"{flow} AS root_flow")


def _around_root(df: DataFrame, root: DataFrame, scope, roles: Roles, keep: list[str]) -> DataFrame:
    """Events with the instant of their scope's root event in column `t0`."""
    (event_id,) = roles.need("event_id")
    slim = with_scope(df, scope).select(*dict.fromkeys([*scope, *keep, event_id, S.MICROS]))
    facts = root.select(*scope, F.col("root_micros").alias("t0"), "total_events")
    return attach(slim, facts, scope, "root", F.col(event_id), "total_events").withColumn("t0", F.col("root.t0")).drop("root")


def precursors(df: DataFrame, root: DataFrame, roles: Roles | None = None, scope=(), minutes: float = 10) -> DataFrame:
    """Warnings and anomalies in the window that ends just before the root event."""
    roles = roles or resolve_roles(df)
    rows = _around_root(df.where(F.col(S.IS_ANOMALY) | F.col(S.IS_WARNING)), root, scope, roles, df.columns)
    width = round(minutes * MINUTE)
    return rows.where((F.col(S.MICROS) >= F.col("t0") - width) & (F.col(S.MICROS) < F.col("t0")))


def cascade(df: DataFrame, root: DataFrame, roles: Roles | None = None, scope=(), minutes: float = 5) -> DataFrame:
    """Errors after the root event, up to and including the end of the window."""
    roles = roles or resolve_roles(df)
    rows = _around_root(df.where(F.col(S.IS_ERROR)), root, scope, roles, df.columns)
    width = round(minutes * MINUTE)
    return rows.where((F.col(S.MICROS) > F.col("t0")) & (F.col(S.MICROS) <= F.col("t0") + width))


def mttr_all_errors(df: DataFrame, scope=()) -> DataFrame:
    """Time from every error to the next recovery after it: `errors, recovered, mean_mttr_us, longest_mttr_us` per scope.

    A forward as-of search that sees no scope as a whole. Equal times collapse first. Inside a minute, which
    holds a bounded number of different times, each time takes the next recovery; what a minute leaves open takes
    the first recovery of a later minute of its day, and then of a later day: one row per minute, and one
    per day, is carried backwards.
    """
    scope = list(scope)
    rows = with_scope(df, scope).where((F.col(S.IS_ERROR) | F.col(S.IS_RECOVERY)) & F.col(S.MICROS).isNotNull())
    at = F.col(S.MICROS)
    moments = rows.groupBy(*scope, S.MICROS).agg(F.count_if(S.IS_ERROR).alias("errors"), F.max(S.IS_RECOVERY).alias("_up"))
    moments = moments.withColumn("_minute", floor_div(at, MINUTE))

    def following(window, value):
        return F.min(value).over(window.rowsBetween(1, Window.unboundedFollowing))

    up = F.when(F.col("_up"), at)
    inside = moments.withColumn("_next", following(Window.partitionBy(*scope, "_minute").orderBy(S.MICROS), up))
    minutes = moments.groupBy(*scope, "_minute").agg(F.min(up).alias("_first")).withColumn("_day", floor_div(F.col("_minute"), 1440))
    of_scope = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    days = minutes.groupBy(*scope, "_day").agg(F.min("_first").alias("_first"))
    later = days.select(*scope, "_day", following(of_scope.orderBy("_day"), F.col("_first")).alias("_later"))
    carried = minutes.withColumn("_then", following(Window.partitionBy(*scope, "_day").orderBy("_minute"), F.col("_first")))
    carried = carried.join(later, [*scope, "_day"]).select(*scope, "_minute", F.coalesce("_then", "_later").alias("_then"))
    joined = inside.where("errors > 0").join(carried, [*scope, "_minute"])
    wait = F.coalesce("_next", "_then") - at
    found = joined.groupBy(*scope).agg(
        F.sum("errors").alias("errors"), F.coalesce(F.sum(F.when(wait.isNotNull(), F.col("errors"))), F.lit(0)).alias("recovered"),
        F.sum(wait.cast("decimal(38,0)") * F.col("errors")).alias("_sum"), F.max(wait).alias("longest_mttr_us"))
    found = found.where("errors is not null")
    return found.select(*scope, "errors", "recovered", (F.col("_sum").cast("double") / F.col("recovered")).alias("mean_mttr_us"), "longest_mttr_us")


def aftermath(df: DataFrame, root: DataFrame, roles: Roles | None = None, scope=(),
              cascade_minutes: float = 5, precursor_minutes: float = 10) -> DataFrame:
    """Cascade size, precursor count and time to recovery of each scope, in one pass."""
    roles = roles or resolve_roles(df)
    flags = [S.IS_ERROR, S.IS_WARNING, S.IS_ANOMALY, S.IS_RECOVERY]
    relevant = df.where(F.col(S.IS_ERROR) | F.col(S.IS_WARNING) | F.col(S.IS_ANOMALY) | F.col(S.IS_RECOVERY))
    rows = _around_root(relevant, root, scope, roles, flags)
    at, t0 = F.col(S.MICROS), F.col("t0")
    later, before = round(cascade_minutes * MINUTE), round(precursor_minutes * MINUTE)
    found = rows.groupBy(*scope).agg(
        F.count_if(F.col(S.IS_ERROR) & (at > t0) & (at <= t0 + later)).alias("cascade_count"),
        F.count_if((F.col(S.IS_ANOMALY) | F.col(S.IS_WARNING)) & (at >= t0 - before) & (at < t0))
        .alias("precursor_count"),
        F.min(F.when(F.col(S.IS_RECOVERY) & (at > t0), at - t0)).alias("mttr_us"),
    )
    return found


def mttr(df: DataFrame, root: DataFrame, roles: Roles | None = None, scope=()) -> DataFrame:
    """Time from the root event to the first recovery after it; null where there is none."""
    found = aftermath(df, root, roles, scope).select(*scope, "mttr_us")
    return beside(root.select(*scope, "root_micros"), found, scope)


_HIGH = ("critical_with_tags", "error_deep_cascade", "error_tags_and_cascade")


def _case(subject: str, pairs: dict) -> str:
    return "CASE " + subject + " ".join(f" WHEN {k} THEN {v}" for k, v in pairs.items())


def with_severity(df: DataFrame) -> DataFrame:
    """Score of four parts of at most 25 points, cut to a whole number, and its grade.

    The parts shown are rounded half up to tenths, in whole-number arithmetic. An incident without events, as an
    empty table without scope columns is, has score 0, grade `N/A` and no parts.
    """
    hour = 3600 * SECOND
    df = df.selectExpr("*", """least(IF(has_critical, 15, 0) + IF(has_high_severity, 10, 0), 25) AS _weight""")
    df = df.selectExpr("*", f"""IF(total_events = 0, 0, greatest(0, least(100, CAST(floor(
        least(try_divide(error_events, total_events), 1.0D) * 25
        + least(cascade_count / greatest(total_events * 0.5D, 1.0D), 1.0D) * 25
        + IF(mttr_us IS NULL, 15.0D, least(mttr_us / {SECOND} / 3600, 1.0D) * 25) + _weight) AS INT)))) AS severity_score""")
    grades = _case("", {f"severity_score >= {floor}": f"'{grade}'" for grade, floor in R.GRADE_FLOORS.items()})
    parts = {
        "part_error_ratio": "(500 * error_events + total_events) DIV (2 * greatest(total_events, 1)) / 10",
        "part_cascade_depth": """least(IF(total_events >= 2, (1000 * cascade_count + total_events) DIV (2 * greatest(total_events, 1)),
            250 * cascade_count), 250) / 10""",
        "part_mttr": f"IF(mttr_us IS NULL, 150, least((500 * mttr_us + {hour}) DIV {2 * hour}, 250)) / 10",
        "part_pattern_weight": "_weight"}
    shown = [f"IF(total_events > 0, CAST({sql} AS DOUBLE), NULL) AS {name}" for name, sql in parts.items()]
    return df.selectExpr("* EXCEPT (_weight)", *shown, f"IF(total_events = 0, 'N/A', {grades} ELSE 'P5' END) AS severity_grade")


def with_confidence(df: DataFrame) -> DataFrame:
    """How far the root event can be trusted, with the branch that decided it."""
    df = df.selectExpr("*", """CASE
        WHEN root_level IN ('CRITICAL', 'FATAL', 'EMERG', 'ALERT') AND size(root_tags) >= 1 THEN 'critical_with_tags'
        WHEN root_level = 'ERROR' AND cascade_count >= 5 THEN 'error_deep_cascade'
        WHEN root_level = 'ERROR' AND size(root_tags) >= 2 AND cascade_count >= 3 THEN 'error_tags_and_cascade'
        WHEN root_level IN ('CRITICAL', 'FATAL') AND size(root_tags) = 0 THEN 'critical_without_tags'
        WHEN root_level = 'ERROR' AND size(root_tags) >= 1 THEN 'error_with_tags'
        WHEN root_level = 'ERROR' THEN 'error_without_tags'
        ELSE 'other_level' END AS confidence_reason""")
    return df.selectExpr("*", f"""CASE WHEN confidence_reason IN {_HIGH} THEN 'HIGH'
        WHEN confidence_reason = 'other_level' THEN 'LOW' ELSE 'MEDIUM' END AS confidence""")


def with_sla(df: DataFrame) -> DataFrame:
    """Was the time to recovery longer than the grade allows? Null for P5 or without recovery."""
    allowed = _case("severity_grade", {f"'{g}'": s for g, s in R.SLA_SECONDS.items()})
    return df.selectExpr("*", f"{allowed} END AS sla_seconds").selectExpr(
        "*", f"mttr_us > CAST(sla_seconds AS BIGINT) * {SECOND} AS sla_breach")


def incident(df: DataFrame, roles: Roles | None = None, scope=(), flow_key: str | None = None,
             rules: RuleSet = DEFAULT_RULES, cascade_minutes: float = 5, precursor_minutes: float = 10) -> DataFrame:
    """Root cause, cascade, recovery, severity, confidence and service level of each scope.

    Two passes over the enriched events, each a partial aggregation by scope. Materialise the
    enriched table first when several operators are to be run on it.
    """
    roles = roles or resolve_roles(df)
    root = root_cause(df, roles, scope, flow_key, rules)
    found = aftermath(df, root, roles, scope, cascade_minutes, precursor_minutes)
    row = beside(root, found, scope).withColumns({
        "cascade_count": F.coalesce("cascade_count", F.lit(0)),
        "precursor_count": F.coalesce("precursor_count", F.lit(0)),
    })
    return with_sla(with_confidence(with_severity(row))).withColumn("mttr_text", format_duration(F.col("mttr_us")))


def trend(df: DataFrame, scope=()) -> DataFrame:
    """Error rate before and from the middle of the time span, and where it is heading."""
    df = with_scope(df, scope).where(F.col(S.MICROS).isNotNull())
    span = df.groupBy(*scope).agg(F.min(S.MICROS).alias("first"), F.max(S.MICROS).alias("last"),
                                  F.count(F.lit(1)).alias("n"))
    rows = attach(df.select(*scope, S.MICROS, S.IS_ERROR), span, scope, "span", F.col(S.MICROS), "n")
    # Twice the time against first + last, so that the middle needs no fraction.
    early = F.col(S.MICROS) * 2 < F.col("span.first") + F.col("span.last")
    halves = rows.groupBy(*scope).agg(
        F.count_if(early).alias("first_events"), F.count_if(early & F.col(S.IS_ERROR)).alias("first_errors"),
        F.count_if(~early).alias("second_events"), F.count_if(~early & F.col(S.IS_ERROR)).alias("second_errors"))
    r1 = F.col("first_errors") / F.nullif(F.col("first_events"), F.lit(0))
    r2 = F.col("second_errors") / F.nullif(F.col("second_events"), F.lit(0))
    enough = (F.col("first_events") + F.col("second_events") >= 4) & r1.isNotNull() & r2.isNotNull()
    label = (F.when(~enough, "N/D").when(r2 > r1 * 1.25, "ESCALATING").when(r2 < r1 * 0.75, "RECOVERING")
             .otherwise("STABLE"))

    def percent(r: Column) -> Column:
        return F.when(enough, F.floor(r * 100 + 0.5).cast("int"))

    return halves.withColumns({"trend": label, "first_error_pct": percent(r1), "second_error_pct": percent(r2)})
