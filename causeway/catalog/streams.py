"""Streams over the given tables, worked off completely, beside the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway import schema as S
from causeway.catalog.impacts import DUP_COLUMNS, WHOLE_DUP_COLUMNS
from causeway.catalog.logview import EN, LV, prepare, unzoned, view_of
from causeway.catalog.registry import query
from causeway.catalog.timing import LEV, cross_sql, leveled
from causeway.operators.enrich import enrich_levels, normalize_time
from causeway.plans.scaling import shared_dir
from causeway.streaming import streams


def stream(spark, sf_dir):
    prepare(spark)
    return view_of(streams.read_table_stream(spark, f"{sf_dir}/events.parquet"))


def run(df, name: str):
    spark = df.sparkSession
    return streams.run_to_table(df, shared_dir(spark, name), shared_dir(spark, f"{name}-checkpoint"))


@query("stream_enrichment", f"WITH {EN} SELECT event_id, lvl AS level, array_to_string(tags, '|') AS tags, is_anomaly FROM en")
def _(spark, sf_dir):
    rows = streams.enrich_stream(stream(spark, sf_dir))
    return run(rows.select("event_id", F.col(S.LEVEL).alias("level"), F.array_join(S.TAGS, "|").alias("tags"),
                           F.col(S.IS_ANOMALY).alias("is_anomaly")), "stream-enrichment")


# A bin is final when the watermark, ten minutes behind the newest event, has passed its end.
CLOSED = "(SELECT max(us) // 1000 * 1000 - 600000000 FROM lv)"


@query("stream_density", f"""WITH {LEV} SELECT host, make_timestamp(us // 3600000000 * 3600000000) AS bin_start,
    make_timestamp((us // 3600000000 + 1) * 3600000000) AS bin_end, count(*) AS events, count(*) FILTER (is_error) AS errors FROM lev
    WHERE (us // 3600000000 + 1) * 3600000000 <= {CLOSED} GROUP BY host, us // 3600000000""")
def _(spark, sf_dir):
    return run(streams.density_stream(enrich_levels(stream(spark, sf_dir)), ["host"], 3600), "stream-density")


@query("stream_burst_alerts", f"""WITH {LEV}, b AS (SELECT us // 3600000000 AS b, count(*) AS events, count(*) FILTER (is_error) AS errors FROM lev GROUP BY 1),
    f AS (SELECT sum(events)::DOUBLE AS n, sum(events * events)::DOUBLE AS sq, (max(b) - min(b) + 1)::DOUBLE AS bins FROM b)
    SELECT make_timestamp(b * 3600000000) AS bin_start, make_timestamp((b + 1) * 3600000000) AS bin_end, events, errors FROM b, f
    WHERE events > n / bins + 2 * sqrt((sq - n * n / bins) / (bins - 1)) AND (b + 1) * 3600000000 <= {CLOSED}""")
def _(spark, sf_dir):
    baseline = streams.burst_baseline(leveled(spark, sf_dir), (), 3600)
    density = streams.density_stream(enrich_levels(stream(spark, sf_dir)), (), 3600)
    return run(streams.burst_alerts(density, baseline), "stream-bursts")


@query("stream_recovery", f"""WITH {EN}, e AS (SELECT host, min(us) AS fe FROM en WHERE is_error GROUP BY host),
    r AS (SELECT host, fe, min(us) AS fr FROM en JOIN e USING (host) WHERE is_recovery AND us > fe GROUP BY host, fe)
    SELECT host, fe AS first_error_us, fr AS first_recovery_us, fr - fe AS mttr_us FROM r
    WHERE (fr // 1000000 + 1) * 1000000 <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM en WHERE is_error OR is_recovery)""")
def _(spark, sf_dir):
    seconds = streams.recovery_seconds(streams.enrich_stream(stream(spark, sf_dir)), "host")
    path = shared_dir(spark, "stream-seconds")
    streams.run_to_table(seconds, path, shared_dir(spark, "stream-seconds-checkpoint"))
    return run(streams.recovery_stream(spark.readStream.schema(seconds.schema).parquet(path)), "stream-recovery")


@query("stream_recovery_episodes", f"""WITH {EN}, e AS (SELECT DISTINCT host, us AS fe FROM en WHERE is_error),
    r AS (SELECT DISTINCT host, us AS fr FROM en WHERE is_recovery), n AS (SELECT e.host, fe, fr FROM e ASOF JOIN r ON e.host = r.host AND e.fe < r.fr)
    SELECT host, min(fe) AS first_error_us, fr AS first_recovery_us, fr - min(fe) AS mttr_us FROM n
    WHERE (fr // 1000000 + 1) * 1000000 <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM en WHERE is_error OR is_recovery) GROUP BY host, fr""")
def _(spark, sf_dir):
    seconds = streams.episode_seconds(streams.enrich_stream(stream(spark, sf_dir)), "host")
    path = shared_dir(spark, "stream-episodes")
    streams.run_to_table(seconds, path, shared_dir(spark, "stream-episodes-checkpoint"))
    return run(streams.episode_stream(spark.readStream.schema(seconds.schema).parquet(path)), "stream-recovery-episodes")


# From episode to episode: the next recovery within six hours, else none; then the first error behind either.
_SIX_HOURS = 21_600_000_000


@query("stream_recovery_timeout", f"""WITH RECURSIVE {EN}, e AS (SELECT DISTINCT host, us FROM en WHERE is_error), r AS (SELECT DISTINCT host, us FROM en WHERE is_recovery),
    w AS (SELECT max(us) // 1000000 * 1000000 AS seen, max(us) // 1000 * 1000 - 600000000 AS mark FROM en WHERE is_error OR is_recovery),
    f AS (SELECT DISTINCT host, us FROM e WHERE (us // 1000000 + 1) * 1000000 <= (SELECT mark FROM w)), g AS (SELECT * FROM r WHERE (us // 1000000 + 1) * 1000000 <= (SELECT mark FROM w)),
    t AS (SELECT host, us AS fe, (SELECT min(g.us) FROM g WHERE g.host = f.host AND g.us > f.us) AS nr FROM f),
    n AS (SELECT host, fe, CASE WHEN nr <= fe + {_SIX_HOURS} THEN nr END AS fr, CASE WHEN nr <= fe + {_SIX_HOURS} THEN nr ELSE fe + {_SIX_HOURS} + 1 END AS upto FROM t),
    x AS (SELECT n.*, (SELECT min(f.us) FROM f WHERE f.host = n.host AND f.us >= n.upto) AS next FROM n),
    c AS (SELECT * FROM x WHERE fe = (SELECT min(us) FROM f WHERE f.host = x.host) UNION ALL SELECT x.* FROM c JOIN x ON x.host = c.host AND x.fe = c.next),
    top AS (SELECT max(us // 1000000 * 1000000) AS s FROM (SELECT us FROM f UNION ALL SELECT us FROM g)), last AS (SELECT host, max(us) AS us FROM (SELECT * FROM f UNION ALL SELECT * FROM g) GROUP BY host)
    SELECT host, fe AS first_error_us, fr AS first_recovery_us, fr - fe AS mttr_us FROM c JOIN last USING (host), top
    WHERE fr IS NOT NULL OR last.us > fe + {_SIX_HOURS} OR (fe + {_SIX_HOURS}) // 1000 + 1 <= top.s // 1000""")
def _(spark, sf_dir):
    seconds = streams.episode_seconds(streams.enrich_stream(stream(spark, sf_dir)), "host")
    path = shared_dir(spark, "stream-timeouts")
    streams.run_to_table(seconds, path, shared_dir(spark, "stream-timeouts-checkpoint"))
    return run(streams.episode_stream(spark.readStream.schema(seconds.schema).parquet(path), 6 * 3600), "stream-recovery-timeouts")


@query("stream_deduplicate", f"WITH {LV} SELECT DISTINCT {', '.join(DUP_COLUMNS)} FROM lv")
def _(spark, sf_dir):
    rows = normalize_time(stream(spark, sf_dir))
    return run(streams.deduplicate_stream(rows, DUP_COLUMNS, "60 days").select(*DUP_COLUMNS), "stream-duplicates")


@query("stream_deduplicate_whole", f"WITH {LV} SELECT DISTINCT {', '.join(WHOLE_DUP_COLUMNS)} FROM lv")
def _(spark, sf_dir):
    """Equal rows have equal times, so ten minutes of delay suffice."""
    rows = normalize_time(stream(spark, sf_dir))
    return unzoned(run(streams.deduplicate_stream(rows, WHOLE_DUP_COLUMNS).select(*WHOLE_DUP_COLUMNS), "stream-duplicates-whole"))


# A day is closed when the newest error is ten minutes and the window behind its end.
@query("stream_cross_host", f"""SELECT * FROM ({cross_sql(300, 10, [], by_day=True)})
    WHERE day < (WITH {EN} SELECT strftime(make_timestamp(max(us) - 900000000), '%Y-%m-%d') FROM en WHERE is_error)""")
def _(spark, sf_dir):
    rows = enrich_levels(stream(spark, sf_dir))
    path = streams.cross_host_by_day(rows, shared_dir(spark, "stream-cross-host"), window_seconds=300)
    found = spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")
    return found.select(F.col("day").cast("string").alias("day"), "group_rank", "seed_event_id", "start",
                        F.array_join("hosts", "|").alias("hosts"), F.array_join("levels", "|").alias("levels"), "trigger")
