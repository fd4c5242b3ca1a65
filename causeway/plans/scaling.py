"""How operators meet large and skewed data.

Every operator works per scope, a list of grouping columns, and one scope may hold a large part of
all rows. So no operator sorts a whole scope in one task: facts about a scope are aggregated (with
partial aggregation before the shuffle) and brought back to the events by `attach`, which treats the
heaviest scopes apart; first-k lists are cut before the shuffle by `top_k`, running numbers are built
from block sums by `running_total`, and exact quantiles come from a histogram that narrows the value
range first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions.times import floor_div

SALTS = 32
HEAVY_KEYS = 1000  # rows of the one table that is broadcast by name
RANGE_BUCKETS = 1 << 18  # rows of the table of ranges that is broadcast
GROUP_LIMIT = 1000  # Spark cuts row_number() <= k before the shuffle up to this k


def with_scope(df: DataFrame, scope) -> DataFrame:
    """Rows whose scope columns are all filled; a null key belongs to no scope."""
    for c in scope:
        df = df.where(F.col(c).isNotNull())
    return df


def salted_join(rows: DataFrame, small: DataFrame, keys, spread: Column, how: str = "inner") -> DataFrame:
    """Equi-join of many rows with a table of few rows per key, safe against hot keys.

    The rows of one key are spread over `SALTS` tasks by a hash of `spread`; the small table is
    repeated once per salt. No broadcast is asked for; adaptive execution makes one where the table
    proves small.
    """
    salt = "_salt"
    repeated = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(repeated, [*keys, salt], how).drop(salt)


def attach(rows: DataFrame, facts: DataFrame, scope, name: str, spread: Column | None = None,
           weight: str | None = None, how: str = "inner") -> DataFrame:
    """Add to every row the facts of its scope (one row per scope) as a struct column called `name`.

    Without scope columns the facts are one row and come in as a scalar subquery, which Spark holds
    to one row. Otherwise `weight`, the number of rows of each scope, tells the `HEAVY_KEYS` heaviest
    scopes, whose facts are broadcast: a table of fixed size. Any other scope then holds less than a
    thousandth of the rows, so the remaining rows meet their facts in an ordinary join; rows that are
    already served are dealt out evenly by `spread`. Without a weight the join is an ordinary one, for
    rows of which every scope has a bounded number.
    """
    scope = list(scope)
    packed = F.struct(*[F.col(f"`{c}`") for c in facts.columns if c not in scope])
    if not scope:
        out = rows.withColumn(name, facts.select(packed).scalar())
        return out.where(F.col(name).isNotNull()) if how == "inner" else out
    keyed = facts.select(*scope, packed.alias(name))
    if weight is None:
        return rows.join(keyed, scope, how)
    heavy = facts.orderBy(F.col(weight).desc()).limit(HEAVY_KEYS).select(*scope, packed.alias("_heavy"))
    served = rows.join(F.broadcast(heavy), scope, "left")
    deal = F.when(F.col("_heavy").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(4096)) + 1).cast("int")
    both = served.withColumn("_deal", deal).join(keyed.withColumn("_deal", F.lit(0)), [*scope, "_deal"], "left")
    out = both.withColumn(name, F.coalesce("_heavy", name)).drop("_heavy", "_deal")
    return out.where(F.col(name).isNotNull()) if how == "inner" else out


def _bucket(scope) -> Column:
    """The hash bucket of a scope; tables of one row per bucket have a fixed size."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in scope]), F.lit(RANGE_BUCKETS)).cast("int") if scope else F.lit(0)


def within_keys(rows: DataFrame, facts: DataFrame, scope, value: Column, wanted: Column) -> DataFrame:
    """Rows whose `value` may be the `wanted` one of their scope, before anything is shuffled; a null lets all through.

    A hash bucket of scopes keeps one bit for each of 63 classes of wanted values; as in `within_range` this
    table is broadcast. `facts` must have a row for every scope.
    """
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(63)).cast("int"))
    masks = facts.groupBy(_bucket(scope).alias("_bucket")).agg(
        F.bit_or(F.when(wanted.isNull(), F.lit(-1).cast("long")).otherwise(bit(wanted))).alias("_mask"))
    near = rows.withColumn("_bucket", _bucket(scope)).join(F.broadcast(masks), "_bucket")
    return near.where((F.col("_mask") == -1) | (F.col("_mask").bitwiseAND(bit(value)) != 0)).drop("_bucket", "_mask")


def within_range(rows: DataFrame, facts: DataFrame, scope, value: Column, low: Column, high: Column) -> DataFrame:
    """Rows whose `value` may lie between `low` and `high` of their scope, before anything is shuffled.

    Scopes fall into hash buckets; a bucket keeps the least `low` and the greatest `high` of its scopes. This
    table of at most `RANGE_BUCKETS` rows of four numbers is broadcast, so all rows are told apart where they are
    read. Rows let through may still lie outside the range of their own scope, never the other way round.
    """
    ranges = facts.groupBy(_bucket(scope).alias("_bucket")).agg(F.min(low).alias("_low"), F.max(high).alias("_high"))
    near = rows.withColumn("_bucket", _bucket(scope)).join(F.broadcast(ranges), "_bucket").where(value.between(F.col("_low"), F.col("_high")))
    return near.drop("_bucket", "_low", "_high")


def top_k(df: DataFrame, scope, order: list[Column], k: int, rank: str) -> DataFrame:
    """The first k rows of each scope in a total order, numbered from 1 in column `rank`."""
    scope = list(scope)
    if not scope:
        # At most k rows reach the window.
        return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    if k > GROUP_LIMIT:
        part = "_part"
        df = df.withColumn(part, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]), F.lit(SALTS)))
        local = Window.partitionBy(*scope, part).orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(local)).where(F.col(rank) <= k).drop(rank, part)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def running_total(df: DataFrame, group, block: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Running sum of `value` per group in (block, order) order, without one task per group.

    Each (group, block) is summed on its own; the sums of the earlier blocks, one row per block, are
    added to the running sum inside the block. Blocks must be bounded, groups need not be.
    """
    group = list(group)
    sums = df.groupBy(*group, block).agg(F.sum(value).alias("_in_block"))
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, block, F.coalesce(F.sum("_in_block").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn(name, F.sum(value).over(inside)).join(starts, [*group, block])
    return out.withColumn(name, F.col(name) + F.col("_start")).drop("_start")


def _histogram_bin(v: Column) -> Column:
    """Bins of non-negative whole numbers whose width is at most 1/1024 of their values."""
    shift = F.greatest(F.length(F.bin(v)) - 11, F.lit(0))
    return shift * 4096 + F.call_function("shiftright", v, shift)


def exact_quantile(counts: DataFrame, scope, value: str, weight: str, quarters: int, name: str) -> DataFrame:
    """Linear-interpolated quantile (in quarters) of a weighted multiset of non-negative bigints.

    `counts` has one row per (scope, value) with its frequency. A histogram of fixed relative width
    finds the bins that hold the two neighbouring ranks; only rows of those bins are ranked exactly.
    Gives (scope, name, `n`, `mean`): the quantile, the size of the multiset and its mean.
    """
    scope = list(scope)
    binned = counts.withColumn("_bin", _histogram_bin(F.col(value)))
    per_bin = binned.groupBy(*scope, "_bin").agg(
        F.sum(weight).alias("_w"), F.sum(F.col(value).cast("decimal(38,0)") * F.col(weight)).alias("_vw"))
    upto = Window.partitionBy(*scope).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*scope)
    ranked = per_bin.select(*scope, "_bin", F.col("_w"), F.sum("_w").over(upto).alias("_end"),
                            F.sum("_w").over(whole).alias("_n"), F.sum("_vw").over(whole).alias("_all"))
    low = floor_div((F.col("_n") - 1) * quarters, 4)
    ranked = (ranked.withColumn("_low", low).withColumn("_part", ((F.col("_n") - 1) * quarters) % 4)
              .withColumn("_start", F.col("_end") - F.col("_w")))
    wanted = ranked.where((F.col("_start") <= F.col("_low") + 1) & (F.col("_end") > F.col("_low"))).drop("_w", "_end")
    inside = (Window.partitionBy(*scope, "_bin").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, 0))
    rows = binned.join(wanted, [*scope, "_bin"]) \
        .withColumn("_to", F.col("_start") + F.sum(weight).over(inside)) \
        .withColumn("_from", F.col("_to") - F.col(weight))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col(value)))

    picked = rows.groupBy(*scope).agg(
        at(F.col("_low")).alias("_lo"), at(F.col("_low") + 1).alias("_hi"),
        F.max("_part").alias("_p"), F.max("_n").alias("n"), F.max("_all").alias("_all"))
    hi = F.coalesce(F.col("_hi"), F.col("_lo"))
    exact = (F.col("_lo") * (4 - F.col("_p")) + hi * F.col("_p")) / 4
    return picked.where(F.col("n").isNotNull()).select(
        *scope, exact.cast("double").alias(name), "n", (F.col("_all").cast("double") / F.col("n")).alias("mean"))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir.

    Where none is named, as in tests, the warehouse folder takes its place if the master itself is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str = "table", partition_by=()) -> DataFrame:
    """Write a table that is read more than once to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
