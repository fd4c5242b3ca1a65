"""Document fingerprints by consistent weighted sampling, in DataFrame expressions alone.

The terms of a text are its words, weighted by how often they occur. For each of `SAMPLES` samples a
term's hash gives, the same in every document, two Gamma(2, 1) numbers r and c and a uniform b. With weight w,
`t = floor(ln w / r + b)` and `ln a = ln c - r (t - b + 1)`; the sample is the pair (term, t) of the smallest a. Two
texts have equal samples with the probability of their generalised Jaccard similarity, the sum of the
smaller weights over the sum of the larger ones. A fingerprint lists 32 hash bits per sample.

The smallest a is found by aggregation: each pair (term, sample) becomes one whole number, ln a in the
upper bits and the hash of (term, t) in the lower, and `min` keeps one number per sample. The rows of a
document meet on the partitioning that brought its text there, so terms are not shuffled.

An empty or null text has the fingerprint "" and is like another empty text (1), like any other not (0).
Rows without an id sort below all others. Rows that repeat both id and text count once; rows that
repeat an id alone are ordered by a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import keep

SAMPLES = 24
LEAST_ID = -(1 << 63)

def _uniform(bits: str) -> str:
    return f"((({bits}) + 0.5D) / 4294967296D)"

def with_terms(rows: DataFrame, first: str, second: str, keys: list[str]) -> DataFrame:
    """One row per distinct word of either text: its hash `h` and its counts `tf0` and `tf1` in the two; without words one null row.

    The lowest bit of a hash says which text the word is from, so the two runs of a word lie side by side.
    """
    hashes = lambda text, mark: (f"transform(filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != ''), x -> {mark})")
    hashed = rows.withColumn("_s", F.expr(
        f"sort_array(concat({hashes(first, 'xxhash64(x) & -2L')}, {hashes(second, 'xxhash64(x) | 1L')}))")).drop(first, second)
    runs = hashed.withColumn("_i", F.expr(
        "filter(sequence(0, size(_s)), i -> i < size(_s) and (i = 0 or _s[i] != _s[greatest(i - 1, 0)]))"))
    runs = runs.withColumn("_r", F.expr("transform(_i, (i, p) -> struct(_s[i] as v, coalesce(get(_i, p + 1), size(_s)) - i as n))")).drop("_s", "_i")
    terms = runs.withColumn("_terms", F.expr("""filter(transform(_r, (x, p) -> case
        when x.v & 1L = 0 then struct(x.v as h, x.n as tf0, if(get(_r, p + 1).v = x.v + 1, get(_r, p + 1).n, 0) as tf1)
        when p > 0 and get(_r, p - 1).v = x.v - 1 then null
        else struct(x.v - 1 as h, 0 as tf0, x.n as tf1) end), x -> x is not null)"""))
    out = terms.select(*keys, F.explode_outer("_terms").alias("_term"))
    return out.select(*keys, F.col("_term.h").alias("h"), F.coalesce("_term.tf0", F.lit(0)).alias("tf0"), F.coalesce("_term.tf1", F.lit(0)).alias("tf1"))


def samples(terms: DataFrame, keys: list[str], carried: list[str], n: int = SAMPLES) -> DataFrame:
    """`sig0, sig1`, the samples of the two texts of each group of terms; `carried` are bigint columns that are alike in a group.

    Pairs of term and sample are rows, so that the generated code stays short enough to be compiled. What is drawn
    for a pair serves both texts; only the weights differ.
    """
    gamma = lambda x: f"-ln({_uniform(f'{x} & 4294967295L')} * {_uniform(f'shiftrightunsigned({x}, 32)')})"
    drawn = terms.select(*keys, *carried, "h", *[F.expr(f"case when tf{i} > 0 then ln(cast(tf{i} as double)) end").alias(f"lw{i}") for i in (0, 1)],
                         F.explode(F.array(*[F.lit(j).cast("long") for j in range(n)])).alias("j"))
    drawn = drawn.select(*keys, *carried, "h", "lw0", "lw1", "j", F.expr("xxhash64(h, j)").alias("a"), F.expr("xxhash64(h, j, 1L)").alias("b"),
                         F.expr(_uniform("xxhash64(h, j, 2L) & 4294967295L")).alias("u"))
    drawn = drawn.select(*keys, *carried, "h", "lw0", "lw1", "j", F.expr(gamma("a")).alias("r"), F.expr(f"ln({gamma('b')})").alias("lc"), "u")
    drawn = drawn.select(*keys, *carried, "h", "j", "r", "lc", "u", *[F.expr(f"floor(lw{i} / r + u)").alias(f"t{i}") for i in (0, 1)])

    def order(t: str) -> Column:
        return F.expr(f"case when {t} is not null then cast(least(greatest((lc - r * ({t} - u + 1D) + 96D) * 16777216D, 0D), 2147483647D) as bigint)"
                      f" * 4294967296L + (xxhash64(h, {t}, j) & 4294967295L) end")

    least = drawn.select(*keys, "j", *carried, order("t0").alias("s0"), order("t1").alias("s1"))
    each = least.groupBy(*keys, "j").agg(*[F.max(c).alias(c) for c in carried], F.min("s0").alias("s0"), F.min("s1").alias("s1"))
    grouped = each.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carried],
                                      F.sort_array(F.collect_list(F.struct("j", "s0", "s1"))).alias("_all"))
    return grouped.select(*keys, *carried, *[
        F.expr(f"transform(filter(_all, x -> x.s{i} is not null), x -> x.s{i} & 4294967295L)").alias(f"sig{i}") for i in (0, 1)])


def likeness(a: str, b: str) -> Column:
    both = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> e)) / cast(size({a}) as double)")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(both)

def fingerprint(sig: str) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")

def with_next(rows: DataFrame) -> DataFrame:
    """Every row of (k, tie, n) with the row that follows in descending order; the first follows the last.

    The rows are dealt to ranges, written with their range's number, and numbered pairs are made inside
    each range; only the highest row of each range, one per partition, meets in one task.
    """
    ranged = keep(rows.distinct().repartitionByRange(F.col("k"), F.col("tie")).withColumn("range", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("range").orderBy(F.col("k").desc(), F.col("tie").desc())
    edge = ranged.groupBy("range").agg(F.max(F.struct("k", "tie")).alias("top"))
    down = edge.select("range", F.coalesce(F.lead("top").over(Window.orderBy(F.col("range").desc())),
                                           F.first("top").over(Window.orderBy(F.col("range").desc()))).alias("below"))
    paired = ranged.withColumn("own_next", F.lead(F.struct("k", "tie")).over(inside)).join(down, "range")
    following = F.coalesce("own_next", "below")
    return paired.select("k", "tie", "n", following["k"].alias("next_k"), following["tie"].alias("next_tie"))

def with_edits(docs: DataFrame) -> DataFrame:
    """`k, tie, n, next_k, next_tie, text, edited`: the last half of each text replaced by the next document's start."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("k"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    pairs = keep(with_next(rows.select("k", "tie", F.length("text").cast("long").alias("n"))), "pairs")
    once = rows.dropDuplicates(["k", "tie"])
    asked = pairs.select(F.col("next_k").alias("k"), F.col("next_tie").alias("tie"), F.col("k").alias("to_k"), F.col("tie").alias("to_tie"),
                         F.expr("cast(n div 2 as int)").alias("m"))
    heads = once.join(asked, ["k", "tie"]).select(F.col("to_k").alias("k"), F.col("to_tie").alias("tie"),
                                                  F.expr("substring(text, 1, m)").alias("head"))
    return (once.join(pairs, ["k", "tie"]).join(heads, ["k", "tie"])
            .withColumn("edited", F.expr("concat(substring(text, 1, cast(n - n div 2 as int)), head)")).drop("head"))

def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how like it is to that and to the next document."""
    edited = with_edits(docs)
    sha = F.sha2("edited", 256)
    parts = [F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    carried = ["n", "next_k", "next_tie", *[f"sha{i}" for i in range(4)]]
    keys = ["k", "tie"]
    both = edited.select(*keys, "n", "next_k", "next_tie", *parts, "text", "edited")
    sampled = samples(with_terms(both, "text", "edited", [*keys, *carried]), keys, carried)
    found = keep(sampled.withColumnsRenamed({"sig0": "sig", "sig1": "edited_sig"}), "samples")
    following = found.select(F.col("k").alias("next_k"), F.col("tie").alias("next_tie"), F.col("sig").alias("next_sig"))
    hexed = F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)]))
    return found.join(following, ["next_k", "next_tie"]).select(
        F.when(F.col("k") != LEAST_ID, F.col("k")).alias("doc_id"), F.col("n").alias("n_chars"), hexed.alias("edited_sha256"),
        fingerprint("sig").alias("fingerprint"), fingerprint("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
