"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings learns from confirmed toxic documents (P) and from unlabelled
documents (U), whose labels are not looked at. The class prior is the share of label 1 among the labelled
documents that may be learned from. The risk is `prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`, with the
logistic loss; where the second part turns negative, its gradient is turned round, which keeps the
classifier from calling every unlabelled toxic word harmless.

P and U are samples of at most `POSITIVES` and `UNLABELLED` documents, the first by a hash of the id; this
bounds what is learned from at any size. Everything is scored, whole texts included.
Features are the words (A-Z lower-cased, punctuation around them cut off) and beginnings that stand in at least
`LEAST_DOCUMENTS` sampled positives, differ between P and U by `LEAST_CONTRAST` standard errors and are
among the `FEATURES` most telling.

A null or empty text has no features; its score is the one of the bias. Without any confirmed toxic
document every score is the prior (0 without labels). Repeated rows are scored alike; null labels do
not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import held_out, keep, kept_rows, slices, words

POSITIVES = 6_000
UNLABELLED = 12_000
BUCKETS = 1 << 22
FEATURES = 512
PREFIXES = (3, 4, 6)  # a word counts by itself and by its beginnings
LEAST_DOCUMENTS = 4
LEAST_CONTRAST = 5.0  # standard errors; over a million words, chance gives hardly one of them
AROUND = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def features(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How often each feature stands in each text: row numbers, buckets, counts (sorted by row, bucket); words per text.

    With `chosen`, a flag for each bucket, only those features are counted.
    """
    flat, ends = words(texts, lower=True)
    coded = pc.ascii_trim(flat, characters=AROUND).dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    table = np.full((len(vocabulary), 1 + len(PREFIXES)), -1, np.int64)
    for i, w in enumerate(vocabulary):
        if w:
            table[i, 0] = xxhash.xxh3_64_intdigest(w) % BUCKETS
            for k, n in enumerate(PREFIXES, 1):
                if len(w) >= n:
                    table[i, k] = xxhash.xxh3_64_intdigest(w[:n], seed=n) % BUCKETS
    if chosen is not None:
        table[(table >= 0) & ~chosen[table]] = -1
    index = coded.indices.to_numpy()
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    found = table[index].ravel() if len(index) else np.zeros(0, np.int64)
    hit = found >= 0
    pairs, counts = np.unique(np.repeat(rows, table.shape[1])[hit] * BUCKETS + found[hit], return_counts=True)
    return pairs // BUCKETS, pairs % BUCKETS, counts, np.diff(ends)


def values(counts: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a count is worth: by itself, and as a share of the text."""
    return np.log1p(counts), np.log1p(200 * counts / np.maximum(n_words, 1))


@dataclass
class PuClassifier:
    prior: float
    buckets: np.ndarray  # sorted
    weights: np.ndarray  # by count, then by share of the text
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        flags = np.zeros(BUCKETS, bool)
        flags[self.buckets] = True
        rows, buckets, counts, n_words = features(texts, flags)
        at = np.searchsorted(self.buckets, buckets)
        by_count, by_share = values(counts, n_words[rows])
        each = by_count * self.weights[at] + by_share * self.weights[len(self.buckets) + at]
        logits = self.bias + np.bincount(rows, each, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logits, -700, 700)))


Sample = tuple[np.ndarray, np.ndarray, int]  # chosen features of a document (sorted), counts, number of its words


def train(positive: list[Sample], unlabelled: list[Sample], chosen: np.ndarray, prior: float, steps: int = 600, batch: int = 256,
          rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> PuClassifier:
    if not positive or not unlabelled or not 0 < prior < 1:
        edge = min(max(prior, 1e-6), 1 - 1e-6)
        return PuClassifier(prior, np.zeros(0, np.int64), np.zeros(0), float(np.log(edge / (1 - edge))))

    def matrix(docs: list[Sample]) -> np.ndarray:
        x = np.zeros((len(docs), 2 * len(chosen)), np.float32)
        for i, (buckets, counts, n_words) in enumerate(docs):
            own = np.searchsorted(chosen, buckets)
            x[i, own], x[i, len(chosen) + own] = values(counts, n_words)
        return x

    xp, xu = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(2 * len(chosen)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    rng = np.random.default_rng(seed)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -60, 60)))
    for step in range(1, steps + 1):
        p_rows = xp[rng.integers(len(xp), size=batch)]
        u_rows = xu[rng.integers(len(xu), size=2 * batch)]
        p_out, u_out = sigmoid(p_rows @ w + b), sigmoid(u_rows @ w + b)
        negative = -np.log(np.maximum(1 - u_out, 1e-12)).mean() + prior * np.log(np.maximum(1 - p_out, 1e-12)).mean()
        from_p, from_u = (p_out - 1) * prior / len(p_out), u_out / len(u_out)
        minus = p_out * prior / len(p_out)
        if negative >= 0:
            g_p, g_u = from_p - minus, from_u
        else:  # the non-negative correction
            g_p, g_u = minus, -from_u
        grad = np.append(g_p @ p_rows + g_u @ u_rows + decay * w, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return PuClassifier(prior, chosen, w, float(b))


def contrasts(counted: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The most telling features, sorted; `counted` has the samples' `positive, buckets`. Counts stay in Spark.

    The log-odds of a feature over their standard error; U holds positives itself, which only weakens the contrast.
    """
    each = counted.select("positive", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.count_if("positive").alias("in_p"), F.count_if(~F.col("positive")).alias("in_u")).where(F.col("in_p") >= LEAST_DOCUMENTS)
    share = lambda k, n: (k + 0.5) / (n + 1)
    odds = lambda x: F.log(x / (1 - x))
    in_p, in_u = F.col("in_p"), F.col("in_u")
    error = F.sqrt(1 / (in_p + 0.5) + 1 / (n_p - in_p + 0.5) + 1 / (in_u + 0.5) + 1 / (n_u - in_u + 0.5))
    z = (odds(share(in_p, n_p)) - odds(share(in_u, n_u))) / error
    best = each.withColumn("z", z).where(F.col("z") >= LEAST_CONTRAST).orderBy(F.col("z").desc(), "bucket").limit(FEATURES)
    return np.array(sorted(r["bucket"] for r in best.select("bucket").collect()), np.int64)


def fit(docs: DataFrame, labels: DataFrame, folds: int) -> PuClassifier:
    """Samples, prior and classifier; `docs` and `labels` may hold any rows, the held-out fold is left out here.

    A sampled id counts once, with the smallest of its texts. Features are counted and chosen in Spark; to the
    driver come the chosen ones of the samples, at most FEATURES numbers a document.
    """
    known = labels.where("toxic in (0, 1)").where(~held_out("doc_id", folds))
    counts = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    prior = (counts["k"] or 0) / counts["n"] if counts["n"] else 0.0
    by_hash = F.xxhash64("doc_id")
    positives = (known.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
                 .orderBy(by_hash, "doc_id").limit(POSITIVES))
    unlabelled = (docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
                  .where(~held_out("doc_id", folds)).distinct().orderBy(by_hash, "doc_id").limit(UNLABELLED))
    # At most POSITIVES + UNLABELLED ids: a broadcast of fixed size.
    chosen = positives.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    sampled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sampled = sampled.join(F.broadcast(chosen), "doc_id").groupBy("positive", "doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, buckets, counts, n_words = features(batch.column("text"))
            ends = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (buckets, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("doc_id"), *lists, pa.array(n_words, pa.int64())],
                                             ["positive", "doc_id", "buckets", "counts", "n_words"])

    schema = "positive boolean, doc_id long, buckets array<int>, counts array<int>, n_words long"
    counted = keep(sampled.mapInArrow(run, schema), "samples")
    sizes = dict(counted.groupBy("positive").count().collect())
    told = contrasts(counted, sizes.get(True, 0), sizes.get(False, 0))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts = batch.column("buckets"), batch.column("counts").flatten()
            hit = np.isin(lists.flatten().to_numpy(), told)
            upto = np.concatenate([[0], np.cumsum(hit)])
            ends = pa.array(upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), batch.column("doc_id"), pa.ListArray.from_arrays(ends, lists.flatten().filter(pa.array(hit))),
                 pa.ListArray.from_arrays(ends, counts.filter(pa.array(hit))), batch.column("n_words")], batch.schema.names)

    found = counted.mapInArrow(only, schema).toArrow().combine_chunks()
    flag = found["positive"].to_numpy(zero_copy_only=False)
    order = np.lexsort((found["doc_id"].to_numpy(), flag))
    columns = [[x.values.to_numpy() for x in found[c]] for c in ("buckets", "counts")]
    lists = list(zip(*columns, found["n_words"].to_pylist(), strict=True))
    return train([lists[i] for i in order if flag[i]], [lists[i] for i in order if not flag[i]], told, prior)


def score(docs: DataFrame, model: PuClassifier, threshold: float, out: Column | None = None) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every row: a map over the rows with a model of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = model.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()),
                                              pa.array((s >= threshold).astype(np.int32), pa.int32())],
                                             ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (F.lit(False) if out is None else out).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def harmless(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4) -> DataFrame:
    """The rows of `docs`, with all columns, whose own text scores below the threshold."""
    model = fit(docs, labels, folds)
    return kept_rows(docs, lambda texts: model.scores(texts) < threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all documents."""
    return score(docs, fit(docs, labels, folds), threshold, held_out("doc_id", folds))
