"""Quality scores by a regularised quadratic discriminant.

Each document becomes a row of transformed statistics (`features.STATISTICS`). The class means and
covariances come from sums and outer products that every task adds up over its labelled documents, all
of them, so only one small matrix per task and class is shuffled. Covariances are shrunk towards the pooled one and
that towards its diagonal; their Cholesky factors are computed once and go to the tasks with the
constants, a few kilobytes. A score is the logistic of the difference of the two Mahalanobis
log-densities, with the class shares as prior.

A class without labelled documents leaves the discriminant undefined; then every score is the share of
label 1 (0.5 without labels). Null and empty texts have the statistics of zero words, very long ones those of the
whole text. Documents with several labels count once per label; null labels do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import held_out, kept_rows, slices
from causeway.llm.features import STATISTICS, statistics

SHRINK_TO_POOLED = 0.1
SHRINK_TO_DIAGONAL = 0.05


@dataclass
class Discriminant:
    share: float
    means: np.ndarray | None = None  # by class
    factors: np.ndarray | None = None  # inverse Cholesky factors by class
    constants: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def discriminant(counts: np.ndarray, firsts: np.ndarray, seconds: np.ndarray, to_pooled: float = SHRINK_TO_POOLED,
                 to_diagonal: float = SHRINK_TO_DIAGONAL) -> Discriminant:
    """From the number, sum and sum of outer products of each class's rows."""
    total = counts.sum()
    share = float(counts[1] / total) if total else 0.5
    if counts.min() < 2:
        return Discriminant(share)
    means = firsts / counts[:, None]
    each = seconds / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (each * counts[:, None, None]).sum(axis=0) / total
    diagonal = np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
    target = (1 - to_diagonal) * pooled + to_diagonal * diagonal
    # A class of few documents leans further on the pooled covariance.
    lean = np.maximum(to_pooled, len(pooled) / (len(pooled) + counts))
    shrunk = (1 - lean)[:, None, None] * each + lean[:, None, None] * target
    lower = np.linalg.cholesky(shrunk)
    constants = np.log(counts / total) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(share, means, np.linalg.inv(lower), constants)


def fit(docs: DataFrame, known: DataFrame) -> Discriminant:
    """`docs`: doc_id and text; `known`: doc_id and label (0 or 1). Every labelled row counts.

    Texts become statistics where they are read; only those rows meet the labels.
    """
    k = len(STATISTICS)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(batch.column("text")).ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], ["doc_id", "x"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + k + k * k))
        for batch in batches:
            x, y = batch.column("x").flatten().to_numpy().reshape(-1, k), batch.column("label").to_numpy()
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["label", "sums"])

    described = docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, x array<double>")
    parts = described.join(known, "doc_id").select("x", F.col("label").cast("int")).mapInArrow(add_up, "label int, sums array<double>")
    rows = (parts.select("label", F.posexplode("sums").alias("at", "value")).groupBy("label", "at").agg(F.sum("value").alias("value"))
            .collect())  # two rows of 1 + k + k * k numbers, whatever the input
    sums = np.zeros((2, 1 + k + k * k))
    for r in rows:
        sums[r["label"], r["at"]] = r["value"]
    return discriminant(sums[:, 0], sums[:, 1 : 1 + k], sums[:, 1 + k :].reshape(2, k, k))


def score(docs: DataFrame, model: Discriminant, threshold: float, out: Column | None = None) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every row: a map over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = model.scores(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()),
                                              pa.array((s >= threshold).astype(np.int32), pa.int32())],
                                             ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (F.lit(False) if out is None else out).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame, folds: int) -> Discriminant:
    """From the documents outside the held-out fold and `labels.quality`."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where("label in (0, 1)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return fit(rows.where("doc_id is not null").where(~held_out("doc_id", folds)), known)


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4) -> DataFrame:
    """The rows of `docs`, with all columns, whose own text scores at least the threshold."""
    model = learn(docs, labels, folds)
    return kept_rows(docs, lambda texts: model.scores(statistics(texts)) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4) -> DataFrame:
    """Learn `labels.quality` from the documents outside the held-out fold and score all documents."""
    return score(docs, learn(docs, labels, folds), threshold, held_out("doc_id", folds))
