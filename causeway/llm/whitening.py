"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred table.

Components become whole numbers, x = floor(scale * c) + offset. A first pass sums every dimension exactly and
writes the rows as blocks of bounded size, one byte string of 64-bit numbers each, with the ids beside it. Let X
be the rows x - S/n. Each Lanczos step is one job over the blocks: it forms u = Xw for the step's direction and,
in the same pass, the products of u with all earlier left vectors, its norm and X'u. Tasks return partial sums
of dimensions + steps + 1 numbers, which Spark adds. The left vectors lie in the range of X, so they are kept as
their coefficients (u = Xw) and never stored: a lost executor costs a re-read of its blocks. Left vectors are
reorthogonalised with the products of the pass, again with another pass where cancellation was large, right
vectors on the driver. Where a right vector finds no further left one, or the space is exhausted, a new start
vector orthogonal to all is taken. The SVD of the small bidiagonal matrix gives components and deviations.

The iteration ends when the whole variance or every dimension is covered, or when the residuals of the wanted
components have fallen to rounding twice, with a new start vector in between, so that equal deviations are
all found. On the driver are dimensions x steps numbers, whatever the number of rows.

Vectors that are null, empty or hold null or non-finite components take no part. Of the others the most frequent
length counts (of equally frequent ones the greatest); vectors of other lengths take no part either.
Rows without an id and repeated rows count and are returned like others. Components whose variance is zero to
rounding are left out, so a single vector, equal vectors and an empty table give no rows. Numbers that
leave 64 bits, in x or in the deviation, raise OverflowError or Spark's own overflow error. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import keep

BLOCK_BYTES = 1 << 19
OUT_ROWS = 1 << 16
CONVERGED = 1e-15  # residual relative to the largest singular value
EXHAUSTED = 1e-13  # norm relative to the largest singular value that counts as none
GREATEST = np.iinfo(np.int64).max


def whole_numbers(embeddings: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """`vec_id, x` of the usable vectors of the most frequent length."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(F.coalesce(usable, F.lit(False)))
    lengths = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc())
    found = lengths.first()
    return rows.where(F.size("embedding") == (found["size"] if found else 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long") + F.lit(offset).cast("long")).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("x")
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        d = int(ends[1] - ends[0]) if batch.num_rows else 1
        step = max(1, BLOCK_BYTES // (8 * d))
        for start in range(0, batch.num_rows, step):
            ids = batch.column("vec_id").slice(start, step)
            x = np.ascontiguousarray(flat[ends[start] : ends[start + len(ids)]])
            x2 = x.reshape(len(ids), d)
            # Halves of 32 bits cannot overflow their sums.
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([x.tobytes()], pa.binary()), pa.array([len(ids)], pa.int64()),
                 pa.ListArray.from_arrays([0, d], (x2 >> 32).sum(axis=0)), pa.ListArray.from_arrays([0, d], (x2 & 0xFFFFFFFF).sum(axis=0))],
                ["ids", "x", "n", "high", "low"])


class Table:
    """The blocks of the rows, their number, exact sums and what centres them."""

    def __init__(self, vectors: DataFrame):
        self.blocks = keep(vectors.mapInArrow(_blocks, "ids array<long>, x binary, n long, high array<long>, low array<long>"), "vectors")
        sums = (self.blocks.select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "part")).groupBy("at")
                .agg(F.sum("part.high").alias("high"), F.sum("part.low").alias("low")).orderBy("at").collect())
        self.n = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.sums = [(r["high"] << 32) + r["low"] for r in sums]
        self.d = len(self.sums)
        self.base = [s // self.n for s in self.sums]
        self.rest = [s % self.n for s in self.sums]

    def centred(self, data: bytes) -> np.ndarray:
        x = np.frombuffer(data, np.int64).reshape(-1, self.d)
        return (x - np.array(self.base, np.int64)) - np.array(self.rest, np.float64) / self.n

    def deviations(self, data: bytes) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2 per row, exact."""
        x = np.frombuffer(data, np.int64).reshape(-1, self.d) - np.array(self.base, np.int64)
        most = self.n * (int(np.abs(x).max()) + 1)
        if self.d * most**2 <= GREATEST:
            return ((x * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1)
        exact = ((x.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(axis=1)
        if max(exact) > GREATEST:
            raise OverflowError("a deviation leaves 64 bits")
        return exact.astype(np.int64)

    def local(self) -> Table:
        """What tasks need, without the DataFrame."""
        out = object.__new__(Table)
        out.n, out.d, out.base, out.rest = self.n, self.d, self.base, self.rest
        return out

    def total(self, part, size: int) -> np.ndarray:
        """The sum over all blocks of what `part` makes of a centred block; `size` numbers."""
        here = self.local()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                for data in batch.column("x"):
                    out += part(here.centred(data.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, size], out)], ["part"])

        parts = self.blocks.select("x").mapInArrow(run, "part array<double>")
        rows = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value")).collect()
        out = np.zeros(size)
        for at, value in rows:
            out[at] = value
        return out


def _step(w: np.ndarray, earlier: np.ndarray):
    """u'u, the products with the earlier left vectors and X'u, where u = Xw."""
    def part(x: np.ndarray) -> np.ndarray:
        u = x @ w
        return np.concatenate([[u @ u], (x @ earlier).T @ u, x.T @ u])

    return part


def orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(table: Table, components: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(right singular vectors as columns, singular values, sum of squares of X), the greatest first."""
    d, random = table.d, np.random.default_rng(seed)
    whole = float(table.total(lambda x: np.array([(x * x).sum()]), 1)[0])
    right, left, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alphas, betas, settled, top = [], [], 0, math.sqrt(whole)
    v, beta = None, 0.0
    while whole > 0 and right.shape[1] < d:
        if v is None:
            v, beta = orthogonal(random.standard_normal(d), right), 0.0
            v /= np.linalg.norm(v)
        w = v - beta * left[:, -1] if beta else v
        right = np.column_stack([right, v])
        found = table.total(_step(w, left), 1 + left.shape[1] + d)
        square, along, image = found[0], found[1 : 1 + left.shape[1]], found[1 + left.shape[1] :]
        w, image = w - left @ along, image - images @ along
        norm = max(square - float(along @ along), 0.0)
        if norm < 0.5 * square and norm > (EXHAUSTED * top) ** 2:  # much was taken away: once more
            found = table.total(_step(w, left), 1 + left.shape[1] + d)
            along, image = found[1 : 1 + left.shape[1]], found[1 + left.shape[1] :]
            w, image, norm = w - left @ along, image - images @ along, max(found[0] - float(along @ along), 0.0)
        alpha = math.sqrt(norm)
        if alpha <= EXHAUSTED * top:
            alpha, w, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, image = w / alpha, image / alpha
        left, images = np.column_stack([left, w]), np.column_stack([images, image])
        alphas.append(alpha)
        betas.append(beta)
        rest = orthogonal(image - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        small = np.diag(alphas) + np.diag(betas[1:], 1)
        sides, sigma, turned = np.linalg.svd(small)
        if whole - float(sigma @ sigma) <= 1e-15 * d * whole:
            break
        residual = beta * np.abs(sides[-1, :components])
        if len(sigma) > components and (residual <= CONVERGED * sigma[0]).all():
            settled += 1
            if settled == 2:
                break
            v = None
        elif alpha == 0 or beta <= EXHAUSTED * top:
            v = None
        else:
            v = rest / beta
    if not alphas:
        return right, np.zeros(0), whole
    vectors = right @ turned.T
    usable = sigma > EXHAUSTED * sigma[0] * math.sqrt(d)
    return vectors[:, usable][:, :components], sigma[usable][:components], whole


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error` per row of `vec_id, x` and component.

    `whitened` is x - S/n projected on a unit eigenvector of the covariance over the root of its eigenvalue.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    table = Table(vectors)
    spark = vectors.sparkSession
    if table.n == 0:
        return spark.createDataFrame([], schema)
    axes, sigma, whole = bidiagonalise(table, components)
    k = len(sigma)
    if k == 0:
        return spark.createDataFrame([], schema)
    turn = axes / (sigma / math.sqrt(table.n))

    def moments(x: np.ndarray) -> np.ndarray:
        y = x @ turn
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    found = table.total(moments, k + k * k)
    mean = found[:k] / table.n
    error = float(np.abs(found[k:].reshape(k, k) / table.n - np.outer(mean, mean) - np.eye(k)).max())
    share = sigma**2 / whole
    here = table.local()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("x"), strict=True):
                y, deviations = here.centred(data.as_buffer()) @ turn, here.deviations(data.as_buffer())
                step = max(1, OUT_ROWS // k)
                for start in range(0, len(y), step):
                    part = y[start : start + step]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [ids.values.slice(start, m).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                         pa.array(np.full(m * k, here.n)), pa.array(np.repeat(deviations[start : start + m], k)), pa.array(part.ravel()),
                         pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.blocks.select("ids", "x").mapInArrow(rows, schema)
