"""Exact top-k search by inner product with paged M-trees.

Inner products become distances: with `M` the largest squared norm, the point `x` gets one more
coordinate `sqrt(M - |x|^2)` and the query a zero, and the squared distance is `|q|^2 + M - 2 q.x`. The vectors are
dealt to shards of bounded size; each shard is one M-tree whose nodes are pages: an entry has a routing
object, a covering radius and the distance to its parent's routing object. A query goes best-first
through a shard's tree with a queue of lower bounds. An entry whose bound from the stored parent
distance (triangle inequality) cannot beat the k-th best so far is passed over without a distance being
computed. Scores are exact whole numbers; bounds carry a margin for rounding, and equal scores are
kept, so ties fall to the smaller id.

Queries meet the shards in one sorted stream per shard: its vectors first, then the queries, a batch at
a time. Each query gives k rows per shard, of which a window keeps the k best.

Vectors that are null, hold null or non-finite components or are empty take no part, nor do null ids.
Vectors of another length than the query's are not compared with it. Rows that repeat an id count once
per distinct vector; a query never meets a row of its own id. Components are whole numbers of 64 bits; where an inner
product that is looked at leaves 64 bits, the search fails with OverflowError. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
PAGE = 512  # points of a leaf: few large pages, as bounds of long vectors seldom cut off small ones
FAN_OUT = 16
EXACT = 1 << 53  # whole numbers up to here are exact as doubles
GREATEST = (1 << 63) - 1
SLACK = 1e-6  # relative to the largest squared norm


class MTree:
    """Nodes are arrays: a leaf has points, an inner node routing objects, radii and children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points
        self.reals = points.astype(np.float64)
        self.most = max((abs(int(x)) for x in (points.min(), points.max())), default=0) if points.size else 0
        norms = (self.reals**2).sum(axis=1)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.lifted = np.column_stack([points, np.sqrt(np.maximum(self.top - norms, 0))])
        self.root = self.build(np.arange(len(ids)), None) if len(ids) else None

    def build(self, rows: np.ndarray, router: np.ndarray | None) -> tuple:
        """(rows, parent distances) of a page or (routers, radii, parent distances, children) of an inner node."""
        own = self.lifted[rows]
        to_parent = np.zeros(len(rows)) if router is None else np.sqrt(((own - router) ** 2).sum(axis=1))
        if len(rows) <= PAGE:
            return rows, to_parent
        # Farthest-first routing objects, then each row to its nearest.
        routers = [own[int(to_parent.argmax())]]
        best = ((own - routers[0]) ** 2).sum(axis=1)
        near = np.zeros(len(rows), np.int64)
        for k in range(1, FAN_OUT):
            if best.max() == 0:
                break
            routers.append(own[int(best.argmax())])
            d = ((own - routers[-1]) ** 2).sum(axis=1)
            near[d < best] = k
            best = np.minimum(best, d)
        if len(routers) == 1:  # all points alike
            near = np.arange(len(rows)) % FAN_OUT
            routers = routers * FAN_OUT
        groups = [(r, rows[near == k], np.sqrt(best[near == k].max())) for k, r in enumerate(routers) if (near == k).any()]
        centers = np.array([r for r, _, _ in groups])
        up = np.zeros(len(groups)) if router is None else np.sqrt(((centers - router) ** 2).sum(axis=1))
        return centers, np.array([x for _, _, x in groups]), up, [self.build(g, r) for r, g, _ in groups]

    def products(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where they hold every sum, else in 64 bits, else in whole numbers of any size."""
        reach = len(query) * self.most * max(abs(int(x)) for x in (query.min(), query.max()))
        if reach < EXACT:
            return (self.reals[rows] @ query.astype(np.float64)).astype(np.int64)
        if reach <= GREATEST:
            return self.points[rows] @ query
        exact = self.points[rows].astype(object) @ query.astype(object)
        if len(exact) and max(abs(x) for x in exact) > GREATEST:
            raise OverflowError("an inner product leaves 64 bits")
        return exact.astype(np.int64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), the best first; the query's own id is left out."""
        if self.root is None:
            return []
        q = np.append(query, 0).astype(np.float64)
        norm = float(q @ q)
        slack = SLACK * (self.top + norm) + 1e-9
        found: list[tuple[int, int]] = []  # a heap of (score, -id)
        reach = np.inf  # no farther point can be among the k best
        queue: list[tuple[float, int, tuple, float]] = [(0.0, 0, self.root, -1.0)]
        pushed = 0
        while queue:
            bound, _, node, parent = heapq.heappop(queue)
            if bound > reach:
                break
            if len(node) == 2:
                rows, up = node
                if parent >= 0:
                    rows = rows[np.abs(parent - up) <= reach]
                rows = rows[self.ids[rows] != query_id]
                scores = self.products(rows, query)
                if len(found) == k:
                    good = scores >= found[0][0]
                    rows, scores = rows[good], scores[good]
                for score, i in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                    if len(found) < k:
                        heapq.heappush(found, (score, -i))
                    elif (score, -i) > found[0]:
                        heapq.heapreplace(found, (score, -i))
                if len(found) == k:
                    reach = float(np.sqrt(max(norm + self.top - 2.0 * found[0][0], 0) + slack))
                continue
            centers, radii, up, children = node
            near = np.arange(len(radii)) if parent < 0 else np.flatnonzero(np.abs(parent - up) - radii <= reach)
            distances = np.sqrt(((centers[near] - q) ** 2).sum(axis=1))
            for d, c in zip(distances.tolist(), near.tolist(), strict=True):
                low = max(bound, d - float(radii[c]) - slack)
                if low <= reach:
                    pushed += 1
                    heapq.heappush(queue, (low, pushed, children[c], d))
        return [(s, -i) for s, i in sorted(found, key=lambda x: (-x[0], -x[1]))]


def _stream(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, trees = None, [], [], None

        def planted() -> dict[int, MTree]:
            by_length: dict[int, list[int]] = {}
            for n, v in enumerate(vectors):
                by_length.setdefault(len(v), []).append(n)
            return {m: MTree(np.array([ids[n] for n in rows]), np.array([vectors[n] for n in rows], np.int64))
                    for m, rows in by_length.items()}

        for batch in batches:
            out = []
            values = batch.column("v")
            flat, ends = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            for n, (s, query, i) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("is_query").to_pylist(),
                                                  batch.column("id").to_pylist(), strict=True)):
                v = flat[ends[n] : ends[n + 1]]
                if s != shard:
                    shard, ids, vectors, trees = s, [], [], None
                if not query:
                    ids.append(i)
                    vectors.append(np.array(v))
                    continue
                if trees is None:
                    trees = planted()
                if len(v) in trees:
                    out += [(i, j, score) for score, j in trees[len(v)].search(i, v.astype(np.int64), k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                                 ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k best vectors for each query.

    Both tables have `vec_id` and `v`, an array of whole numbers. The number of shards follows the number
    of vectors; every query visits every shard, in blocks.
    """
    vectors = vectors.select("vec_id", "v").distinct()
    shards = -(-vectors.count() // SHARD_ROWS) or 1
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), F.lit(False).alias("is_query"),
                           F.col("vec_id").alias("id"), "v")
    asked = queries.select("vec_id", "v").distinct().select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("is_query"),
        F.col("vec_id").alias("id"), "v")
    # Ranges of whole shards: a hash would put several into one partition and none into others.
    streams = dealt.unionByName(asked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "is_query")
    found = streams.mapInArrow(_stream(k), "query_id long, vec_id long, score long").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """`vec_id, v`: each component x becomes floor(scale * x); unusable vectors go."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
