"""N-gram Jaccard join by prefix trees.

The set of a document is that of its distinct 5-word shingles (A-Z lower-cased; a shorter text is one
shingle, an empty one has none). Two documents link at a Jaccard similarity of 3/4 or more. Identical sets
are one node; the result is exact for the 64-bit shingle hashes.

1. Screen. With shingles ordered by hash, two linked sets share at least `l` shingles among the first
   `n - ceil(3n/4) + l` of each, for any l. Only those are shuffled (one row per shingle and batch); sets
   that share fewer are out, among them those that have a mere passage in common.
2. Order. For the sets left, a new global order puts frequent shingles last (a table of at most
   `HINTS` of them; an order decides about speed alone). Linked sets share one of their first
   `n - ceil(3n/4) + 1` shingles in it; sets that do are in one cluster.
3. Prefix trees. The sets of a cluster, in chunks of bounded size, are stored in a compressed trie in
   global order. Every set walks down the trie level by level; sets with a common beginning share its
   partial overlap, and a subtree is cut off as soon as the overlap so far and the shingles left in both
   cannot reach the bound.
4. Clusters of several chunks. Chunks are dealt by the smallest shingle, which most near copies share. A
   chunk's components then meet by one member each with the largest component of a shingle, and last every
   candidate pair of members of different components that can still reach the bound is compared, so that
   no link is lost. Candidates are found component by component and made once, not once per shared shingle.
   Pairs within a component are never made, and a large group of near copies costs a number of pairs in
   proportion to the members outside its largest component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import (KEYS, U, keep, keep_by, keys_with_documents, run_hashes, shared_keys, signed, slices,
                                 word_hashes, words)
from causeway.llm.components import components

SHINGLE = 5
HINTS = 1 << 20
CHUNK_TOKENS = 1 << 20
CROWD = 8  # sets of one first shingle fill at most about this part of a chunk


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, ends = words(texts, lower=True)
    hashes = word_hashes(flat)
    runs = run_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(run_hashes(hashes[a:b], b - a) ^ U(b - a))
        else:
            out.append(hashes[:0])
    return out


def at_least(n):
    """The smallest overlap that a set of n can link with."""
    return -(-3 * n // 4)


def slack(n: int) -> int:
    return max(1, n // 32)


def _screen_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()  # sets that this task has sent already
    for batch in slices(batches):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keys, rows = [], []
        for i, s in enumerate(shingle_sets(batch.column("text"))):
            mark = xxhash.xxh3_128_digest(s.tobytes())
            if mark in seen or not len(s):
                continue
            seen.add(mark)
            first = s[: len(s) - at_least(len(s)) + slack(len(s))]
            keys.append(first)
            rows.append(np.full(len(first), i))
        if keys:
            yield keys_with_documents(np.concatenate(keys), np.concatenate(rows), ids)


SETS = "doc_id long, n long, mark binary, shingles array<long>"


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hits = batch.column("hits").to_numpy(zero_copy_only=False)
        sets = shingle_sets(batch.column("text"))
        shingles = [signed(s).tolist() if h >= slack(at_least(len(s))) and len(s) else None for s, h in zip(sets, hits, strict=True)]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(shingles, pa.list_(pa.int64()))],
            ["doc_id", "n", "mark", "shingles"])


def _arrays(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that stand in two sets of a batch at least, with how many."""
    for batch in batches:
        keys, counts = np.unique(batch.column("shingles").flatten().to_numpy(), return_counts=True)
        some = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(counts[some], pa.int64())], ["key", "n"])


def _prefix_rows(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = frequent.value
        for batch in batches:
            found, rows = [], []
            for i, s in enumerate(_arrays(batch.column("shingles"))):
                weight = np.zeros(len(s), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    weight = np.where(keys[at] == s, counts[at], 0)
                first = s[np.lexsort((s.view(U), weight))][: len(s) - at_least(len(s)) + 1]
                found.append(first.view(U))
                rows.append(np.full(len(first), i))
            if found:
                yield keys_with_documents(np.concatenate(found), np.concatenate(rows), batch.column("doc_id").to_numpy())

    return run


class PrefixTree:
    """A compressed trie of sets given as ascending ranks; nodes are numbered level by level."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        # A node is [set that spells it, depth at its start, depth at its end, children, sets that end here].
        root: list = [order[0], 0, 0, [], []]
        path, last = [root], None
        for i in order:
            s = sets[i]
            shared = 0
            if last is not None:
                m = min(len(s), len(last))
                differ = np.flatnonzero(s[:m] != last[:m])
                shared = int(differ[0]) if len(differ) else m
            while path[-1][1] >= shared and len(path) > 1:
                path.pop()
            top = path[-1]
            if top[2] > shared:  # split its run
                rest = [top[0], shared, top[2], top[3], top[4]]
                top[2], top[3], top[4] = shared, [rest], []
            if len(s) > shared:
                leaf: list = [i, shared, len(s), [], [i]]
                top[3].append(leaf)
                path.append(leaf)
            else:
                top[4].append(i)
            last = s
        nodes, k = [root], 0
        firsts, counts = [], []
        while k < len(nodes):
            firsts.append(len(nodes))
            counts.append(len(nodes[k][3]))
            nodes += nodes[k][3]
            k += 1
        self.first_child, self.children = np.array(firsts), np.array(counts)
        self.ends = [n[4] for n in nodes]
        self.has_ends = np.array([bool(n[4]) for n in nodes])
        self.depth = np.array([n[2] for n in nodes])
        runs = [sets[n[0]][n[1] : n[2]] for n in nodes]
        self.run_length = np.array([len(r) for r in runs])
        self.run_start = np.concatenate([[0], np.cumsum(self.run_length)[:-1]])
        self.runs = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        self.last = np.array([int(r[-1]) if len(r) else -1 for r in runs])
        self.least, self.most = np.full(len(nodes), 1 << 60), np.zeros(len(nodes), np.int64)
        for k in range(len(nodes) - 1, -1, -1):
            sizes = [self.sizes[i] for i in nodes[k][4]]
            span = slice(firsts[k], firsts[k] + counts[k])
            self.least[k] = min([*sizes, *self.least[span]], default=0)
            self.most[k] = max([*sizes, *self.most[span]], default=0)
        self.mask = np.zeros(int(max((s[-1] for s in sets if len(s)), default=0)) + 1, np.int64)

    def linked(self, i: int) -> list[int]:
        """The sets that link with set i, itself included."""
        x, n = self.sets[i], int(self.sizes[i])
        self.mask[x] = 1
        out, nodes, overlap = [], np.array([0]), np.array([0])
        while len(nodes):
            for k in np.flatnonzero(self.has_ends[nodes]).tolist():
                o = int(overlap[k])
                out += [j for j in self.ends[nodes[k]] if 4 * o >= 3 * (n + int(self.sizes[j]) - o)]
            number = self.children[nodes]
            total = int(number.sum())
            if not total:
                break
            parent = np.repeat(np.arange(len(nodes)), number)
            nth = np.arange(total) - np.repeat(np.cumsum(number) - number, number)
            nodes, overlap = self.first_child[nodes][parent] + nth, overlap[parent]
            sized = (4 * self.most[nodes] >= 3 * n) & (3 * self.least[nodes] <= 4 * n)
            nodes, overlap = nodes[sized], overlap[sized]
            if not len(nodes):
                break
            length = self.run_length[nodes]
            begin = np.cumsum(length) - length
            at = np.repeat(self.run_start[nodes] - begin, length) + np.arange(int(length.sum()))
            overlap = overlap + np.add.reduceat(self.mask[self.runs[at]], begin)
            left = np.minimum(n - np.searchsorted(x, self.last[nodes], "right"), self.most[nodes] - self.depth[nodes])
            good = 7 * (overlap + left) >= 3 * (n + self.least[nodes])
            nodes, overlap = nodes[good], overlap[good]
        self.mask[x] = 0
        return out


def linked_groups(sets: list[np.ndarray]) -> list[int]:
    """For each set of hashes the number of the smallest set that it reaches by links."""
    values, ranks, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(values), np.int64)
    place[np.lexsort((values, counts))] = np.arange(len(values))  # the rarest first
    ranks = place[ranks]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    tree = PrefixTree([np.sort(ranks[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in tree.linked(i):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, chunk, doc_id): each chunk becomes a tree; `root` is its component's first document."""
    current, ids, sets = None, [], []

    def done() -> pa.RecordBatch:
        roots = linked_groups(sets) if len(sets) > 1 else [0]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[r] for r in roots], pa.int64())], ["doc_id", "root"])

    for batch in batches:
        for key, i, s in zip(zip(batch.column("cluster").to_pylist(), batch.column("chunk").to_pylist(), strict=True),
                             batch.column("doc_id").to_pylist(), _arrays(batch.column("shingles")), strict=True):
            if key != current and ids:
                yield done()
                ids, sets = [], []
            current = key
            ids.append(i)
            sets.append(s.copy())
    if ids:
        yield done()


def _trees(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """`doc_id, root` for sets `placed` (doc_id, n, first, cluster).

    A cluster over CHUNK_TOKENS is dealt to chunks by its sets' `first` shingles, so that most near copies
    meet in one; where many sets have one first shingle, these are dealt by document as well.
    """
    sizes = placed.groupBy("cluster").agg(F.expr(f"sum(n) div {CHUNK_TOKENS} + 1").alias("chunks"))
    crowds = placed.groupBy("cluster", "first").agg(F.expr(f"{CROWD} * sum(n) div {CHUNK_TOKENS} + 1").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1)))
    dealt = (placed.join(sizes, "cluster").join(crowds, ["cluster", "first"], "left")
             .select("doc_id", "cluster", F.pmod(F.xxhash64("first", part), "chunks").alias("chunk")).distinct())
    sorted_ = sets.select("doc_id", "shingles").join(dealt, "doc_id").repartition("cluster", "chunk") \
        .sortWithinPartitions("cluster", "chunk", "doc_id")
    return sorted_.select("cluster", "chunk", "doc_id", "shingles").mapInArrow(_tree_rows, "doc_id long, root long")


SIZED = "4 * least(na, nb) >= 3 * greatest(na, nb)"
# Let c be the number of shingles that the first ones of both sets share, and r the number of a set's other
# shingles, ceil(3n/4) - 1. Of the two, the set whose first shingles end earlier shares at most c + r with the other.
IN_REACH = "7 * (c + (3 * greatest(na, nb) + 3) div 4 - 1) >= 3 * (na + nb)"
# The least that IN_REACH and SIZED ask of any two sets whose sizes lie between low and high.
ANY_IN_REACH = "28 * c >= greatest(12 * least(lowa, lowb) - 9 * greatest(higha, highb), 0) + 7"


def _linked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs `a, b` that link, by their whole sets."""
    of = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"))
    met = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").withColumn("o", F.size(F.array_intersect("sa", "sb")))
    return met.where(4 * F.col("o") >= 3 * (F.size("sa") + F.size("sb") - F.col("o"))).select("a", "b")


def _stars(sets: DataFrame, per: DataFrame) -> DataFrame:
    """Links `a, b` of one member of each component with one member of the largest component of a key."""
    top = F.max(F.struct("members", F.negative("component").alias("c"), "one")).over(Window.partitionBy("key"))
    met = per.withColumn("top", top).where("component != -top.c").select(
        F.col("one.doc_id").alias("a"), F.col("one.n").alias("na"), F.col("top.one.doc_id").alias("b"), F.col("top.one.n").alias("nb"))
    # A pair that fails here only for shingles counted for others is found by `_across`.
    return _linked(sets, met.where(SIZED).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(IN_REACH))


def _several(per: DataFrame) -> DataFrame:
    """The rows of the keys that have two components at least; `per` is dealt by key, so this moves nothing."""
    return per.withColumn("k", F.count("*").over(Window.partitionBy("key"))).where("k > 1").drop("k")


def _by_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The components of each key that has two at least: how many members, their sizes and one of them."""
    return _several(rows.join(comps, "doc_id").repartition("key").groupBy("key", "component").agg(
        F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.min(F.struct("doc_id", "n")).alias("one")))


def _merged(per: DataFrame, known: DataFrame) -> DataFrame:
    """`per` after its components, named by a member, have become those of `known`."""
    named = per.join(known.select(F.col("node").alias("component"), F.col("component").alias("of")), "component", "left")
    return _several(named.withColumn("component", F.coalesce("of", "component")).repartition("key").groupBy("key", "component").agg(
        F.sum("members").alias("members"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("one").alias("one")))


def _candidates(per: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs `a, b` of members of different components that can reach the bound, each once.

    Keys are met component by component: two sets share no more first shingles than their components do.
    """
    side = lambda c: per.select("key", *[F.col(x).alias(f"{x}{c}") for x in ("component", "low", "high")])
    met = side("a").join(side("b"), "key").where("componenta < componentb and 4 * higha >= 3 * lowb and 4 * highb >= 3 * lowa")
    both = met.groupBy("componenta", "componentb").agg(
        F.count("*").alias("c"), *[f(x + y).alias(x + y) for f, x in ((F.min, "low"), (F.max, "high")) for y in "ab"])
    # Sizes are those of a key's members; on the keys that two sets share they are among them.
    of = lambda c: comps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("component").alias(f"component{c}"))
    pairs = both.where(ANY_IN_REACH).join(of("a"), "componenta").join(of("b"), "componentb")
    return pairs.where(f"{SIZED} and {IN_REACH}").select("a", "b").distinct()


def _across(sets: DataFrame, per: DataFrame, comps: DataFrame) -> DataFrame:
    """Links `a, b` between different components: every candidate pair that can reach the bound is compared."""
    return _linked(sets, _candidates(per, comps))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, component_id` of every row.

    Null and empty texts have no shingles and stand alone. Rows that repeat an id are one document (each
    has its own row in the result); a row without an id links with nothing and has a null component.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    screened = shared_keys(rows.where("doc_id is not null").mapInArrow(_screen_rows, KEYS))
    hits = screened.select(F.explode("docs").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("hits"))
    with_hits = rows.join(hits, "doc_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    every = keep_by(with_hits.mapInArrow(_set_rows, SETS), "sets", "doc_id")

    # The sets left; of identical ones each task has sent one.
    sets = every.where("shingles is not null and doc_id is not null").select("doc_id", "n", "shingles")
    total = sets.agg(F.sum("n")).first()[0] or 0
    counted = (sets.select("shingles").mapInArrow(_local_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
               .where(F.col("n") >= max(4, -(-total // HINTS))))
    hints = counted.toArrow()  # at most HINTS rows: their counts add up to `total` at most
    order = np.argsort(hints["key"].to_numpy())
    frequent = spark.sparkContext.broadcast((hints["key"].to_numpy()[order], hints["n"].to_numpy()[order]))
    shared = keep(shared_keys(sets.mapInArrow(_prefix_rows(frequent), KEYS))
                  .select("key", "owner", F.explode("docs").alias("doc_id")), "prefixes")
    clusters = components(shared.select(F.col("owner").alias("a"), F.col("doc_id").alias("b")).where("a != b").distinct())
    light = keep(sets.select("doc_id", "n", F.element_at("shingles", 1).alias("first"))
                 .join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id"), "light")
    roots = keep(_trees(sets, light), "roots")
    weights = light.groupBy("cluster").agg(F.sum("n").alias("w")).where(F.col("w") >= CHUNK_TOKENS)
    large = keep(light.select("doc_id", "n", "cluster").distinct().join(weights, "cluster").select("doc_id", "n"), "large")
    members = large.select("doc_id").distinct()
    found = roots.select("doc_id", F.col("root").alias("component"))
    if not large.isEmpty():
        inner = roots.join(members, "doc_id")
        rooted = large.join(inner.groupBy("doc_id").agg(F.min("root").alias("component")), "doc_id")
        per = keep(_by_component(shared.select("key", "doc_id"), rooted), "met")
        stars = _stars(sets, per)
        edges = keep(inner.select(F.col("doc_id").alias("a"), F.col("root").alias("b")).unionByName(stars).where("a != b"), "links")
        known = components(edges)
        comps = keep(large.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                     .select("doc_id", "n", F.coalesce("component", "doc_id").alias("component")), "components")
        across = _across(sets, _merged(per, known), comps)
        merged = components(edges.unionByName(across))
        found = found.join(members, "doc_id", "left_anti").unionByName(
            merged.select(F.col("node").alias("doc_id"), "component"))
    # Identical sets belong together, whichever of them was compared.
    labelled = every.select("doc_id", "n", "mark").where("doc_id is not null").join(found, "doc_id", "left")
    marks = labelled.where("n > 0").groupBy("mark").agg(F.min("component").alias("root"), F.min("doc_id").alias("least"))
    tops = marks.where("root is not null").groupBy("root").agg(F.min("least").alias("top"))
    marks = marks.join(tops, "root", "left").select("mark", F.coalesce("top", "least").alias("c"))
    labels = labelled.join(marks, "mark", "left").select("doc_id", F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("c"))
    per_id = labels.groupBy("doc_id").agg(F.min("c").alias("component_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles")).join(per_id, "doc_id", "left").select("doc_id", "n_shingles", "component_id")
