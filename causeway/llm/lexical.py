"""Ranked lexical search of all documents for a list of items, by presence masks.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.
The first pass writes, per document with any term, its length and the counts of the terms that the items
hold (`postings`); number of documents, total length and document frequencies are aggregated from it. The
second pass goes through that table in blocks. For an item, each of its terms has a bitmap over the block's
documents; the bitmaps transposed give every document the mask of the terms it holds, and equal masks form
a group. A mask's bound is the sum of its terms' largest contributions in the block. Groups are evaluated by
falling bound, from few documents to more, until the next bound is below the score of rank k that the task
has reached so far; a bound that equals it is still evaluated, as ties fall to the smaller id. A task hands on
k documents per item, and a window keeps the k best of all tasks.

Items are taken in blocks of bounded size (`BLOCK_TERMS`, `BLOCK_BYTES`), each searched against all documents;
what is sent to tasks is one block's distinct terms and, per item, their numbers. A bigger list of items means
more blocks, never bigger ones; one item alone larger than a block forms one.

Null and empty texts hold no terms: such documents count nowhere, such items have no rows. Documents are
rows: repeated rows are ranked side by side. Rows without an id rank after all others of equal score. Equal
rows of items count once; rows of one item id with different texts are ranked apart. Very long texts are
cut into terms whole. Tables without rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import filled, keep, slices, words

BLOCK_TERMS = 1 << 17
BLOCK_BYTES = 4 << 20
BLOCK_DOCUMENTS = 1 << 15
BLOCK_POSTINGS = 1 << 22
BLOCK_BITS = 1 << 24  # documents of a block by terms of an item
LAST = np.iinfo(np.int64).max  # stands for a missing id

CODES = np.arange(256, dtype=np.uint8)
CODES[ord("A") : ord("Z") + 1] += 32
CODES[[c for c in range(128) if not chr(c).isalnum()]] = ord(" ")


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts in one array, and where each text's terms start (one entry more than texts)."""
    texts = filled(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(CODES[data]))
    return words(plain)


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Lists of (item_id, distinct terms); each list is bounded, the item table need not be."""
    block, size, width = [], 0, 0
    for row in items.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        own = sorted(set(terms(pa.array([row.text]))[0].to_pylist()))
        more = sum(map(len, own))
        if block and (size + len(own) > BLOCK_TERMS or width + more > BLOCK_BYTES):
            yield block
            block, size, width = [], 0, 0
        if own and (row.item_id, own) not in block[-1:]:
            block.append((row.item_id, own))
            size, width = size + len(own), width + more
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """`doc_id, n, terms, tfs` of every document with a term: its length, the vocabulary's terms in it, their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        for batch in slices(batches):
            flat, ends = terms(batch.column("text"))
            n = np.diff(ends)
            at = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy()
            rows = np.repeat(np.arange(len(n)), n)
            pair, tf = np.unique(rows[at >= 0] * len(vocabulary) + at[at >= 0], return_counts=True)
            upto = np.searchsorted(pair, np.arange(len(n) + 1) * len(vocabulary))
            offsets = pa.array(upto, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair % len(vocabulary), tf)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """Postings of a bounded number of documents, term by term."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, documents: int, length: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        lists, tfs = table.column("terms").chunk(0), table.column("tfs").chunk(0)
        self.ids = table.column("doc_id").fill_null(LAST).to_numpy()
        held = np.diff(lists.offsets.to_numpy())
        rows = np.repeat(np.arange(len(held)), held)
        term = lists.flatten().to_numpy()
        tf = tfs.flatten().to_numpy().astype(np.int64)
        m = 100 - 50 + (50 * table.column("n").to_numpy() * documents) // length
        value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[rows]))
        order = np.argsort(term, kind="stable")
        self.rows, self.values = rows[order], value[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        np.maximum.at(self.most, term, value)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.starts[term + 1])
        return self.rows[part], self.values[part]

    def masks(self, item: list[int]) -> np.ndarray:
        """Per document the presence mask of the item's terms, as rows of 64-bit words."""
        bits = np.zeros((-(-len(item) // 64) * 64, len(self.ids)), bool)
        for i, t in enumerate(item):
            bits[i, self.of(t)[0]] = True
        packed = np.packbits(bits, axis=0, bitorder="little")  # eight bitmaps to a byte of each document
        return np.ascontiguousarray(packed.T).view(np.uint64)

    def groups(self, item: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents ordered by the falling bound of their mask; the bound of each group and where it ends."""
        masks = self.masks(item)
        rows = np.flatnonzero(masks.any(axis=1))
        rows = rows[np.lexsort(masks[rows].T)]
        first = np.flatnonzero(np.concatenate([[True], (masks[rows[1:]] != masks[rows[:-1]]).any(axis=1)])) if len(rows) else rows
        distinct = np.unpackbits(masks[rows[first]].view(np.uint8), axis=1, bitorder="little")[:, : len(item)]
        bound = distinct.astype(np.int64) @ self.most[item]
        sizes = np.diff(np.append(first, len(rows)))
        order = np.argsort(-bound, kind="stable")
        starts, sizes = first[order], sizes[order]
        ends = np.cumsum(sizes)
        return rows[np.repeat(starts - (ends - sizes), sizes) + np.arange(len(rows))], bound[order], ends

    def scores(self, item: list[int], rows: np.ndarray) -> np.ndarray:
        rows_in_order = np.sort(rows)
        total = np.zeros(len(rows), np.int64)
        for t in item:
            have, value = self.of(t)
            at = np.searchsorted(have, rows_in_order)
            hit = at < len(have)
            hit[hit] = have[at[hit]] == rows_in_order[hit]
            total[hit] += value[at[hit]]
        return total[np.searchsorted(rows_in_order, rows)]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    order = order[scores[order] > 0]
    return ids[order], scores[order]


def search_block(block: Block, item: list[int], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of those found before and of the block's documents."""
    rows, bounds, ends = block.groups(item)
    done, group, chunk = 0, 0, k
    while group < len(bounds) and (len(scores) < k or bounds[group] >= scores[-1]):
        # As many whole groups as hold about `chunk` documents, none of a bound that is out of reach.
        stop = int(np.searchsorted(ends, done + chunk)) + 1
        if len(scores) == k:
            stop = min(stop, int(np.searchsorted(-bounds, -scores[-1], "right")))
        stop = max(min(stop, len(bounds)), group + 1)
        some = rows[done : ends[stop - 1]]
        ids, scores = best(np.concatenate([ids, block.ids[some]]), np.concatenate([scores, block.scores(item, some)]), k)
        done, group, chunk = int(ends[stop - 1]), stop, chunk * 2
    return ids, scores


def _search(items: list[tuple[int | None, list[int]]], weights: np.ndarray, documents: int, length: int, k: int, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(items)
        waiting, docs, held = [], 0, 0
        most = max(1, min(BLOCK_DOCUMENTS, BLOCK_BITS // max(len(own) for _, own in items)))

        def work():
            block = Block(waiting, weights, documents, length)
            for i, (_, own) in enumerate(items):
                found[i] = search_block(block, own, *found[i], k)

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                more = len(part.column("terms").flatten())
                if waiting and (docs + part.num_rows > most or held + more > BLOCK_POSTINGS):
                    work()
                    waiting, docs, held = [], 0, 0
                waiting.append(part)
                docs, held = docs + part.num_rows, held + more
        if waiting:
            work()
        for i, (item_id, _) in enumerate(items):
            ids, scores = found[i]
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number + i] * len(ids), pa.int64()), pa.array([item_id] * len(ids), pa.int64()),
                     pa.array(ids, pa.int64(), mask=ids == LAST), pa.array(scores, pa.int64())], ["item", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """`item_id, rank, doc_id, score` of the k documents of highest score above 0 for each item."""
    spark, out, number = docs.sparkSession, None, 0
    schema = "item long, item_id long, doc_id long, score long"
    for block in blocks(items):
        vocabulary = sorted({t for _, own in block for t in own})
        place = {t: i for i, t in enumerate(vocabulary)}
        held = keep(postings(docs, vocabulary), "postings")
        documents, length = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(held.select(F.explode("terms")).groupBy("col").count().collect())  # at most one row per term of the block
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        numbered = [(item_id, [place[t] for t in own]) for item_id, own in block]
        found = held.mapInArrow(_search(numbered, weights, documents, length, k, number), schema)
        out, number = found if out is None else out.unionByName(found), number + len(block)
    if out is None:
        out = spark.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
