"""Ranked search beside a direct computation."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def direct(docs, items, k=50):
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for doc, c, n in counts:
            m = 50 + (50 * n * n_docs) // length if n else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["Alpha", "beta", "ÉTÉ", "x9", "日本", "gamma", "delta", "rare", "a", "of", "the", "und"]
    docs = [(i, " ".join(rng.choices(words, range(1, 13), k=rng.randrange(1, 40)))) for i in range(300)]
    docs += [(i, t) for i, t in docs[:20]] + [(500, docs[0][1]), (501, docs[0][1]), (502, None), (503, ""), (504, "--- \x00 !"), (None, "alpha rare rare"),
                                             (505, "the " * 40_000 + "alpha"), (506, "un_der-score@Beta\x7fgamma")]
    items = [(1, "alpha BETA été"), (2, "the the of"), (3, None), (4, ""), (5, "!?"), (6, "unknown words"), (1, "gamma"), (1, "gamma"), (None, "rare"),
             (7, " ".join(words) + " " + " ".join(f"w{i}" for i in range(200)))]
    return docs, items


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    for name in ("n", "terms", "item", "score", "term", "rank"):
        d, i = d.withColumn(name, F.lit("clash")), i.withColumn(name, F.lit("clash"))
    return d, i


@pytest.mark.parametrize("block", [None, 16])
def test_search(spark, corpus, monkeypatch, block):
    if block:
        monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    d, i = tables(spark, *corpus)
    got = Counter(tuple(r) for r in lexical.search(d, i).collect())
    assert got == direct(*corpus)
    assert Counter(tuple(r) for r in lexical.search(d, i, 3).collect()) == direct(*corpus, 3)


def test_empty_tables(spark, corpus):
    d, i = tables(spark, *corpus)
    assert lexical.search(d.where("false"), i).collect() == []
    assert lexical.search(d, i.where("false")).collect() == []
    assert lexical.search(d.where("doc_id in (502, 503, 504)"), i).collect() == []


def test_groups_out_of_reach_are_not_evaluated(monkeypatch):
    """Few documents hold both rare terms; once k of them are known, the masks without are never scored."""
    rng = np.random.default_rng(0)
    n = 5000
    lists = [[0, 1, 2] if i < 60 else [2] for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "n": pa.array(rng.integers(3, 9, n), pa.int64()),
                                        "terms": pa.array(lists, pa.list_(pa.int32())), "tfs": pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))})
    block = lexical.Block([batch], np.array([9000, 8000, 10]), n, 6 * n)
    scored = []
    scores = lexical.Block.scores
    monkeypatch.setattr(lexical.Block, "scores", lambda self, item, rows: scored.append(len(rows)) or scores(self, item, rows))
    none = np.zeros(0, np.int64)
    ids, values = lexical.search_block(block, [0, 1, 2], none, none, 50)
    assert sum(scored) == 60 and len(ids) == 50 and (np.diff(values) <= 0).all()
    rows, bounds, ends = block.groups([0, 1, 2])
    assert len(bounds) == 2 and ends.tolist() == [60, n] and sorted(rows.tolist()) == list(range(n))
    # Bounds hold for every document of their group.
    every = scores(block, [0, 1, 2], rows)
    assert (every[:60] <= bounds[0]).all() and (every[60:] <= bounds[1]).all()


def test_masks_of_more_than_64_terms():
    lists = [[0, 70, 199], [70], [], [0, 70, 199]]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3, 4], pa.int64()), "n": pa.array([3, 1, 1, 3], pa.int64()),
                                        "terms": pa.array(lists, pa.list_(pa.int32())), "tfs": pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))})
    block = lexical.Block([batch], np.ones(200, np.int64), 4, 8)
    masks = block.masks(list(range(200)))
    assert masks.shape == (4, 4) and (masks[0] == masks[3]).all() and masks[2].sum() == 0
    assert [int(masks[0][w]) >> b & 1 for w, b in ((0, 0), (1, 6), (3, 7))] == [1, 1, 1]
