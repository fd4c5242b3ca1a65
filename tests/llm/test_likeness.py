"""How near the samples' likeness is to the exact generalised Jaccard similarity, and that it is what a direct computation gives."""

import re
from collections import Counter

import numpy as np

from causeway.llm import fingerprints
from causeway.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_bias_and_deviation_of_the_likeness(spark):
    docs = table(spark, SF, "documents")
    texts = [(r.doc_id, r.text or "") for r in docs.orderBy(docs.doc_id.desc()).collect()]
    edited, following = {}, {}
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        m = len(t) // 2
        edited[i], following[i] = t[: len(t) - m] + after[:m], after
    text = dict(texts)
    rows = [r for r in fingerprints.fingerprints_with_edits(docs).collect() if WORD.search(text[r.doc_id])]
    assert len(rows) > 150
    for column, other in (("near_edited", edited), ("near_next", following)):
        truth = np.array([exact(text[r.doc_id], other[r.doc_id]) for r in rows])
        error = np.array([getattr(r, column) for r in rows]) - truth
        expected = np.sqrt((truth * (1 - truth)).mean() / fingerprints.SAMPLES)
        assert abs(error.mean()) < 0.03, (column, error.mean())
        assert error.std() < 1.25 * expected, (column, error.std(), expected)
    assert all(r.near_edited == 1.0 for r in rows if text[r.doc_id] == edited[r.doc_id])
