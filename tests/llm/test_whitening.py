"""Whitening beside a direct eigendecomposition, on ordinary, degenerate and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import whitening


def table_of(spark, vectors):
    rows = [(None if i is None else int(i), None if v is None else [None if c is None else float(c) for c in v]) for i, v in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("n", "x", "component", "ids", "at", "size"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def direct(x):
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return c, e[::-1], v[:, ::-1], [int(((r.astype(object) * n - s.astype(object)) ** 2).sum()) for r in x]


def check(rows, x, k, exact_axes=True):
    c, e, v, deviations = direct(x)
    assert len(rows) == len(x) * k
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    got = np.array([[by_id[i][j + 1].whitened for j in range(k)] for i in range(len(x))])
    assert [by_id[i][1].deviation for i in range(len(x))] == deviations and {r.n for r in rows} == {len(x)}
    assert np.allclose([by_id[0][j + 1].explained for j in range(k)], e[:k] / e.sum(), rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    assert np.abs(got.T @ got / len(x) - np.eye(k)).max() < 1e-9
    if exact_axes:
        want = (c @ v[:, :k]) / np.sqrt(e[:k])
        assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-7
    # Whatever turns equal deviations allow: the projections reproduce the part of the table they stand for.
    part = got @ got.T / len(x)
    want = (c @ v[:, :k]) / np.sqrt(e[:k])
    assert np.allclose(part, want @ want.T / len(x), atol=1e-7) or not exact_axes


@pytest.mark.parametrize("d, k", [(6, 4), (6, 32), (48, 5)])
def test_against_an_eigendecomposition(spark, d, k):
    rng = np.random.default_rng(d)
    v = rng.normal(size=(70, d)) * np.linspace(3, 0.3, d) + rng.normal(size=d)
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    rows = whitening.whiten(whitening.whole_numbers(table_of(spark, enumerate(v))), k).collect()
    check(rows, x, min(k, d))


def test_equal_deviations_and_low_rank(spark):
    """Four axes of the same variance, two of none: every copy of the eigenvalue is found, the others are left out."""
    axes = np.eye(6)[:4] * 2.0
    v = np.concatenate([axes, -axes])
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    rows = whitening.whiten(whitening.whole_numbers(table_of(spark, enumerate(v))), 32).collect()
    check(rows, x, 4, exact_axes=False)


def test_converges_before_all_dimensions(spark, monkeypatch):
    """Two strong directions of 200 need few steps; the restart finds nothing greater."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    scales = np.concatenate([[400.0, 90.0], np.geomspace(1e-1, 1e-2, 198)])
    v = rng.normal(size=(260, 200)) * scales @ basis.T
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    passes = []
    total = whitening.Table.total
    monkeypatch.setattr(whitening.Table, "total", lambda self, *a: passes.append(1) or total(self, *a))
    rows = whitening.whiten(whitening.whole_numbers(table_of(spark, enumerate(v))), 2).collect()
    check(rows, x, 2)
    assert len(passes) < 60


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 3))
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan")] * 3), (104, [float("inf")] * 3), (105, [1.0]), (106, [2.0])]
    rows = whitening.whiten(whitening.whole_numbers(table_of(spark, [*enumerate(v), *odd]))).collect()
    check(rows, np.floor(64 * v).astype(np.int64) + 1_000_000, 3)
    repeated = whitening.whiten(whitening.whole_numbers(table_of(spark, [(None, v[0]), (1, v[1]), (1, v[1]), (2, v[2])]))).collect()
    assert sorted(str(r.vec_id) for r in repeated if r.component == 1) == ["1", "1", "2", "None"]
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(whitening.whole_numbers(table_of(spark, few))).collect() == []


def test_numbers_beyond_64_bits(spark):
    wide = [(i, [float(i) * 1e12, 1.0]) for i in range(5)]
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(whitening.whole_numbers(table_of(spark, wide))).collect()
    with pytest.raises(Exception, match="(?i)overflow"):
        whitening.whiten(whitening.whole_numbers(table_of(spark, [(0, [1e30]), (1, [2.0])]))).collect()
    exact = [(i, [float(i) * 1e6, 1.0]) for i in range(5)]  # leaves 64 bits on the way only
    rows = whitening.whiten(whitening.whole_numbers(table_of(spark, exact))).collect()
    assert {r.vec_id: r.deviation for r in rows}[4] == (5 * 4 * 64_000_000 - 10 * 64_000_000) ** 2
