"""Operators on vectors against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.llm import topk, whitening

VECTORS = "vec_id long, embedding array<double>, label int, uid string, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(5)


def plain_top(rows, k, scale=64):
    """Every query row against every other row, in plain integers."""
    hold = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    code = lambda x: hold(math.floor(scale * x)) if abs(scale * x) < math.inf else hold(int(math.copysign(1 << 70, x)))
    fit = [(i, [code(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(fit):
        if i % 20 == 0:
            others = [(-hold(sum(a * b for a, b in zip(v, w))), j) for m, (j, w) in enumerate(fit) if m != n and len(w) == len(v)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(others)[:k])]
    return sorted(out)


def top(df, k=20):
    got = topk.top_k(df, k=k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()))


def test_topk_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(90)]
    rows += [(None, [1.0] * 4), (100, None), (120, [None, 1.0, 1.0, 1.0]), (140, [math.nan] * 4), (160, [math.inf] * 4), (180, []), (200, [1.0, 2.0]), (220, [3.0])]
    rows += [(0, rows[0][1]), (20, rows[20][1]), (20, rows[20][1]), (40, [0.0] * 4), (-20, [-1.0] * 4)]  # repeated rows and ids
    assert top(table(spark, rows)) == plain_top(rows, 20)
    assert top(table(spark, rows), 3) == plain_top(rows, 3)


def test_topk_with_ties_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_CELLS", 12)
    monkeypatch.setattr(topk, "CANDIDATE_CELLS", 40)
    monkeypatch.setattr(topk, "STEP_SCORES", 16)
    monkeypatch.setattr(topk, "BINS", 5)  # many rounds
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.integers(0, 2, 3).astype(float).tolist()) for i in rng.permutation(400)] + [(20, [1.0, 1.0, 1.0])] * 30
    assert top(table(spark, rows), 7) == plain_top(rows, 7)


@pytest.mark.parametrize("size", [1.0, 1e4, 1e8, 1e16, 1e300, 1.7e308])
def test_topk_of_numbers_of_any_size(spark, size):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.uniform(-1, 1, 3) * size).tolist()) for i in range(70)]
    assert top(table(spark, rows), 5) == plain_top(rows, 5)


def test_topk_of_few_rows(spark):
    assert top(table(spark, [])) == [] and top(table(spark, [(20, [1.0])])) == []
    assert top(table(spark, [(20, [1.0]), (40, [0.5]), (3, [-0.1])])) == [(20, 1, 40, 2048), (20, 2, 3, -448), (40, 1, 20, 2048), (40, 2, 3, -224)]
    assert topk.top_k(table(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") == 1).collect() == [(1, 1, 2, 64 * 128)]


def whitened(df, **more):
    got = whitening.whiten(df, **more)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
    return got.collect()


def check_whitened(got, rows, count=4, scale=256):
    """Against numpy's own eigenvectors, sign by sign; exact where the contract is exact."""
    x = np.floor(scale * np.array([v for _, v in rows])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    v = (fit - total / n).T @ (fit - total / n) / n
    e, q = (a[..., ::-1][..., :count] for a in np.linalg.eigh(v))
    want = (x - total / n) @ q / np.sqrt(e)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    assert len(got) == len(rows) * min(count, x.shape[1])
    assert sorted((r.vec_id or 0, r.component, r.deviation) for r in got) == sorted((i or 0, c + 1, d) for (i, _), d in zip(rows, deviation.tolist()) for c in range(len(e)))
    for c in range(len(e)):
        one = [r for r in got if r.component == c + 1]
        own = np.array(sorted((r.deviation, r.whitened) for r in one))[:, 1]
        other = sorted((a, b) for a, b in zip(deviation.tolist(), want[:, c]))
        sizes = lambda a: np.sort(np.abs(a))
        assert np.allclose(sizes(own), sizes([b for _, b in other]), rtol=1e-9, atol=1e-9)
        assert {r.n for r in one} == {n} and abs(one[0].explained - e[c] / np.trace(v)) < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), (rng.normal(size=6) * [1, 2, 3, 4, 5, 6] + 100).tolist()) for i in range(200)]
    rows += [rows[3]] * 50 + [(7, rows[9][1]), (None, rows[4][1]), (-4, [0.0] * 6), (-5, [-0.001] * 6)]
    odd = [(1, None), (2, [None] * 6), (3, [math.nan] * 6), (4, [math.inf] * 6), (5, []), (6, [1.0, 2.0])]
    check_whitened(whitened(table(spark, rows + odd)), rows)
    check_whitened(whitened(table(spark, [(i, v[:2]) for i, v in rows])), [(i, v[:2]) for i, v in rows])


def test_whitening_of_few_rows(spark):
    assert whitened(table(spark, [])) == [] and whitened(table(spark, [(1, None), (2, [])])) == []
    one = whitened(table(spark, [(1, [0.5, 1.0])] * 3))  # no variance at all
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, 0.0)}
    two = whitened(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])]))  # one direction
    assert sorted((r.vec_id, r.component, abs(r.whitened) if r.whitened is not None else None, r.explained) for r in two if r.component == 1) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    assert {(r.whitened, r.explained) for r in two if r.component == 2} == {(None, 0.0)} and two[0].identity_error < 1e-12


@pytest.mark.parametrize("size", [1e9, 1e16, 1e300])
def test_whitening_of_large_numbers(spark, size):
    rows = [(i, [size * (i % 3), -size * (i % 5), 1.0]) for i in range(40)]
    got = whitened(table(spark, rows))
    assert len(got) == 120 and got[0].identity_error < 1e-9 and (size < 1e10 or {r.deviation for r in got} == {None})


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_components_of_matrices(n):
    rng = np.random.default_rng(n)
    full = rng.normal(size=(n, n))
    cases = [full @ full.T, np.eye(n), np.diag(np.arange(n) % 3 + 1.0), np.zeros((n, n)), np.ones((n, n)), 1e-200 * full @ full.T, np.eye(n) + 1e-12 * full @ full.T]
    cases.append(np.kron(np.eye(n), full @ full.T)[:n * 2, :n * 2])  # every eigenvalue more than once
    for v in cases:
        values, vectors = whitening.components(v, 4)
        size = np.abs(v).max() or 1.0
        assert np.allclose(values / size, np.linalg.eigvalsh(v / size)[::-1][:4], atol=1e-13 * len(v))
        assert np.abs(v / size @ vectors - vectors * (values / size)).max() < 1e-12 * len(v)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
