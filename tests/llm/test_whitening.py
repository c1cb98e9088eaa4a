import math
from fractions import Fraction

import numpy as np
import pytest

from logsluice.llm import whitening as W
from logsluice.llm.queries import QUERIES


def brute_force(rows, count=4):
    """Per row and component; eigenvectors by numpy's own solver, deviations in whole numbers."""
    def whole(v):
        return tuple(math.floor(256 * float(c)) for c in v)

    good = [(i, whole(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({x for _, x in good})
    n, dim = len(listed), len(listed[0])
    sums = [sum(x[d] for x in listed) for d in range(dim)]
    centred = [[Fraction(x[d]) - Fraction(sums[d], n) for d in range(dim)] for x in listed]
    v = np.array([[float(sum(r[a] * r[b] for r in centred) / n) for b in range(dim)] for a in range(dim)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in good:
        y = np.array([float(Fraction(x[d]) - Fraction(sums[d], n)) for d in range(dim)])
        for k in range(min(count, dim)):
            out.setdefault((i, k + 1), []).append((n, sum((n * x[d] - sums[d])**2 for d in range(dim)), y @ u[:, k] / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    assert len(got) == sum(map(len, want.values()))
    for k in range(1, 5):
        mine = [r for r in got if r.component == k]
        if not mine:
            continue
        top = max(mine, key=lambda r: abs(r.whitened))
        sign = np.sign(top.whitened * want[top.vec_id, k][0][2])
        for r in mine:
            n, deviation, whitened, explained = want[r.vec_id, k][0]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened == pytest.approx(sign * whitened, rel=1e-8, abs=1e-8)
            assert r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 7)) @ rng.normal(size=(7, 7)) * 3
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    rows += [(100, rows[3][1]), (3, rows[3][1]), (101, [c + 1e-9 for c in rows[4][1]]), (None, rows[5][1])]  # repeats
    rows += [(200, None), (201, []), (202, [None] * 7), (203, [math.nan] + [0.0] * 6), (204, [math.inf] * 7), (205, [1.0, 2.0]), (206, [-0.0] * 7)]
    want = brute_force([r for r in rows if r[1] is None or len(r[1]) == 7])
    check(W.whiten(frame(spark, rows)).collect(), want)


def test_exact_far_from_the_origin(spark):
    # Squares of the entries exceed 64 bits many times over; centred differences don't.
    rows = [(k, [2.0**44 + a, 2.0**44 - b, c]) for k, (a, b, c) in enumerate([(1, 2, 3), (2, 2, 0), (0, 5, 1), (4, 4, 4), (7, 0, 2)])]
    check(W.whiten(frame(spark, [(i, [float(c) for c in v]) for i, v in rows])).collect(), brute_force(rows))


def test_rank_ends_the_components(spark):
    line = [(k, [k / 4, k / 2, 1.0]) for k in range(6)]
    assert {r.component for r in W.whiten(frame(spark, line)).collect()} == {1}
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert W.whiten(frame(spark, [])).collect() == []


def test_extra_columns_and_floats(spark):
    rows = [(k, v) for k, v in enumerate(np.random.default_rng(1).normal(size=(30, 5)).astype(np.float32).astype(float).tolist())]
    df = frame(spark, rows, "float").selectExpr("*", "'a' AS x", "1 AS component", "2L AS n", "3 AS v")
    check(W.whiten(df).collect(), brute_force(rows))


def test_out_of_range(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0]), (4, [1.0, 4.0])]
    got = W.whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and all(r.deviation is None for r in got if r.vec_id < 3)


def test_factor_and_rotations():
    rng = np.random.default_rng(9)
    for dim, rank in ((1, 1), (2, 2), (9, 4), (64, 64)):
        b = rng.integers(-9, 10, (dim, rank)).astype(float)
        a = b @ b.T
        g = W.pivoted_cholesky(a)
        assert g.shape[1] == np.linalg.matrix_rank(a) and np.allclose(g @ g.T, a)
        h = W.one_sided_jacobi(g)
        inner = h.T @ h
        assert np.abs(inner - np.diag(inner.diagonal())).max() <= 1e-12 * inner.max()
        assert np.allclose(np.sort(inner.diagonal())[::-1], np.linalg.eigvalsh(a)[::-1][:g.shape[1]])


def test_small_eigenvalues_keep_their_digits():
    scales = np.diag([1.0, 1e-3, 1e-6, 1e-9])
    q = np.array([[4., 1, 0, 1], [1, 3, 1, 0], [0, 1, 2, 1], [1, 0, 1, 5]])
    _, e = W.principal(scales @ q @ scales, 1, 4)
    # The product of all is the determinant, which is known exactly.
    assert np.prod(e) == pytest.approx(np.linalg.det(q) * 1e-36, rel=1e-10)


def test_query(spark, sf):
    got = QUERIES["op12_whitening"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(got, brute_force(rows))
