import math

import numpy as np
import pytest

from logsluice.llm import embeddings as E
from helpers import rows_of, union_find


def brute(rows, threshold=0.9):
    ok = [k for k, (_, v) in enumerate(rows) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    n, pairs = [0] * len(rows), []
    for x, a in enumerate(ok):
        for b in ok[x + 1:]:
            u, w = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (a, b))
            if len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= threshold:
                n[a] += 1
                n[b] += 1
                pairs.append((a, b))
    comp = union_find(len(rows), pairs)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[k] and rows[j][0] is not None]
        c = i if k not in ok else min(ids, default=None)
        out.append((i, n[k], c, i is not None and i == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell_rows,pivots", [(4096, 1024), (8, 1024), (8, 2), (3, 40)])
def test_against_all_pairs(spark, cell_rows, pivots):
    rng = np.random.default_rng(cell_rows + pivots)
    base = rng.standard_normal((12, 16))
    rows = []
    for k in range(150):
        v = base[0 if k % 3 else k % 12] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.3, 0.45])
        rows.append((int(k), [float(x) for x in v * rng.choice([1, 1e-3, 1e4])]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(E.link_components(df, cell_rows=cell_rows, pivots=pivots, sample=64)) == brute(rows)


def test_odd_vectors_lengths_and_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [-0.0, 5.0]),
        (9, [0.0, 5.0]), (10, [nan, 1.0]), (11, [inf, 1.0]), (12, [None, 1.0]), (None, [1.0, 0.05]), (None, None), (2, [1.0, 0.1]),
        (14, [-1.0, 0.0]), (15, [1e300, 0.0]), (16, [5e-324, 0.0]), (None, [0.0, -1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(E.link_components(df)) == brute(rows)
    assert rows_of(E.link_components(df, cell_rows=1, sample=2)) == brute(rows)


def test_nothing_to_link(spark):
    assert rows_of(E.link_components(spark.createDataFrame([], "vec_id long, embedding array<float>"))) == []
    nulls = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert rows_of(E.link_components(nulls)) == [(1, 0, 1, True), (2, 0, 2, True)]
