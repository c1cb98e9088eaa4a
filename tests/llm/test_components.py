import random

from logsluice.llm.components import connected_components
from helpers import rows_of, union_find


def test_random_graphs_and_a_long_path(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 600)]
    pairs += [(700, k) for k in range(701, 760)] + [(5, 5), (5, 5)]
    got = dict(rows_of(connected_components(spark.createDataFrame(pairs, "a long, b long"))))
    want = union_find(800, pairs)
    assert got == {n: c for n, c in enumerate(want) if any(n in p and p[0] != p[1] for p in pairs)}


def test_no_edges_and_null_ends(spark):
    assert rows_of(connected_components(spark.createDataFrame([], "a long, b long"))) == []
    assert rows_of(connected_components(spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long"))) == []
