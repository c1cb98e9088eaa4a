"""Learning requests beside a sequential version."""

import random

import pytest
from pyspark.sql import functions as F

from logsluice.operators import learning as N


def sequential(events, min_samples, per_batch):
    """Requests of (key, arrival, batch) events, a batch at a time."""
    levels, count, done, out = [min_samples, 32, 256, 2048], {}, {}, []
    for batch in sorted({b for _, _, b in events}):
        touched = []
        for key, arrival, _ in sorted((e for e in events if e[2] == batch), key=lambda e: e[1]):
            count[key] = count.get(key, 0) + 1
            if key not in [k for k, _ in touched]:
                touched.append((key, arrival))
        used = 0
        for key, first in touched:
            i = done.get(key, 0)
            if i < len(levels) and count[key] >= levels[i] and used < per_batch:
                used += 1
                done[key] = i + 1
                out.append((key, batch, first, count[key], i + 1))
    return sorted(out)


@pytest.mark.parametrize("families,size,wait", ((30, 20, 64), (25, 12, 2), (8, 60, 1), (3, 1, 64)))
def test_requests_of_shared_batches(spark, families, size, wait):
    rng = random.Random(families)
    weights = [1 / (k + 1) for k in range(families)]
    keys = rng.choices([f"f{k}" for k in range(families)], weights, k=1500)
    events = [(k, n, n // size) for n, k in enumerate(keys)]
    df = spark.createDataFrame(events, "template_key string, arrival long, batch long").withColumns({
        "text": F.lit("INFO fine"), "truncated": F.lit(False), "sensitive": F.lit(False), "parse_uncertain": F.lit(False),
    }).repartition(3)
    want = sequential(events, 4, 2)
    got = sorted(tuple(r) for r in N.learning_requests(df, 4, wait=wait).collect())
    assert got == want
    assert (sequential(events, 4, 10 ** 6) != want) == (size > 1)  # the limit binds


def test_events_that_may_not_teach(spark):
    rows = [("a", n, 0, n % 2 == 0) for n in range(10)]
    df = spark.createDataFrame(rows, "template_key string, arrival long, batch long, truncated boolean").withColumns({
        "text": F.lit("INFO fine"), "sensitive": F.lit(False), "parse_uncertain": F.lit(False),
    })
    assert [tuple(r) for r in N.learning_requests(df, 5).collect()] == [("a", 0, 1, 5, 1)]
    assert N.learning_requests(df.where("arrival < 3"), 2).collect() == []
    with pytest.raises(ValueError):
        N.learning_requests(df, 1)
