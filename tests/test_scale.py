"""Blocks that depend on all blocks before them, beside loops."""

import random

import pytest
from pyspark.sql import functions as F

from logsluice.operators import framing as W, scale


@pytest.mark.parametrize("fan_out", (2, 3, 512))
def test_functions_compose_in_order(spark, monkeypatch, fan_out):
    monkeypatch.setattr(scale, "FUNCTIONS", fan_out)
    rng = random.Random(fan_out)
    rows = [(key, 3 * i + (i > 20), [rng.randrange(5) for _ in range(5)]) for key in "ab" for i in range(40 if key == "a" else 1)]
    codes = [(k, i, sum(x << 3 * s for s, x in enumerate(f))) for k, i, f in rows]
    df = spark.createDataFrame(codes, "key string, block long, code long").repartition(4)
    got = {(r.key, r.block): [r.code >> 3 * s & 7 for s in range(5)] for r in scale.composed_before(df, ["key"], "block", "code", 5).collect()}
    want = {}
    for key in "ab":
        now = list(range(5))
        for k, i, f in rows:
            if k == key:
                want[k, i] = now
                now = [f[x] for x in now]
    assert got == want


@pytest.mark.parametrize("stretch", (1, 3, 4096))
def test_sums_and_last_values(spark, monkeypatch, stretch):
    monkeypatch.setattr(scale, "BLOCKS_PER_WINDOW", stretch)
    rng = random.Random(stretch)
    rows = [(k, b, rng.randrange(9), rng.choice((None, None, f"v{b}"))) for k in "xy" for b in sorted(rng.sample(range(60), 25))]
    df = spark.createDataFrame(rows, "key string, block long, n long, v string").repartition(3)
    got = {(r.key, r.block): (r.total, r["last"]) for r in scale.over_earlier_blocks(
        df, ["key"], "block", {"total": ("sum", F.col("n")), "last": ("last", F.col("v"))}).collect()}
    want = {}
    for k, b, _, _ in rows:
        before = [r for r in rows if r[0] == k and r[1] < b]
        want[k, b] = (sum(r[2] for r in before), next((r[3] for r in reversed(before) if r[3]), None))
    assert got == want


def test_a_million_lines_without_a_header(spark):
    """One event of a million lines in one source: no list grows with it, and its entry states are known."""
    n = 1_000_000
    lines = spark.range(n).select(
        F.struct(*[(F.lit("file") if f.name == "type" else F.lit("one") if f.name == "path" else F.lit(None)).cast(f.dataType).alias(f.name)
                   for f in W.S.SOURCE.fields]).alias("source"),
        (F.col("id") + 1).alias("line_no"),
        F.when(F.col("id") == 0, "ERROR failed").when(F.col("id") == n - 1, "INFO next").otherwise("    at a.b(C.java:1)").alias("raw"),
    )
    rows = W.frame_events(lines, with_json=False).select("line_start", "line_end", "line_count", "truncated").collect()
    assert sorted(map(tuple, rows)) == [(1, n - 1, n - 1, True), (n, n, 1, False)]


def test_text_is_dealt_by_its_size(spark, monkeypatch):
    """More lines give more tasks for the sorted text, not larger ones, and the same events."""
    path = F.when(F.col("id") < 2001, "one").otherwise("two")
    lines = spark.range(4000).select(
        F.struct(*[(F.lit("file") if f.name == "type" else path if f.name == "path" else F.lit(None)).cast(f.dataType).alias(f.name)
                   for f in W.S.SOURCE.fields]).alias("source"),
        (F.col("id") + 1).alias("line_no"), F.when(F.col("id") % 3 == 0, "ERROR failed").otherwise("    at a.b(C.java:1)").alias("raw"),
    )
    monkeypatch.setattr(W, "LINES_PER_BLOCK", 20)
    monkeypatch.setattr(W, "BYTES_PER_TASK", 20_000, raising=False)
    marked, assemble = [], W.assemble
    monkeypatch.setattr(W, "assemble", lambda d: marked.append(d) or assemble(d))
    rows = W.frame_events(lines, with_json=False).select("line_start", "line_count").collect()
    assert sorted(map(tuple, rows)) == [(i, min(3, 4001 - i)) for i in range(1, 4001, 3)]
    sizes = [r["count"] for r in marked[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 30 and max(sizes) <= 400


def test_lines_far_apart_share_blocks(spark, monkeypatch):
    """Sources that take turns have few blocks, a dense one keeps its own, and only events that cross blocks move twice."""
    n = F.col("id")
    path = F.when(n < 4000, F.concat(F.lit("p"), (n % 40).cast("string"))).otherwise("dense")
    lines = spark.range(5000).select(
        F.struct(*[(F.lit("file") if f.name == "type" else path if f.name == "path" else F.lit(None)).cast(f.dataType).alias(f.name)
                   for f in W.S.SOURCE.fields]).alias("source"),
        (n + 1).alias("line_no"),
        F.when(F.floor(n / 40) % 7 == 0, "ERROR failed").when(n % 1111 == 5, "-----BEGIN PRIVATE KEY-----").when(n % 1111 == 400, "-----END PRIVATE KEY-----")
        .when(n % 13 == 0, "").otherwise("    at a.b(C.java:1)").alias("raw"),
    )
    pick = ["id", "source_id", "text", "line_start", "line_end", "line_count", "sensitive", "parse_uncertain"]
    want = sorted(map(tuple, W.frame_events(lines, with_json=False).select(pick).collect()))
    monkeypatch.setattr(W, "LINES_PER_BLOCK", 50)
    monkeypatch.setattr(W, "OWN_WIDTHS", 1, raising=False)
    seen, mark = [], W.mark_events
    monkeypatch.setattr(W, "mark_events", lambda d, blocks, *more: seen.append(blocks) or seen.append(mark(d, blocks, *more)) or seen[1])
    assert sorted(map(tuple, W.frame_events(lines, with_json=False).select(pick).collect())) == want and len(want) > 500
    assert seen[0].count() <= 300
    whole, lines = seen[1].agg(F.count_if("whole"), F.count(F.lit(1))).first()
    assert lines / 2 < whole < lines


def test_task_count(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(1)
    assert [scale.task_count(df, n, 10) for n in (None, 0, 1, 10 * cores, 10 * cores + 1, 10_000)] == [cores] * 4 + [cores + 1, 1000]
