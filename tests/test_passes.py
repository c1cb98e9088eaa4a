"""Costly inputs are dealt over the cores and built once; short sources share a group."""

from pyspark.sql import functions as F, types as T

from logsluice.functions.classify import Policy
from logsluice.operators import dossier as D, incidents as I, learning as N
from logsluice.plans import adapters as A
from logsluice.sources import lines as L
from logsluice.streaming import framing as SF


def _counted(spark, column):
    """(the column through a function that counts its calls, the counter)"""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return F.udf(same, T.StringType())(column), calls


def test_rows_of_one_file_are_dealt_over_all_cores(spark, tmp_path):
    spark.range(400).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    dealt = A.dealt(spark.read.parquet(f"{tmp_path}/t.parquet")).where("id >= 0")
    parts = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in parts) == 400


def test_events_are_folded_from_one_pass(spark):
    decision, calls = _counted(spark, F.lit("notify"))
    ev = spark.range(60).select(
        F.lit("k").alias("incident_key"), (F.col("id") % 7).alias("ts_s"), F.col("id").alias("arrival"), decision.alias("decision")
    )
    assert I.fold_incidents(ev, Policy()).where("enqueued").count() > 0
    assert calls.value <= 120  # a filter and a projection of one pass


def test_evidence_and_dossiers_build_keys_once(spark):
    key, calls = _counted(spark, F.col("id").cast("string"))
    ev = spark.range(40).select(
        key.alias("template_key"), F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("text"), F.col("id").alias("arrival"),
        F.struct(F.lit("x").alias("importance")).alias("judgment"),
    ).withColumn("eligible", F.lit(True))
    assert N.template_evidence(ev).count() == 40
    assert calls.value <= 40
    key, calls = _counted(spark, F.concat(F.lit("e"), F.col("id").cast("string")))
    ev = spark.range(40).select(
        F.lit(0).cast("bigint").alias("batch"), F.col("id").alias("arrival"), key.alias("id"), F.lit("s").alias("source_id"),
        F.lit("k").alias("template_key"), F.lit("v").alias("version_id"), F.struct(F.lit("file").alias("type")).alias("source"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.struct(F.lit(False).alias("important")).alias("baseline"),
        F.lit(False).alias("truncated"), F.lit(False).alias("sensitive"), F.lit(False).alias("parse_uncertain"),
    ).withColumn("template_key", F.when(F.col("id") != "", F.col("template_key")))
    got = D.dossiers(ev).collect()
    assert [(r.window_occurrences, len(r.samples), r.evidence_id) for r in got] == [(40, 8, "e0")]


def test_repeated_lines_move_once(spark):
    rows = [(f, s, t, r, n) for f in (1, 2, 3) for s, t, r, n in (
        ("a", 1, "x", 1), ("a", 1, "x", 2), (None, 1, "x", 3), ("a", 2, None, 4), ("a", None, "x", 5)) if (f, n) != (1, 2)]
    df = spark.createDataFrame(rows, "fetch bigint, source_id string, ts_us bigint, raw string, line_no bigint")
    out = L.dedupe_overlapping_fetches(df)
    got = sorted((r.fetch, r.line_no) for r in out.collect())
    by_block = sorted((r.fetch, r.line_no) for r in L._fresh_by_block(df.where("ts_us IS NOT NULL")).collect())
    assert got == sorted(by_block + [(1, 5), (2, 5), (3, 5)])
    assert by_block == [(1, 1), (1, 3), (1, 4), (2, 2)]


def test_short_sources_share_a_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SF, "GROUPS", 1)
    source = A.source_struct(type="file", path=F.concat(F.lit("p"), (F.col("id") % 30).cast("string")))
    lines = spark.range(90).select(
        source.alias("source"), (F.floor(F.col("id") / 30) + 1).cast("bigint").alias("line_no"),
        F.when(F.col("id") < 30, "ERROR a").otherwise("    at b.c(D.java:1)").alias("raw"), F.lit(False).alias("eof"),
    )
    ends = spark.range(30).select(source.alias("source"), F.lit(4).cast("bigint").alias("line_no"), F.lit("").alias("raw"), F.lit(True).alias("eof"))
    from logsluice.streaming import live as LV

    parts = [lines.where("line_no < 3"), lines.where("line_no = 3").unionByName(ends)]
    LV.drain_parts(parts, lambda d: SF.frame_stream(d, with_json=False), LV.table_sink(f"{tmp_path}/out"), 2)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.source.path for r in got) == sorted(f"p{i}" for i in range(30))
    assert {(r.line_start, r.line_end, r.line_count) for r in got} == {(1, 3, 3)}


def test_trace_lines_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Repeated items are one line, repeated orders are lines of their own, keys may be missing; no task takes all."""
    orders = [(k, k % 5) for k in range(400)] + [(7, 3), (None, 1)]
    items = [(k, n) for k in range(410) for n in range(1, 1 + k % 4)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items + items[:200] + [(None, 1), (3, None)], "l_orderkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(A, "ROWS_PER_TASK", 20, raising=False)
    lines = A.trace_lines(spark, str(tmp_path))
    got = sorted(lines.select("source.path", F.coalesce("line_no", F.lit(-1))).collect())
    heads = [(f"orders/{c}", -1 if k is None else k * 8 + 1) for k, c in orders]
    frames = [(f"orders/{c}", k * 8 + n + 1) for k, c in orders for m, n in items if m == k]
    assert got == sorted(heads + frames + [("orders/3", -1)])
    sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 40 and max(sizes) <= 100
