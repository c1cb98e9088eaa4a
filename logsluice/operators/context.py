"""Context around chosen events, and merging of collected, live and fetched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scale import first_per_key

# Which fields tell one running instance from another.
INSTANCE_FIELDS = (
    "type", "context", "namespace", "pod", "container", "path", "pod_uid", "restart_count",
)
RADII = (30, 120, 300, 900)
SHOWN = 500


def instance_key(source) -> Column:
    source = F.col(source) if isinstance(source, str) else source
    parts = [source[n] for n in INSTANCE_FIELDS] + [
        F.coalesce(source["previous"], F.lit(False)).alias("previous")
    ]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def nearby_in_time(events: DataFrame, anchors: DataFrame, radius_s: int) -> DataFrame:
    """Events of any source within ``radius_s`` seconds of each anchor ``(anchor_id, anchor_us)``.

    Time is cut into radius-wide buckets: an anchor looks into three of them, so the join is an
    equi-join on the bucket and never compares every pair.
    """
    span = radius_s * 1_000_000
    bucket = F.floor(F.col("anchor_us") / span)
    near = anchors.select(
        "anchor_id", "anchor_us",
        F.explode(F.sequence(bucket - 1, bucket + 1)).alias("_bucket"),
    )
    return (
        events.withColumn("_bucket", F.floor(F.col("ts_us") / span))
        .join(near, "_bucket")
        .where(F.abs(F.col("ts_us") - F.col("anchor_us")) <= span)
        .drop("_bucket")
    )


def nearby_lines(events: DataFrame, anchors: DataFrame, radius: int, width: int = 64) -> DataFrame:
    """Events of the same instance whose lines overlap ``radius`` lines around each anchor.

    Anchors carry ``anchor_id, instance, anchor_start, anchor_end``; events carry ``instance``.
    Both sides are cut into line buckets; a pair meets in several buckets but is kept only in
    the first one they share.
    """
    lo, hi = F.col("anchor_start") - radius, F.col("anchor_end") + radius

    def bucket(c):
        return F.floor(c / width)

    near = anchors.withColumn("_lo", lo).withColumn("_hi", hi).select(
        "anchor_id", "instance", "_lo", "_hi",
        F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))).alias("_b"),
    )
    d = events.withColumn(
        "_b", F.explode(F.sequence(bucket(F.col("line_start")), bucket(F.col("line_end"))))
    )
    return (
        d.join(near, ["instance", "_b"])
        .where((F.col("line_end") >= F.col("_lo")) & (F.col("line_start") <= F.col("_hi")))
        .where(F.col("_b") == F.greatest(bucket(F.col("line_start")), bucket(F.col("_lo"))))
        .drop("_b", "_lo", "_hi")
    )


def nearest(context: DataFrame, n: int = SHOWN) -> DataFrame:
    """The ``n`` events nearest in time to each anchor, numbered by time and line.

    Spark keeps ``n`` per anchor in every partition before the shuffle.
    """
    by_distance = Window.partitionBy("anchor_id").orderBy(
        F.abs(F.col("ts_us") - F.col("anchor_us")), "ts_us", "line_start", "id"
    )
    by_time = Window.partitionBy("anchor_id").orderBy("ts_us", "line_start", "id")
    return (
        context.withColumn("_d", F.row_number().over(by_distance)).where(F.col("_d") <= n).drop("_d")
        .withColumn("position", F.row_number().over(by_time).cast("bigint"))
    )


def with_fetched(events: DataFrame, fetched: DataFrame, anchor: DataFrame) -> DataFrame:
    """Replace an instance's rows by freshly fetched ones and keep the anchor exactly once.

    ``anchor`` is a single row with the event columns. A fetched row equal to it in time and
    text is the anchor itself.
    """
    a = anchor.select(
        F.col("instance").alias("_ai"), F.col("ts_raw").alias("_at"), F.col("text").alias("_ax")
    )
    others = events.join(a, F.col("instance") == F.col("_ai"), "left_anti")
    same = (F.col("ts_raw").eqNullSafe(F.col("_at"))) & (F.col("text") == F.col("_ax"))
    # Only the first equal row stands for the anchor; further copies are rows of their own.
    twin = fetched.join(a, same, "left_semi").orderBy("line_start", "id").limit(1).select("id")
    return (
        others.unionByName(fetched.join(twin, "id", "left_anti").select(*events.columns))
        .unionByName(anchor.select(*events.columns))
    )


def collected_view(events: DataFrame, tail: DataFrame) -> DataFrame:
    """Union by id; a classified event overrides the tail's copy."""
    both = events.withColumn("_p", F.lit(0)).unionByName(tail.withColumn("_p", F.lit(1)))
    return first_per_key(both, ["id"], F.col("_p")).drop("_p")
