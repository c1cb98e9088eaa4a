"""Connected components of a large edge table, by alternating star operations.

Each round hangs every node's larger neighbours on its smallest one, first over all neighbours
and then over the smaller ones only; the number of rounds grows with the logarithm of the longest
path. A round is joins and small aggregates; its result is written to the shared folder, so that
lineage stays short and lost executors cost one round at most. Nothing but two numbers per round
reaches the driver. A node with very many edges makes a skewed join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_shared, write_shared


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the least node reached.

    Direction, repetition and self-loops of edges don't matter; edges with a null end are ignored. ``drop_shared`` deletes
    the table that the result reads.
    """
    x, y = F.col(a), F.col(b)
    cur = write_shared(
        edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges"
    )
    mark = _mark(cur)
    while mark[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # A node that is the least of its neighbourhood keeps no edge; its neighbours point at it.
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = write_shared(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new_mark = _mark(new)
        drop_shared(cur)
        done, cur, mark = new_mark == mark, new, new_mark
        if done:
            break
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out.shared_path = cur.shared_path
    return out


def _mark(edges: DataFrame) -> tuple:
    """Tells one edge set from another: its size and a sum of hashes."""
    h = F.xxhash64("u", "v")
    r = edges.agg(
        F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))
    ).first()
    return r[0], r[1], r[2]
