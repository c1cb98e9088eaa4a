"""Order-dependent building blocks that never need a whole key in one task.

An order column is cut into blocks (a plain function of the row, so retries agree). Work
inside a block is a window over at most one block; what crosses blocks is a summary with one
row per block. A key that owns a third of all rows is thereby spread over all its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

BLOCK = "_block"
LINES_PER_BLOCK = 8192
ROWS_PER_BLOCK = 65536


def with_block(df: DataFrame, order: str, size: int, name: str = BLOCK) -> DataFrame:
    # Never NULL, for the reason given at ``text._never_null``.
    return df.withColumn(name, F.coalesce(F.floor(F.col(order) / F.lit(size)).cast("bigint"), F.lit(0)))


def task_count(df: DataFrame, amount: int | None, per_task: int) -> int:
    """Tasks among which ``amount`` rows or bytes are dealt: about ``per_task`` for each, and one per core at least.

    For ``repartition``, whose number stands: Spark's own choice goes by packed bytes, and alike rows pack to a few bytes each.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(amount or 0) // per_task))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, whose rows are unique by ``keys``; a null key meets
    a null key.

    Columns that can't be null keep the plain equality, which leaves a partitioning by them usable.
    """
    loose = [k for k in keys if left.schema[k].nullable and right.schema[k].nullable]
    if not loose:
        return left.join(right, list(keys))
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    met = [
        left[k].eqNullSafe(renamed[f"_right_{k}"]) if k in loose else left[k] == renamed[f"_right_{k}"] for k in keys
    ]
    on = met[0]
    for m in met[1:]:
        on = on & m
    return left.join(renamed, on).drop(*[f"_right_{k}" for k in keys])


#: Blocks whose totals one window takes; beyond that totals of totals carry the rest.
BLOCKS_PER_WINDOW = 4096


def _before_block(totals: DataFrame, keys: Sequence[str], block: str, fold: Callable[[str], Column], start) -> DataFrame:
    """``_off``: ``fold`` of ``_t`` over all earlier blocks of the key (``start`` without any).

    Two levels where there is no key to spread the blocks by.
    """
    def earlier(by, order):
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    if keys:
        return totals.withColumn("_off", F.coalesce(fold("_t").over(earlier(keys, block)), start)).drop("_t")
    t = totals.withColumn("_far", F.floor(F.col(block) / BLOCKS_PER_WINDOW))
    far = t.groupBy("_far").agg(fold("_t").alias("_t")).withColumn("_before", fold("_t").over(earlier([], "_far"))).drop("_t")
    near = t.withColumn("_near", fold("_t").over(earlier(["_far"], block))).join(far, "_far")
    both = F.array_compact(F.array("_before", "_near"))
    merged = F.aggregate(both, start.cast("bigint"), lambda a, x: a + x) if fold is F.sum else F.array_max(both)
    return near.withColumn("_off", merged).select(block, "_off")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    block: str = BLOCK,
) -> DataFrame:
    """Inclusive prefix sum of a BIGINT ``value`` per key in ``order``.

    ``block`` must be a non-decreasing function of the first order column.
    """
    rows = df.withColumn("_v", value)
    inside = (
        Window.partitionBy(*keys, block).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = _before_block(rows.groupBy(*keys, block).agg(F.sum("_v").alias("_t")), keys, block, F.sum, F.lit(0))
    return (
        join_keys(rows.withColumn("_in", F.sum("_v").over(inside)), totals, [*keys, block])
        .withColumn(out, F.col("_in") + F.col("_off"))
        .drop("_v", "_in", "_off")
    )


def running_rank(df, keys, order, out, block=BLOCK) -> DataFrame:
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out, block)


def preceding_max(df, keys, order, value: Column, out: str, block: str = BLOCK) -> DataFrame:
    """Largest ``value`` on strictly earlier rows of the key, NULL on the first."""
    rows = df.withColumn("_v", value)
    inside = (
        Window.partitionBy(*keys, block).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    peaks = _before_block(
        rows.groupBy(*keys, block).agg(F.max("_v").alias("_t")), keys, block, F.max, F.lit(None)
    )
    return (
        join_keys(rows.withColumn("_in", F.max("_v").over(inside)), peaks, [*keys, block])
        .withColumn(out, F.greatest("_in", "_off"))
        .drop("_v", "_in", "_off")
    )


def over_earlier_blocks(blocks: DataFrame, keys: Sequence[str], block: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """(keys, block, and per name what the earlier blocks of the key hold): a ``sum``, or the ``last`` value that is not null.

    ``blocks`` has one row per key and block. Windows span ``BLOCKS_PER_WINDOW`` blocks at most, then one row for each
    such stretch, so a key may have any number of blocks.
    """
    keys = list(keys)
    rows = blocks.select(*keys, block, F.floor(F.col(block) / BLOCKS_PER_WINDOW).alias("_far"), *[
        (v if how == "sum" else F.when(v.isNotNull(), F.struct(F.col(block).alias("b"), v.alias("v")))).alias(n)
        for n, (how, v) in values.items()
    ])
    fold = {n: F.sum(n) if how == "sum" else F.max(n) for n, (how, _) in values.items()}

    def earlier(by, order):
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    far = rows.groupBy(*keys, "_far").agg(*[f.alias(n) for n, f in fold.items()])
    far = far.select(*keys, "_far", *[f.over(earlier(keys, "_far")).alias(f"_far_{n}") for n, f in fold.items()])
    near = rows.select(*keys, block, "_far", *[f.over(earlier([*keys, "_far"], block)).alias(n) for n, f in fold.items()])
    both = near.join(far, [*keys, "_far"])
    return both.select(*keys, block, *[
        (F.coalesce(n, F.lit(0)) + F.coalesce(f"_far_{n}", F.lit(0)) if how == "sum" else F.coalesce(n, f"_far_{n}")["v"]).alias(n)
        for n, (how, _) in values.items()
    ])


#: Rows of a group up to which one window takes it whole.
WIDE = ROWS_PER_BLOCK


def split_wide(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups that a window can take, rows of larger groups; None if there are none). Keys must not be null.

    Groups are counted, and only the keys of large ones are written.
    """
    large = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > WIDE).select(*keys), "wide-groups")
    if not large.limit(1).count():
        return df, None
    return df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi")


def numbered(df: DataFrame, keys: Sequence[str], order: str, carry: Sequence[str]) -> DataFrame:
    """Add ``_n``, the place of a row in its group from 1, and ``_prev``, a struct of the columns ``carry`` of the row before it.

    Groups that are too large for a window are taken block by block.
    """
    def inside(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order)
        return rows.withColumns({"_n": F.row_number().over(w).cast("bigint"), "_prev": F.lag(F.struct(*carry)).over(w)})

    small, large = split_wide(df, keys)
    out = inside(small, keys)
    if large is None:
        return out
    by = [*keys, BLOCK]
    some = inside(with_block(large, order, WIDE), by)
    blocks = some.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"), F.max_by(F.struct(*carry), order).alias("_l"))
    before = over_earlier_blocks(blocks, keys, BLOCK, {"_before": ("sum", F.col("_c")), "_carried": ("last", F.col("_l"))})
    some = some.join(before, by).withColumns({"_n": F.col("_n") + F.col("_before"), "_prev": F.coalesce("_prev", "_carried")})
    return out.unionByName(some.select(out.columns))


#: Functions composed in one row.
FUNCTIONS = 512


def composed_before(blocks: DataFrame, keys: Sequence[str], block: str, code: str, states: int, last: int | None = None) -> DataFrame:
    """(keys, block, code): the composition, in order, of the functions of all earlier blocks of the key.

    A function of ``states`` states is a number, three bits of it per state: that for state s from bit 3 s on. Composing is associative, so
    blocks are composed in stretches of ``FUNCTIONS``, these again, until a key is one stretch, and each block takes what lies before
    its stretch. The number of the ``last`` block, found if not given, says how often that is.
    """
    def then(f: Column, g: Column) -> Column:
        return sum((
            F.shiftleft(_image(g, _image(f, F.lit(s))), 3 * s) for s in range(states)
        ), F.lit(0)).cast("bigint")

    def _image(f: Column, s: Column) -> Column:
        return F.call_function("shiftright", f, (s * 3).cast("int")).bitwiseAND(F.lit(7).cast("bigint"))

    same = F.lit(sum(s << 3 * s for s in range(states))).cast("bigint")

    def before(rows: DataFrame, depth: int) -> DataFrame:
        """(keys, _i, _pre) of rows (keys, _i, _f)."""
        stretch = F.floor(F.col("_i") / FUNCTIONS) if depth else F.lit(0).cast("bigint")
        held = rows.groupBy(*keys, stretch.alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_i", "_f"))).alias("_l"))
        # Each row of a stretch with the composition of those before it, and that of the whole stretch.
        start = F.struct(F.array().cast("array<bigint>").alias("a"), same.alias("f"))
        run = F.aggregate("_l", start, lambda acc, x: F.struct(
            F.array_append(acc["a"], acc["f"]).alias("a"), then(acc["f"], x["_f"]).alias("f")
        ))
        held = held.withColumn("_run", run)
        if depth:
            far = before(held.select(*keys, F.col("_up").alias("_i"), F.col("_run.f").alias("_f")), depth - 1)
            held = held.join(far.withColumnsRenamed({"_i": "_up", "_pre": "_far"}), [*keys, "_up"])
        else:
            held = held.withColumn("_far", same)
        each = held.select(*keys, "_far", F.explode(F.arrays_zip(F.col("_l._i").alias("i"), F.col("_run.a").alias("p"))).alias("_e"))
        return each.select(*keys, F.col("_e.i").alias("_i"), then(F.col("_far"), F.col("_e.p")).alias("_pre"))

    keys = list(keys)
    levels = 0
    if last is None:
        last = blocks.agg(F.max(block)).first()[0] or 0
    while last >= FUNCTIONS:
        last, levels = last // FUNCTIONS, levels + 1
    rows = blocks.select(*keys, F.col(block).cast("bigint").alias("_i"), F.col(code).cast("bigint").alias("_f"))
    return before(rows, levels).select(*keys, F.col("_i").alias(block), F.col("_pre").alias(code))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Keep the row with the smallest ``order`` per key; map-side combined, skew-safe."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Run a streaming fold over rows sorted by key and order inside each partition.

    Rows arrive in Arrow batches and the fold carries its state across batches, so no key is
    ever held in memory. Callers reduce a hot key first (to one row per second or per run).
    """
    ready = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ready.mapInPandas(fold, schema)
