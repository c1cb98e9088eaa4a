"""The clock of a whole lane on a stream, for verdict reuse.

Whether a clock ran backwards depends on all families, and stateful operators know one key at a time. So two queries are chained: the first
stamps each micro-batch with the lane's newest clock, a number that it keeps per batch; the second takes the stamped
rows up, family by family. A batch that is run again finds its rows written and does not write them anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import reuse as U
from .. import tables as T
from . import live as L, state as ST


def _newest(spark: SparkSession, folder: str, batch_id: int) -> int | None:
    """The lane's newest clock up to and with a batch."""
    if batch_id < 0 or not T.complete(spark, f"{folder}/marks/batch={batch_id}"):
        return None
    return spark.read.schema("high bigint").parquet(f"{folder}/marks/batch={batch_id}").first().high


def stamp_sink(folder: str, follow: Callable[[SparkSession], None] | None = None, order: str = "arrival", clock: str = "ts_s") -> Callable[[DataFrame, int], None]:
    """Write batches with ``clock_rollback`` and ``lane_s`` under ``folder/rows``, then call ``follow``.

    A batch's rows come before those of later batches; inside a batch ``order`` decides.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, mark = f"{folder}/rows/batch={batch_id}", f"{folder}/marks/batch={batch_id}"
        before = F.lit(_newest(spark, folder, batch_id - 1)).cast("bigint")
        if not T.complete(spark, rows):
            d = U.lane_clock(batch, order, clock)
            d.withColumns({
                "clock_rollback": F.col("clock_rollback") | F.coalesce(F.col(clock) < before, F.lit(False)),
                "lane_s": F.greatest("lane_s", before),
            }).write.mode("overwrite").parquet(rows)
        if not T.complete(spark, mark):
            high = spark.read.parquet(rows).agg(F.max("lane_s").alias("high"))
            high.select(F.greatest("high", before).alias("high")).coalesce(1).write.mode("overwrite").parquet(mark)
        if follow is not None:
            follow(spark)

    return write


def reuse_sink(folder: str, columns: DataFrame, ttl: int = 60, adaptive: bool = False, max_interval: int = 1024,
               state_partitions: int | None = None) -> Callable[[DataFrame, int], None]:
    """Sink that decides about verdicts as ``reuse_verdicts`` does over all batches so far; ``decided`` reads the result.

    ``columns`` is any frame with the columns of the batches.
    """
    schema = U.lane_clock(columns).schema

    def follow(spark: SparkSession) -> None:
        own = spark.newSession()
        if state_partitions:
            own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
        stamped = own.readStream.schema(schema).parquet(f"{folder}/rows")
        out = ST.reuse_stream(stamped, ttl, adaptive, max_interval)
        L.start(out, L.table_sink(f"{folder}/decided"), f"{folder}/decided-checkpoint", trigger=None).awaitTermination()

    return stamp_sink(folder, follow)


def decided(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ST.REUSE_OUT).parquet(f"{folder}/decided")
