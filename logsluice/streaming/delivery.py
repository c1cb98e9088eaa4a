"""Delivery of notifications as a running sink that can be stopped and started anywhere.

The outbox is a chain of versions, each written whole before it counts. A round leases what is due, which commits the attempt
before anything is sent; it then sends, and commits the results. Whoever starts again after a crash goes on from the last complete
version: rows leased by the lost round stay leased until their time is up and are sent again, with the attempt counted. Receivers get the
same id each time. Settled rows leave the chain, so a version holds what is pending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import incidents as I
from ..sources import sinks as K
from .. import tables as T

BOX = (
    "notification_id string, incident_key string, payload string, status string, attempts bigint, due bigint, updated bigint"
)
#: Versions that are kept; the one before the last may still be read.
_KEPT = 2


class Outbox:
    """A folder with ``pending/<version>`` and ``settled/<version>``; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def version(self) -> int:
        """The last complete version, -1 before the first."""
        done = [int(n) for n in T.children(self.spark, f"{self.folder}/pending") if T.complete(self.spark, f"{self.folder}/pending/{n}")]
        return max(done, default=-1)

    def pending(self) -> DataFrame:
        v = self.version()
        return self._read(f"{self.folder}/pending/{v:08d}") if v >= 0 else self.spark.createDataFrame([], BOX)

    def settled(self) -> DataFrame:
        """Delivered and dead rows of complete versions; the settled rows of a version are written before its pending ones."""
        v = self.version()
        names = [n for n in T.children(self.spark, f"{self.folder}/settled") if int(n) <= v]
        return self._read(*[f"{self.folder}/settled/{n}" for n in names]) if names else self.spark.createDataFrame([], BOX)

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(BOX).parquet(*paths)

    def commit(self, rows: DataFrame) -> None:
        v = self.version() + 1
        rows = rows.select(*[c.split()[0] for c in BOX.split(", ")])
        done = F.col("status") != "pending"
        rows.where(done).write.mode("overwrite").parquet(f"{self.folder}/settled/{v:08d}")
        rows.where(~done).write.mode("overwrite").parquet(f"{self.folder}/pending/{v:08d}")
        for old in T.children(self.spark, f"{self.folder}/pending"):
            if int(old) <= v - _KEPT:
                T.remove(self.spark, f"{self.folder}/pending/{old}")

    def add(self, arrived: DataFrame) -> None:
        """Take new notifications in; one whose id is known already changes nothing."""
        known = self.pending().select("notification_id").unionByName(self.settled().select("notification_id"))
        new = arrived.dropDuplicates(["notification_id"]).join(known, "notification_id", "left_anti")
        self.commit(self.pending().unionByName(new.select(self.pending().columns)))

    def lease(self, now: int) -> None:
        self.commit(I.lease(self.pending(), now))

    def leased(self, now: int) -> DataFrame:
        """What the round at ``now`` has leased."""
        return self.pending().where((F.col("updated") == now) & (F.col("due") == now + I.LEASE_SECONDS) & (F.col("attempts") > 0))

    def send(self, now: int, send: Callable[[str, str], None]) -> None:
        """Send what is leased and record the results, which are written first so that a row is sent once per round."""
        results = f"{self.folder}/results/{self.version():08d}"
        K.deliver(self.leased(now), send).write.mode("overwrite").parquet(results)
        told = self.spark.read.schema("notification_id string, attempts bigint, ok boolean").parquet(results)
        self.commit(I.record_delivery(self.pending(), told, now))

    def round(self, now: int, send: Callable[[str, str], None]) -> None:
        self.lease(now)
        self.send(now, send)


def delivery_sink(folder: str, send: Callable[[str, str], None], clock: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """Take the notifications of each micro-batch into the outbox and run a round of delivery at ``clock()``.

    A batch that is run again adds nothing; its round only sends what is due by then.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        box = Outbox(batch.sparkSession, folder)
        box.add(batch)
        box.round(clock(), send)

    return write
