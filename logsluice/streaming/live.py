"""Running streams: triggers, idempotent sinks, live snapshots and rates."""

from __future__ import annotations

import uuid
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..session import ROCKSDB_PROVIDER, in_session, shared_dir, written
from .. import tables as T

# Fixed value: how long a micro-batch waits to fill.
FILL_DEADLINE = "350 milliseconds"


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
          trigger: str | None = FILL_DEADLINE, mode: str = "append") -> StreamingQuery:
    """Run ``sink(batch, batch_id)`` on every micro-batch; ``trigger=None`` drains what is there."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    w = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)
    return w.start()


def table_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Append each micro-batch under its own id, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


#: Runs of applied ids that are merged into one of the next level.
FAN = 16


class _Seen:
    """Applied ids in runs ``<level>-<first batch>-<last batch>``, each split by day.

    A batch adds a run; ``FAN`` runs of a level become one of the next, so a batch reads few files however many came before, and an id is
    rewritten once per level. A run that lies inside another one is left over from a merge and is ignored.
    """

    def __init__(self, spark, folder: str, day: str):
        self.spark, self.folder, self.day = spark, folder, day

    def runs(self, before: int) -> list[tuple[int, int, int]]:
        """Complete runs of the batches below ``before``; what a lost attempt at a later batch left doesn't count."""
        names = [tuple(map(int, n.split("-"))) for n in T.children(self.spark, self.folder)]
        done = [r for r in names if r[2] < before and T.complete(self.spark, self._path(r))]
        return [r for r in done if not any(o != r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in done)]

    def _path(self, run: tuple[int, int, int]) -> str:
        return f"{self.folder}/{run[0]}-{run[1]}-{run[2]}"

    def ids(self, runs: list[tuple[int, int, int]], days: list | None = None) -> DataFrame:
        kind = f"occurrence_id string, {self.day} date"
        out = self.spark.createDataFrame([], kind)
        for r in runs:
            some = self.spark.read.schema(kind).parquet(self._path(r))
            out = out.unionByName(some if days is None else some.where(F.col(self.day).isin(days) | (F.col(self.day).isNull() & F.lit(None in days))))
        return out

    def add(self, run: tuple[int, int, int], ids: DataFrame) -> None:
        # As many files per day as its size needs, one if it is small.
        ids.select("occurrence_id", self.day).hint("rebalance", self.day).write.partitionBy(self.day).mode("overwrite").parquet(self._path(run))

    def merge(self, before: int) -> None:
        runs = sorted(self.runs(before))
        for level in sorted({r[0] for r in runs}):
            own = sorted((r for r in runs if r[0] == level), key=lambda r: r[1])
            while len(own) >= FAN:
                some, own = own[:FAN], own[FAN:]
                new = (level + 1, some[0][1], some[-1][2])
                self.add(new, self.ids(some))
                for r in some:
                    T.remove(self.spark, self._path(r))


def once_sink(folder: str, day: str = "day") -> Callable[[DataFrame, int], None]:
    """Apply every occurrence once, however late a repeat or a first arrival comes; ``applied`` reads what was.

    Batches need ``occurrence_id`` and ``day``, a function of the occurrence. A batch is compared with the ids of the
    days it has. Its own ids are written first, so that Spark knows their size and can send them to those seen, which are
    many. A batch that is run again replaces what it wrote. The days of one batch are listed on the driver.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = _Seen(spark, f"{folder}/seen", day)
        seen.merge(batch_id)  # the batches before this one are done for good
        new = batch.dropDuplicates(["occurrence_id"])
        ids = written(new.select("occurrence_id", day), "batch-ids")
        days = [r[0] for r in ids.select(day).distinct().collect()]
        again = written(seen.ids(seen.runs(batch_id), days).join(ids, "occurrence_id", "left_semi").select("occurrence_id").distinct(), "batch-repeats")
        # Only this batch's own part of each day is replaced.
        new.join(again, "occurrence_id", "left_anti").withColumn("batch", F.lit(batch_id).cast("long")).write.partitionBy(day, "batch").mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/applied")
        seen.add((0, batch_id, batch_id), ids.join(again, "occurrence_id", "left_anti"))

    return write


def applied(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/applied")


def _batches(spark: SparkSession, folder: str, below: int | None = None) -> list[int]:
    named = [int(n.removeprefix("batch=")) for n in T.children(spark, folder) if T.complete(spark, f"{folder}/{n}")]
    return sorted(n for n in named if below is None or n < below)


def _kept(spark: SparkSession, folder: str) -> int:
    """The last batch that was cut down to what is retained, -1 before the first."""
    done = [int(n) for n in T.children(spark, f"{folder}/kept") if all(T.complete(spark, f"{folder}/{k}/{n}") for k in ("kept", "waiting"))]
    return max(done, default=-1)


def _live_rows(spark: SparkSession, folder: str, kind: str, kept: str, below: int | None = None) -> DataFrame | None:
    """Retained rows and those of later batches, with their ``batch``."""
    last = _kept(spark, folder)
    parts = [spark.read.parquet(f"{folder}/{kept}/{last:08d}")] if last >= 0 else []
    for n in _batches(spark, f"{folder}/{kind}", below):
        if n > last:
            parts.append(spark.read.parquet(f"{folder}/{kind}/batch={n}").withColumn("batch", F.lit(n).cast("bigint")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _newest(events: DataFrame, retain: int, order: str) -> DataFrame:
    return events.orderBy(F.desc("batch"), F.desc(order), "source_id").limit(retain)


def _latest_preview(pending: DataFrame) -> DataFrame:
    return pending.groupBy("source_id").agg(F.max_by(F.struct("*"), F.struct("batch", "line_start", "line_end")).alias("p")).select("p.*")


def live_sink(folder: str, retain: int = 2000, order: str = "line_start") -> Callable[[DataFrame, int], None]:
    """Snapshot table of a framed stream: the newest ``retain`` events beside the latest pending previews.

    Each batch is a folder of its own, so one that is run again replaces itself. When ``FAN`` finished batches lie there, they are
    cut down to what is retained and go; ``live_view`` reads what is kept and the batches since.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _batches(spark, f"{folder}/events", batch_id)
        if len(done) >= FAN:
            last = done[-1]
            _newest(_live_rows(spark, folder, "events", "kept", batch_id), retain, order).write.mode("overwrite").parquet(f"{folder}/kept/{last:08d}")
            _latest_preview(_live_rows(spark, folder, "pending", "waiting", batch_id)).write.mode("overwrite").parquet(f"{folder}/waiting/{last:08d}")
            for kind in ("events", "pending"):
                for n in done:
                    T.remove(spark, f"{folder}/{kind}/batch={n}")
            for kind in ("kept", "waiting"):
                for n in T.children(spark, f"{folder}/{kind}"):
                    if int(n) < last:
                        T.remove(spark, f"{folder}/{kind}/{n}")
        batch = batch.persist()
        try:
            batch.where("kind = 'pending'").write.mode("overwrite").parquet(f"{folder}/pending/batch={batch_id}")
            batch.where("kind = 'event'").write.mode("overwrite").parquet(f"{folder}/events/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def live_view(spark, folder: str, retain: int = 2000, order: str = "line_start") -> DataFrame:
    """Newest events, plus pending previews whose event has not closed yet."""
    events = _live_rows(spark, folder, "events", "kept")
    latest = _latest_preview(_live_rows(spark, folder, "pending", "waiting"))
    waiting = latest.join(events.select("source_id", "line_start"), ["source_id", "line_start"], "left_anti")
    return _newest(events.unionByName(waiting), retain, order)


def live_counters(view: DataFrame) -> DataFrame:
    """Awaiting-verdict and retained counts of a live view."""
    return view.agg(
        F.count_if(F.col("kind") == "pending").alias("awaiting_verdict"),
        F.count_if(F.col("kind") == "event").alias("retained_events"),
        F.coalesce(F.sum("out_of_order"), F.lit(0)).alias("out_of_order"),
        F.countDistinct("source_id").alias("active_streams"),
    )


def run_until(query: StreamingQuery, rows: int, timeout_s: float = 600.0) -> int:
    """Stop a running query when it has taken ``rows`` rows; gives how many it took."""
    end, taken = time.monotonic() + timeout_s, {}
    while query.isActive and time.monotonic() < end:
        taken |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
        if sum(taken.values()) >= rows:
            break
        time.sleep(0.05)
    query.stop()
    if query.exception():
        raise query.exception()
    return sum((taken | {p["batchId"]: p["numInputRows"] for p in query.recentProgress}).values())


_PROGRESS = (
    "query string, batch bigint, at string, rows bigint, rows_per_second double, duration_ms bigint, state_rows bigint"
)


class ProgressLog(StreamingQueryListener):
    """Feeds a table with one row per trigger of the session's streams; ``progress`` reads it.

    A repeated trigger adds a row, so counts take the last one of a batch. Triggers without rows are left out.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            row = (
                str(p.id), p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond),
                p.durationMs.get("triggerExecution"), sum(o.numRowsTotal for o in p.stateOperators),
            )
            self.spark.createDataFrame([row], _PROGRESS).coalesce(1).write.mode("append").parquet(self.folder)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def reported(spark: SparkSession, folder: str, queries: Sequence[str], batches: int, timeout_s: float = 60.0) -> None:
    """Wait until the log has ``batches`` batches of each query; listeners are told a little later than queries end."""
    end = time.monotonic() + timeout_s
    while time.monotonic() < end:
        if T.exists(spark, folder):
            seen = progress(spark, folder).where(F.col("query").isin(list(queries))).groupBy("query").count().collect()
            if len(seen) == len(queries) and all(r["count"] >= batches for r in seen):
                return
        time.sleep(0.2)
    raise TimeoutError("triggers without a report")


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """The last report of each query and batch."""
    rows = spark.read.schema(_PROGRESS).parquet(folder)
    return rows.groupBy("query", "batch").agg(F.max_by(F.struct("*"), "at").alias("p")).select("p.*")


def rates(query: StreamingQuery) -> dict:
    """Rows and rows per second of the latest progress report."""
    p = query.lastProgress or {}
    return {
        "received": p.get("numInputRows", 0),
        "events_per_second": p.get("processedRowsPerSecond", 0.0),
        "batch_id": p.get("batchId", -1),
    }


def events_per_window(events: DataFrame, time: str = "ts", width: str = "1 minute") -> DataFrame:
    """Event counts per tumbling window. Windows are never closed, so a late row is counted when it comes;
    the sink gets the new count of each window that changed (update mode)."""
    return events.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("events"))


def drain_into(df: DataFrame, sink: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over everything available, a trigger at a time, into ``sink``."""
    folder = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    start(df, sink, f"{folder}/checkpoint", trigger=None).awaitTermination()


def drain_parts(
    parts: Sequence[DataFrame], make: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], state_partitions: int | None = None,
    listener: StreamingQueryListener | None = None,
) -> list[StreamingQuery]:
    """Run ``make(stream)`` into ``sink`` with one trigger for each of ``parts``; the query is stopped and started between them.

    A part is a folder of as many files as it needs, all of which its trigger takes up. The queries run in a session of their own, which
    ``listener`` hears.
    """
    spark = parts[0].sparkSession
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    own = spark.newSession()
    if state_partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    if listener is not None:
        own.streams.addListener(listener)
    queries = []
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/{k}")
        stream = own.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        queries.append(start(make(stream), sink, f"{folder}/checkpoint", trigger=None))
        queries[-1].awaitTermination()
    return queries


def drain(df: DataFrame, state_partitions: int | None = None) -> DataFrame:
    """Run a stream over everything available and read back its result table.

    ``state_partitions`` fixes the number of state stores; the session's setting is the default.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # A query keeps the number of state stores that its plan had when it started, so the setting is
    # made on a session of its own; queries running beside it don't see it.
    own = spark.newSession()
    if state_partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    query = start(in_session(df, own), table_sink(f"{folder}/out"), f"{folder}/checkpoint", trigger=None)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out").select(df.columns)

