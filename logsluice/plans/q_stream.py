"""Queries: the streaming operators, drained over the tables and held to the batch answers."""

import uuid

from pyspark.sql import functions as F

from ..operators import incidents as I
from ..session import shared_dir, written
from ..streaming import delivery as DL, framing as SF, lane as LN, live as L, state as ST
from . import adapters as A, oracle as O
from .catalog import ORACLES, query
from .q_incidents import ALL as INCIDENTS, POLICY, _BOX, box, decided_events
from .q_reuse import _FOLD, _LATE
from .q_groups import ALL as GROUPS, keyed_events


def _drained(df):
    # As many state stores as tasks run at a time: the state of one trigger is small.
    return L.drain(df, df.sparkSession.sparkContext.defaultParallelism)


@query("streamed_incidents", ORACLES["incident_notifications"])
def streamed_incidents(spark, sf_dir):
    sent = _drained(ST.incident_stream(decided_events(spark, sf_dir, stream=True), POLICY))
    return sent.select("incident_key", "ts_s", "ord", "count", "seq", "level")


@query("streamed_outbox", ORACLES["notification_outbox"])
def streamed_outbox(spark, sf_dir):
    sent = _drained(ST.incident_stream(decided_events(spark, sf_dir, stream=True), POLICY))
    return ST.to_outbox(sent).select(
        "notification_id", "incident_key", "status", "attempts", "due",
        F.get_json_object("payload", "$.event_id").alias("event_id"),
        F.get_json_object("payload", "$.decision").alias("decision"),
        F.get_json_object("payload", "$.recurrence_count").cast("bigint").alias("recurrence_count"),
    )


@query("streamed_reuse", O.with_ctes(*GROUPS, _FOLD.format(ttl=432000, plain="false", cap=64), """
SELECT id, reused, reason, CASE WHEN reused THEN rep END AS representative_id, importance FROM fold WHERE n > 0"""))
def streamed_reuse(spark, sf_dir):
    out = _drained(ST.reuse_stream(
        keyed_events(spark, sf_dir, stream=True), ttl=432000, adaptive=True, max_interval=64
    ))
    return out.select(
        "id", "reused", "reason", "representative_id",
        F.get_json_object("verdict", "$.importance").alias("importance"),
    )


@query("streamed_lane_reuse", O.with_ctes(*GROUPS, _LATE, _FOLD.replace("FROM fam)", "FROM shaken)").format(ttl=14400, plain="false", cap=64), """
SELECT id, reused, reason, CASE WHEN reused THEN rep END AS representative_id, importance FROM fold WHERE n > 0
UNION ALL SELECT id, false, 'no_clock', NULL, importance FROM shaken WHERE template_key IS NOT NULL AND ts_s IS NULL"""))
def streamed_lane_reuse(spark, sf_dir):
    """Four triggers with clocks that step back and clocks that are missing: the answers of the batch operator."""
    pos = F.floor(F.col("arrival") / 10) * 10 + (F.col("arrival") * 7) % 10
    ev = keyed_events(spark, sf_dir).withColumns({"arrival": pos.cast("bigint"), "ts_s": F.when(F.col("k") % 17 != 3, F.col("ts_s"))})
    ev = ev.select("template_key", "eligible", "id", "arrival", "ts_s", "judgment", "truncated", "sensitive", "parse_uncertain")
    last = A.load(spark, sf_dir, "events", ["event_id"]).agg(F.max("event_id")).first()[0] + 1
    parts = [ev.where((F.col("arrival") >= last * k // 40 * 10) & (F.col("arrival") < (last * (k + 1) // 40 * 10 if k < 3 else last + 10))) for k in range(4)]
    folder = f"{shared_dir(spark)}/lane-{uuid.uuid4().hex}"
    sink = LN.reuse_sink(folder, ev, ttl=14400, adaptive=True, max_interval=64, state_partitions=spark.sparkContext.defaultParallelism)
    L.drain_parts(parts, lambda d: d, sink)
    return LN.decided(spark, folder).select(
        "id", "reused", "reason", "representative_id", F.get_json_object("verdict", "$.importance").alias("importance")
    )


def _into_parts(df, parts: int):
    """Frames of the rows whose column ``part`` is 0, 1, ..."""
    return [df.where(F.col("part") == k).drop("part") for k in range(parts)]


@query("late_occurrences", O.with_ctes(O.EVENTS, "SELECT id, count(*) AS applied FROM ev GROUP BY id"))
def late_occurrences(spark, sf_dir):
    """Four triggers, the newest events first, and each event in two of them: all are applied once."""
    ev = A.events_log(spark, sf_dir).withColumn("day", F.to_date(F.timestamp_micros("ts_us")))
    ev = I.with_incident_keys(ev, "demo").select("id", "occurrence_id", "day", "arrival")
    part = 3 - F.floor(F.dayofmonth("day") / 8)
    twice = ev.withColumn("part", F.explode(F.array_distinct(F.array(part, (part + 1) % 4)))).withColumn("part", F.col("part").cast("int"))
    folder = f"{shared_dir(spark)}/once-{uuid.uuid4().hex}"
    L.drain_parts(_into_parts(twice, 4), lambda d: d, L.once_sink(folder))
    return L.applied(spark, folder).groupBy("id").agg(F.count(F.lit(1)).alias("applied"))


@query("streamed_once_each", O.with_ctes(O.EVENTS, "SELECT id FROM ev"))
def streamed_once_each(spark, sf_dir):
    """Every event delivered twice, in one trigger and again in the next, is applied once."""
    ev = A.events_log(spark, sf_dir).withColumn("day", F.to_date(F.timestamp_micros("ts_us")))
    ev = I.with_incident_keys(ev, "demo").select("id", "occurrence_id", "day")
    twice = ev.withColumn("part", F.explode(F.array(F.lit(0), F.lit(0), F.lit(1))))
    folder = f"{shared_dir(spark)}/once-{uuid.uuid4().hex}"
    L.drain_parts(_into_parts(twice, 2), lambda d: d, L.once_sink(folder))
    return L.applied(spark, folder).select("id")


@query("streamed_traces", ORACLES["framed_traces"])
def streamed_traces(spark, sf_dir):
    """Stack traces as line streams in three triggers that cut through events; whole events as in batch."""
    # Written once: three triggers and the end marks read them.
    lines = written(A.trace_lines(spark, sf_dir), "trace-lines").withColumn("eof", F.lit(False))
    ends = lines.groupBy("source").agg((F.max("line_no") + 1).alias("line_no")).select(
        "source", "line_no", F.lit("").alias("raw"), F.lit(True).alias("eof")
    )
    third = A.load(spark, sf_dir, "orders", ["o_orderkey"]).agg(F.max("o_orderkey")).first()[0] * 8 // 3
    part = F.when(F.col("eof"), 2).otherwise(F.least(F.lit(2), F.floor(F.col("line_no") / third))).cast("int")
    parts = _into_parts(lines.unionByName(ends).withColumn("part", part), 3)
    folder = f"{shared_dir(spark)}/traces-{uuid.uuid4().hex}"
    L.drain_parts(parts, lambda d: SF.frame_stream(d, with_json=False), L.table_sink(folder), spark.sparkContext.defaultParallelism)
    ev = spark.read.parquet(folder)
    return ev.select(
        F.col("source.path").alias("path"), "line_start", "line_end", "line_count", "parse_uncertain", "truncated", "sensitive",
        "ts_raw", F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


@query("trigger_metrics", O.with_ctes(O.EVENTS, "SELECT arrival % 3 AS batch, count(*) AS rows FROM ev GROUP BY 1"))
def trigger_metrics(spark, sf_dir):
    """Three triggers of a stream as its listener saw them."""
    folder = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    ev = A.events_log(spark, sf_dir, with_ids=False).select("arrival", "text", (F.col("arrival") % 3).alias("part"))
    count = lambda batch, n: batch.write.format("noop").mode("overwrite").save()
    queries = L.drain_parts(_into_parts(ev, 3), lambda d: d, count, listener=L.ProgressLog(spark, folder))
    L.reported(spark, folder, [str(queries[0].id)], batches=3)
    return L.progress(spark, folder).select("batch", "rows")


@query("timed_triggers", O.with_ctes(O.EVENTS, "SELECT text, count(*) AS events FROM ev GROUP BY text"))
def timed_triggers(spark, sf_dir):
    """A running stream with its trigger of 350 ms, stopped when all events have come."""
    folder = f"{shared_dir(spark)}/timed-{uuid.uuid4().hex}"
    ev = A.events_log(spark, sf_dir, with_ids=False).select("text")
    ev.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    query = L.start(stream, L.table_sink(f"{folder}/out"), f"{folder}/checkpoint")
    L.run_until(query, spark.read.parquet(f"{folder}/in").count())
    return spark.read.schema(ev.schema).parquet(f"{folder}/out").groupBy("text").agg(F.count(F.lit(1)).alias("events"))


_MID = 1705276800  # the middle of the generated month
_BROKEN = "0123"


def _send(notification_id: str, payload: str) -> None:
    """A receiver that never takes ids beginning with 0 to 3."""
    if notification_id[0] in _BROKEN:
        raise ConnectionError("refused")


@query("delivered_after_restarts", O.with_ctes(*INCIDENTS, _BOX, f"""
first AS (SELECT *, notification_id[1] IN ('0', '1', '2', '3') AS broken, due <= {_MID} AS early FROM box)""", """
SELECT notification_id, CASE WHEN broken THEN 'dead' ELSE 'delivered' END AS status,
  CASE WHEN broken THEN 8 WHEN early THEN 2 ELSE 1 END::BIGINT AS attempts,
  CASE WHEN broken THEN 0 ELSE 1 END::BIGINT AS received FROM first"""))
def delivered_after_restarts(spark, sf_dir):
    """Notifications in two triggers with rounds of delivery; the first round is lost after its lease. What is refused eight times is dead."""
    rows = box(spark, sf_dir)
    parts = [rows.where(F.col("due") <= _MID), rows.where(F.col("due") > _MID)]
    folder = f"{shared_dir(spark)}/outbox-{uuid.uuid4().hex}"
    L.drain_parts(parts[:1], lambda d: d, lambda batch, n: DL.Outbox(batch.sparkSession, folder).add(batch))
    DL.Outbox(spark, folder).lease(_MID)  # and here the run dies
    clock = iter(range(_MID * 2, _MID * 2 + 100_000, 1000))
    L.drain_parts(parts[1:], lambda d: d, DL.delivery_sink(folder, _send, lambda: next(clock)))
    for _ in range(9):
        DL.Outbox(spark, folder).round(next(clock), _send)
    done = DL.Outbox(spark, folder)
    results = spark.read.schema("notification_id string, attempts bigint, ok boolean").parquet(f"{folder}/results/*")
    got = results.groupBy("notification_id").agg(F.count_if("ok").alias("received"))
    return done.settled().unionByName(done.pending()).join(got, "notification_id", "left").select(
        "notification_id", "status", "attempts", F.coalesce("received", F.lit(0)).cast("bigint").alias("received")
    )


@query("streamed_framing", """
SELECT source || '/' || doc_id AS path, len(list_filter(string_split(text, chr(10)), lambda s: rtrim(s, chr(13)) <> ''))::BIGINT AS lines
FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda s: rtrim(s, chr(13)) <> '')) > 0""")
def streamed_framing(spark, sf_dir):
    """Documents as line streams, each closed by its end marker; all lines land in one event."""
    docs = A.load_stream(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    path = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    lines = docs.select(
        A.source_struct(type="file", path=path).alias("source"),
        F.posexplode(F.concat(F.split("text", "\n"), F.array(F.lit(None).cast("string")))).alias("pos", "raw"),
    ).select(
        "source", (F.col("pos") + 1).cast("bigint").alias("line_no"),
        F.coalesce("raw", F.lit("")).alias("raw"), F.col("raw").isNull().alias("eof"),
    )
    out = _drained(SF.frame_stream(lines))
    return out.groupBy(F.col("source.path").alias("path")).agg(F.sum("line_count").alias("lines"))
