"""Queries: incidents and the notification outbox."""

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.classify import Policy
from ..operators import incidents as I
from . import adapters as A, oracle as O
from .catalog import query

POLICY = Policy(window=86400, cooldown=21600, recurrence=5, max_escalation=8)

# One incident per namespace and event type: a few hot keys with long histories.
_ACT = """
act AS (SELECT sha256(CAST(to_json({'contract': 'demo', 'source': {'namespace': source.namespace}, 'text': event_type}) AS VARCHAR)) AS incident_key,
  ts_s, arrival AS ord, decision, id FROM decided),
seq AS (SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY ts_s, ord) AS n FROM act WHERE decision IN ('notify', 'review')),
fold AS (
  SELECT DISTINCT incident_key, 0::BIGINT AS n, 0::BIGINT AS win, 0::BIGINT AS count, 0::BIGINT AS level, 0::BIGINT AS last,
    0::BIGINT AS seq, ''::VARCHAR AS prev, false AS enqueued, 0::BIGINT AS ts_s, 0::BIGINT AS ord FROM seq
  UNION ALL
  SELECT incident_key, n, win, count, greatest(level, reached), CASE WHEN send THEN ts_s ELSE last END,
    CASE WHEN send THEN seq + 1 ELSE seq END, CASE WHEN send THEN decision ELSE prev END, send, ts_s, ord
  FROM (SELECT *, seq = 0 OR ts_s < last OR ts_s - last >= 21600 OR reached > level OR (decision = 'notify' AND prev <> 'notify') AS send
    FROM (SELECT *, least(8, count // 5) AS reached FROM (
      SELECT f.incident_key, s.n, f.last, f.seq, f.prev, s.ts_s, s.ord, s.decision,
        CASE WHEN s.ts_s < f.win OR s.ts_s - f.win >= 86400 THEN s.ts_s ELSE f.win END AS win,
        CASE WHEN s.ts_s < f.win OR s.ts_s - f.win >= 86400 THEN 1 ELSE f.count + 1 END AS count,
        CASE WHEN s.ts_s < f.win OR s.ts_s - f.win >= 86400 THEN 0 ELSE f.level END AS level
      FROM fold f JOIN seq s ON s.incident_key = f.incident_key AND s.n = f.n + 1)))
)"""
ALL = (O.EVENTS, O.BASE, O.JUDGED, O.DECIDED, _ACT)


def decided_events(spark, sf_dir, stream=False):
    ev = A.judged_events(spark, sf_dir, stream)
    key = F.sha2(F.to_json(F.struct(
        F.lit("demo").alias("contract"),
        F.struct(F.col("source.namespace").alias("namespace")).alias("source"),
        F.col("event_type").alias("text"),
    )), 256)
    return ev.withColumn("incident_key", key).withColumn(
        "decision", C.policy_decision("judgment", "truncated", "sensitive", "parse_uncertain", POLICY)
    )


def folded(spark, sf_dir):
    return I.fold_incidents(decided_events(spark, sf_dir), POLICY)


@query("incident_notifications", O.with_ctes(*ALL, """
SELECT incident_key, ts_s, ord, count, seq, level FROM fold WHERE enqueued"""))
def incident_notifications(spark, sf_dir):
    f = folded(spark, sf_dir).where("enqueued")
    return f.select("incident_key", "ts_s", "ord", "count", "seq", F.col("level").cast("bigint").alias("level"))


@query("incident_table", O.with_ctes(*ALL, """
SELECT incident_key, count, level, last, seq, ts_s AS touched, prev AS last_decision
FROM fold f WHERE n > 0 AND n = (SELECT max(n) FROM seq s WHERE s.incident_key = f.incident_key)"""))
def incident_table(spark, sf_dir):
    return I.incident_table(folded(spark, sf_dir)).withColumn("level", F.col("level").cast("bigint"))


@query("recent_incidents", O.with_ctes(*ALL, """
SELECT incident_key, count, touched FROM (SELECT incident_key, count, ts_s AS touched FROM fold f WHERE n > 0
  AND n = (SELECT max(n) FROM seq s WHERE s.incident_key = f.incident_key)) ORDER BY touched DESC, incident_key LIMIT 5"""))
def recent_incidents(spark, sf_dir):
    return I.recent_incidents(I.incident_table(folded(spark, sf_dir)), 5).select("incident_key", "count", "touched")


_BOX = """
box AS (SELECT sha256(concat_ws(chr(31), 'notification-v1', f.incident_key, CAST(f.seq AS VARCHAR))) AS notification_id,
  f.incident_key, f.seq, f.count, f.ts_s AS due, a.id AS event_id, a.decision FROM fold f JOIN act a ON a.incident_key = f.incident_key AND a.ord = f.ord WHERE enqueued)"""


def box(spark, sf_dir):
    ev = decided_events(spark, sf_dir)
    return I.outbox(I.fold_incidents(ev, POLICY), ev)


@query("notification_outbox", O.with_ctes(*ALL, _BOX, """
SELECT notification_id, incident_key, 'pending' AS status, 0::BIGINT AS attempts, due, event_id, decision, count AS recurrence_count FROM box"""))
def notification_outbox(spark, sf_dir):
    return box(spark, sf_dir).select(
        "notification_id", "incident_key", "status", "attempts", "due",
        F.get_json_object("payload", "$.event_id").alias("event_id"),
        F.get_json_object("payload", "$.decision").alias("decision"),
        F.get_json_object("payload", "$.recurrence_count").cast("bigint").alias("recurrence_count"),
    )


_MID = 1705276800  # the middle of the generated month


@query("due_notifications", O.with_ctes(*ALL, _BOX, f"""
SELECT notification_id, due FROM box WHERE due <= {_MID} ORDER BY due, notification_id LIMIT 100"""))
def due_notifications(spark, sf_dir):
    return I.due_notifications(box(spark, sf_dir), _MID, 100).select("notification_id", "due")


@query("delivered_outbox", O.with_ctes(*ALL, _BOX, f"""
leased AS (SELECT *, due <= {_MID} AS taken, CASE WHEN due <= {_MID} THEN 1 ELSE 0 END AS attempts FROM box)""", f"""
SELECT notification_id, CASE WHEN taken AND seq % 3 <> 0 THEN 'delivered' ELSE 'pending' END AS status, attempts::BIGINT AS attempts,
  CASE WHEN taken THEN {_MID} + 1 + 2 ELSE due END AS due, CASE WHEN taken THEN {_MID} + 1 ELSE due END AS updated FROM leased"""))
def delivered_outbox(spark, sf_dir):
    """One lease at mid-month; every third notification of an incident fails to deliver."""
    ev = decided_events(spark, sf_dir)
    fold = I.fold_incidents(ev, POLICY)
    leased = I.lease(I.outbox(fold, ev), _MID)
    seqs = fold.where("enqueued").select(
        I.notification_id(F.col("incident_key"), F.col("seq")).alias("notification_id"),
        (F.col("seq") % 3 != 0).alias("ok"),
    )
    taken = leased.where("attempts = 1").select("notification_id", "attempts").join(seqs, "notification_id")
    return I.record_delivery(leased, taken, _MID + 1).drop("incident_key", "payload")


@query("incident_status", O.with_ctes(*ALL, _BOX, """
SELECT (SELECT count(DISTINCT incident_key) FROM seq) AS incident_count, count(*) AS outbox_pending, 0::BIGINT AS outbox_dead FROM box"""))
def incident_status(spark, sf_dir):
    ev = decided_events(spark, sf_dir)
    fold = I.fold_incidents(ev, POLICY)
    return I.controller_status(I.incident_table(fold), I.outbox(fold, ev))


@query("incidents_with_notification", O.with_ctes(*ALL, _BOX, """
SELECT b.incident_key, b.notification_id, b.event_id, 'pending' AS status FROM box b
WHERE seq = (SELECT max(seq) FROM box c WHERE c.incident_key = b.incident_key)"""))
def incidents_with_notification(spark, sf_dir):
    ev = decided_events(spark, sf_dir)
    fold = I.fold_incidents(ev, POLICY)
    d = I.with_latest_notification(I.incident_table(fold), I.outbox(fold, ev))
    return d.select(
        "incident_key", "notification_id",
        F.get_json_object("payload", "$.event_id").alias("event_id"), "status",
    )


@query("unseen_occurrences", O.with_ctes(O.EVENTS, """
SELECT DISTINCT id FROM ev WHERE arrival % 4 <> 0"""))
def unseen_occurrences(spark, sf_dir):
    """Every event delivered twice; a quarter was applied before."""
    ev = I.with_incident_keys(A.events_log(spark, sf_dir).select("arrival", "source", "text", "ts_raw", "id"), "demo")
    seen = ev.where("arrival % 4 = 0").select("occurrence_id")
    twice = ev.withColumn("arrival", F.explode(F.array(F.col("arrival"), F.col("arrival") + 1000000)))
    return I.unseen(twice, seen).select("id")


@query("incident_violations", O.with_ctes(*ALL, """
SELECT CASE WHEN ord % 7 = 4 THEN left(incident_key, 63) ELSE incident_key END AS incident_key,
  CASE ord % 7 WHEN 0 THEN 'bad_decision' WHEN 1 THEN 'bad_count' WHEN 2 THEN 'bad_level' WHEN 3 THEN 'bad_sequence' ELSE 'bad_id' END AS reason
FROM fold WHERE n > 0 AND ord % 7 < 5"""))
def incident_violations(spark, sf_dir):
    """The state at every event that counts, broken in five ways by its place."""
    rows = folded_rows(spark, sf_dir)
    kind = F.col("ord") % 7

    def broken(which, to, c):
        return F.when(kind == which, F.lit(to)).otherwise(F.col(c)).alias(c)

    return I.incident_violations(rows.select(
        F.when(kind == 4, F.left("incident_key", F.lit(63))).otherwise(F.col("incident_key")).alias("incident_key"),
        broken(1, -1, "count"), broken(2, 99, "level"), broken(3, -1, "seq"), broken(0, "ignore", "last_decision"),
    ))


def folded_rows(spark, sf_dir):
    """One row per event that counts, with the incident's state where the fold has it."""
    ev = decided_events(spark, sf_dir).where("decision IN ('notify', 'review')").select("incident_key", F.col("arrival").alias("ord"), "decision")
    known = ev.join(folded(spark, sf_dir).select("incident_key", "ord", "count", "level", "seq", "last_decision"), ["incident_key", "ord"], "left")
    return known.select(
        "incident_key", "ord", F.coalesce("count", F.lit(1)).alias("count"), F.coalesce("level", F.lit(0)).alias("level"),
        F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("last_decision", "decision").alias("last_decision"),
    )


@query("upgraded_payloads", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, O.DECIDED, """
old AS (SELECT *, sha256('n' || arrival) AS nid FROM decided WHERE decision IN ('notify', 'review'))""", """
SELECT nid AS notification_id, substr(sha256(concat_ws(chr(31), nid, CAST(ts_s AS VARCHAR))), 1, 20) AS event_id,
  sha256('{"pod":"' || source.pod || '"}') AS source_id, decision,
  CASE WHEN k IN (99, 13) THEN 'unknown' ELSE importance END AS importance FROM old"""))
def upgraded_payloads(spark, sf_dir):
    ev = decided_events(spark, sf_dir).where("decision IN ('notify', 'review')")
    nid = F.sha2(F.concat(F.lit("n"), F.col("arrival").cast("string")), 256)
    payload = F.to_json(F.struct(
        F.lit(1).alias("schema"), nid.alias("notification_id"), F.col("incident_key").alias("incident_id"),
        "decision", F.lit(1).alias("recurrence_count"), F.col("ts_s").alias("observed_at"),
        F.struct(F.col("source.pod").alias("pod")).alias("source"), "judgment",
    ))
    old = ev.select(nid.alias("notification_id"), "incident_key", payload.alias("payload"))
    p = I.upgrade_payloads(old)
    return p.select("notification_id", *[
        F.get_json_object("payload", path).alias(name) for name, path in (
            ("event_id", "$.event_id"), ("source_id", "$.source_id"), ("decision", "$.decision"),
            ("importance", "$.judgment.importance"),
        )
    ])
