"""Incidents: seen-set, recurrence, escalation, cooldown, and the notification outbox."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions import classify as C
from ..functions.classify import Policy
from ..session import written
from .scale import ROWS_PER_BLOCK, first_per_key, ordered_fold, preceding_max, running_rank, split_wide, with_block

MAX_ATTEMPTS = 8
LEASE_SECONDS = 30


def _json_hash(*cols: Column) -> Column:
    return F.coalesce(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256), F.lit(""))


def with_incident_keys(events: DataFrame, contract: str) -> DataFrame:
    """Add ``incident_key`` (same source and text) and ``occurrence_id`` (same event)."""
    name = F.lit(contract)
    return events.withColumn(
        "incident_key", _json_hash(name.alias("contract"), F.col("source"), F.col("text"))
    ).withColumn(
        "occurrence_id", _json_hash(name.alias("contract"), F.col("source"), F.col("ts_raw"), F.col("id"))
    )


def unseen(events: DataFrame, seen: DataFrame | None = None, order: str = "arrival") -> DataFrame:
    """Occurrences not applied before: first of each id in the input, none in ``seen``."""
    fresh = first_per_key(events, ["occurrence_id"], F.col(order))
    if seen is None:
        return fresh
    return fresh.join(seen.select("occurrence_id"), "occurrence_id", "left_anti")


_WINDOW_SCHEMA = "incident_key string, ts_s bigint, n bigint, anchor bigint, before bigint"


def _window_fold(span: int):
    """Anchored recurrence windows over one row per (incident, second)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, count = None, 0, 0
        for pdf in batches:
            keys, secs, ns = pdf["incident_key"].to_numpy(), pdf["ts_s"].to_numpy(), pdf["n"].to_numpy()
            anchors = np.empty(len(pdf), dtype="int64")
            before = np.empty(len(pdf), dtype="int64")
            for i in range(len(pdf)):
                now = int(secs[i])
                if keys[i] != key:
                    # A new incident has window 0; its first event falls outside unless now < span.
                    key, anchor, count = keys[i], 0, 0
                if now < anchor or now - anchor >= span:
                    anchor, count = now, 0
                anchors[i], before[i] = anchor, count
                count += int(ns[i])
            yield pd.DataFrame({"incident_key": keys, "ts_s": secs, "n": ns, "anchor": anchors, "before": before})

    return fold


_SEND_SCHEMA = (
    "incident_key string, ts_s bigint, ord bigint, count bigint, enqueued boolean, seq bigint, "
    "level int, last bigint, last_decision string, final boolean"
)


def _send_fold(policy: Policy):
    """Cooldown, escalation and upgrade over the events that can possibly matter."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, level, last, seq, prev = None, None, 0, 0, 0, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.incident_key != key:
                    key, anchor, level, last, seq, prev = r.incident_key, None, 0, 0, 0, None
                if r.anchor != anchor:
                    anchor, level = r.anchor, 0
                now = int(r.ts_s)
                reached = min(policy.max_escalation, int(r.count) // policy.recurrence)
                send = (
                    seq == 0 or now < last or now - last >= policy.cooldown or reached > level
                    or (r.decision == "notify" and prev != "notify")
                )
                level = max(level, reached)
                if send:
                    seq, last, prev = seq + 1, now, r.decision
                out.append((key, now, r.ord, r.count, send, seq, level, last, prev, r.final))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SEND_SCHEMA.split(", ")])

    return fold


def _placed(act: DataFrame) -> DataFrame:
    """Add ``_rn``, the place inside (incident, second), and ``_notified``, that of the last notify before the event.

    Seconds with more events than a window should take, as those without a clock may be, go block by block.
    """
    keys, notify = ["incident_key", "ts_s"], F.col("decision") == "notify"
    small, large = split_wide(act, keys)
    w = Window.partitionBy(*keys).orderBy("ord")
    out = small.withColumn("_rn", F.row_number().over(w).cast("bigint")).withColumn(
        "_notified", F.max(F.when(notify, F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    )
    if large is None:
        return out
    some = running_rank(with_block(large, "ord", ROWS_PER_BLOCK), keys, ["ord"], "_rn")
    some = preceding_max(some, keys, ["ord"], F.when(notify, F.col("_rn")), "_notified")
    return out.unionByName(some.select(out.columns))


def fold_incidents(events: DataFrame, policy: Policy = Policy(), order: str = "arrival") -> DataFrame:
    """Recurrence state after every event that can change it.

    Needs ``incident_key, ts_s, decision`` and ``order``; only notify and review decisions
    count. Each key is replayed in time order, but not event by event: windows are found on
    one row per second; after that only the first event of a second, events that reach an
    escalation step, and the first notify after either of them can be sent. That candidate set
    is bounded by time and ``max_escalation``, however often a key repeats. Events without a clock
    count as of second 0, before all others. The four columns of the events that count are written once, as several steps read them.
    """
    act = events.where(F.col("decision").isin("notify", "review")).withColumnRenamed(order, "ord")
    act = written(act.select("incident_key", F.coalesce("ts_s", F.lit(0)).alias("ts_s"), "ord", "decision"), "acting")
    per_second = act.groupBy("incident_key", "ts_s").agg(F.count(F.lit(1)).alias("n"))
    windows = ordered_fold(
        per_second, ["incident_key"], ["ts_s"], _window_fold(policy.window), _WINDOW_SCHEMA
    )
    d = _placed(act).join(windows, ["incident_key", "ts_s"]).withColumn("count", F.col("before") + F.col("_rn"))
    step = (F.col("count") % policy.recurrence == 0) & (
        F.col("count") <= policy.recurrence * policy.max_escalation
    )
    # The last event up to this one that reached a step, or the first of its second.
    reached = F.least(F.floor(F.col("count") / policy.recurrence), F.lit(policy.max_escalation)) * policy.recurrence
    lead = F.greatest(reached - F.col("before"), F.lit(1))
    first_notify = (F.col("decision") == "notify") & F.coalesce(F.col("_notified") < lead, F.lit(True))
    last = F.col("_rn") == F.col("n")
    cand = d.where((F.col("_rn") == 1) | step | first_notify | last).select(
        "incident_key", "ts_s", "ord", "anchor", "count", "decision", last.alias("final")
    )
    return ordered_fold(cand, ["incident_key"], ["ts_s", "ord"], _send_fold(policy), _SEND_SCHEMA)


def notification_id(key, seq) -> Column:
    return F.coalesce(
        F.sha2(F.concat_ws("\x1f", F.lit("notification-v1"), key, seq.cast("string")), 256), F.lit("")
    )


def outbox(folded: DataFrame, events: DataFrame, order: str = "arrival") -> DataFrame:
    """Pending notifications of one fold, with a stable idempotency key and JSON payload."""
    sent = folded.where("enqueued").select("incident_key", "ts_s", "ord", "count", "seq")
    src = events.select(
        "incident_key", F.col(order).alias("ord"), "id", "source_id", "decision", "judgment"
    )
    d = sent.join(src, ["incident_key", "ord"]).withColumn(
        "notification_id", notification_id(F.col("incident_key"), F.col("seq"))
    )
    payload = F.to_json(F.struct(
        F.lit(2).alias("schema"), "notification_id", F.col("incident_key").alias("incident_id"),
        F.col("id").alias("event_id"), "source_id", "decision", "judgment",
        F.col("count").alias("recurrence_count"), F.col("ts_s").alias("observed_at"),
    ))
    return d.select(
        "notification_id", "incident_key", payload.alias("payload"), F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("attempts"), F.col("ts_s").alias("due"), F.col("ts_s").alias("updated"),
    )


def incident_table(folded: DataFrame) -> DataFrame:
    """Latest state per incident."""
    state = F.struct("count", "level", "last", "seq", F.col("ts_s").alias("touched"), "last_decision")
    return folded.groupBy("incident_key").agg(
        F.max_by(state, F.struct("ts_s", "ord")).alias("_s")
    ).select("incident_key", "_s.*")


def with_latest_notification(incidents: DataFrame, box: DataFrame) -> DataFrame:
    """Each incident beside the notification of its current sequence number."""
    latest = box.select("notification_id", "payload", "status", "attempts")
    return incidents.withColumn(
        "notification_id", notification_id(F.col("incident_key"), F.col("seq"))
    ).join(latest, "notification_id", "left")


def controller_status(incidents: DataFrame, box: DataFrame) -> DataFrame:
    """Incident count, pending and dead notifications in one row."""
    a = incidents.agg(F.count(F.lit(1)).alias("incident_count")).withColumn("_j", F.lit(1))
    b = box.agg(
        F.count_if(F.col("status") == "pending").alias("outbox_pending"),
        F.count_if(F.col("status") == "dead").alias("outbox_dead"),
    ).withColumn("_j", F.lit(1))
    return a.join(b, "_j").drop("_j")


def recent_incidents(incidents: DataFrame, n: int = 20) -> DataFrame:
    return incidents.orderBy(F.desc("touched"), "incident_key").limit(n)


def due_notifications(box: DataFrame, now: int, n: int | None = None) -> DataFrame:
    """Pending and due, oldest first."""
    due = box.where((F.col("status") == "pending") & (F.col("due") <= now)).orderBy("due", "notification_id")
    return due.limit(n) if n else due


def lease(box: DataFrame, now: int) -> DataFrame:
    """Outbox after every due notification was leased once; exhausted ones turn dead."""
    due = (F.col("status") == "pending") & (F.col("due") <= now)
    spent = due & (F.col("attempts") >= MAX_ATTEMPTS)
    take = due & ~spent
    return box.select(
        "notification_id", "incident_key", "payload",
        F.when(spent, "dead").otherwise(F.col("status")).alias("status"),
        F.when(take, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(take, F.lit(now + LEASE_SECONDS)).otherwise(F.col("due")).cast("bigint").alias("due"),
        F.when(due, F.lit(now)).otherwise(F.col("updated")).cast("bigint").alias("updated"),
    )


def record_delivery(box: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """Outbox after delivery results ``(notification_id, attempts, ok)`` were recorded.

    A result counts only for the attempt it belongs to. Failures wait 2^attempts seconds and
    turn dead after the eighth.
    """
    r = results.select("notification_id", F.col("attempts").alias("_a"), F.col("ok").alias("_ok"))
    d = box.join(r, "notification_id", "left").withColumn(
        "_hit", F.coalesce(F.col("_a") == F.col("attempts"), F.lit(False))
    )
    status = F.when(F.col("_ok"), "delivered").when(
        F.col("attempts") >= MAX_ATTEMPTS, "dead").otherwise("pending")
    wait = F.pow(F.lit(2), F.least(F.col("attempts"), F.lit(8))).cast("bigint")
    return d.select(
        "notification_id", "incident_key", "payload",
        F.when(F.col("_hit"), status).otherwise(F.col("status")).alias("status"), "attempts",
        F.when(F.col("_hit"), F.lit(now) + wait).otherwise(F.col("due")).cast("bigint").alias("due"),
        F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated")).cast("bigint").alias("updated"),
    )


_OLD_PAYLOAD = (
    "schema int, notification_id string, incident_id string, decision string, "
    "recurrence_count bigint, observed_at bigint, source string, judgment struct<"
    "importance:string,severity:string,category:string,importance_confidence:double,"
    "severity_confidence:double,category_confidence:double,analysis_error:string>"
)


def _readable_old(box_row: str = "_o") -> Column:
    """A version-1 payload that belongs to its row and has a decision."""
    o = F.col(box_row)
    return F.coalesce(
        (o["schema"] == 1) & (o["notification_id"] == F.col("notification_id")) & (o["incident_id"] == F.col("incident_key"))
        & o["decision"].isin("notify", "review") & o["observed_at"].isNotNull() & o["recurrence_count"].isNotNull(), F.lit(False),
    )


def upgrade_payloads(box: DataFrame) -> DataFrame:
    """Rewrite version-1 payloads to the opaque version-2 form.

    The source record is replaced by its hash and an invalid verdict by unknown. A payload that can't be
    read, belongs to another row or has no decision stays as it is; ``payload_violations`` names it.
    """
    d = box.withColumn("_o", F.from_json("payload", _OLD_PAYLOAD))
    j = F.when(C.valid_judgment("_o.judgment"), F.col("_o.judgment")).otherwise(
        C.unknown("migrated judgment requires review")
    )
    event = F.substring(F.sha2(F.concat_ws(
        "\x1f", "notification_id", F.col("_o.observed_at").cast("string")), 256), 1, 20)
    new = F.to_json(F.struct(
        F.lit(2).alias("schema"), "notification_id", F.col("incident_key").alias("incident_id"),
        event.alias("event_id"), F.sha2("_o.source", 256).alias("source_id"),
        F.col("_o.decision").alias("decision"), j.alias("judgment"),
        F.col("_o.recurrence_count").alias("recurrence_count"),
        F.col("_o.observed_at").alias("observed_at"),
    ))
    return d.withColumn("payload", F.when(_readable_old(), new).otherwise(F.col("payload"))).drop("_o")


_PAYLOAD = (
    "schema int, notification_id string, incident_id string, event_id string, source_id string, decision string, "
    "recurrence_count bigint, observed_at bigint, judgment struct<"
    "importance:string,severity:string,category:string,importance_confidence:double,"
    "severity_confidence:double,category_confidence:double,analysis_error:string>"
)


# The error texts that a verdict may carry.
_KNOWN_ERRORS = (
    "provider analysis unavailable", "invalid provider judgment", "stale template generation",
    "group verdict requires independent review", "analysis cancelled", "migrated judgment requires review",
)


def _judgment_fits(j: Column) -> Column:
    """Known names and error texts, confidences missing or between 0 and 1."""
    named = (
        j["importance"].isin(*S.IMPORTANCE, "unknown") & j["severity"].isin(*S.SEVERITY, "unknown")
        & j["category"].isin(*S.CATEGORY, "unknown")
    )
    for c in ("importance", "severity", "category"):
        named = named & F.coalesce(j[f"{c}_confidence"].between(0, 1), j[f"{c}_confidence"].isNull())
    return F.coalesce(named & F.coalesce(j["analysis_error"], F.lit("")).isin("", *_KNOWN_ERRORS), F.lit(False))


def payload_violations(box: DataFrame) -> DataFrame:
    """Outbox rows whose ids or version-2 payload break the format, with the first reason."""
    hex64 = r"^[0-9a-fA-F]{64}\z"
    d = box.withColumn("_p", F.from_json("payload", _PAYLOAD))

    def other(c: str, pattern: str) -> Column:
        return ~F.coalesce(F.col(c).rlike(pattern), F.lit(False))

    reason = (
        F.when(other("notification_id", hex64) | other("incident_key", hex64), "bad_id")
        .when(F.octet_length("payload") > 131072, "oversized")
        .when(~F.coalesce(F.col("_p.schema") == 2, F.lit(False)), "bad_schema")
        .when(F.col("_p.notification_id").isNull() | (F.col("_p.notification_id") != F.col("notification_id"))
              | F.col("_p.incident_id").isNull() | (F.col("_p.incident_id") != F.col("incident_key")), "id_mismatch")
        .when(other("_p.event_id", r"^(?:[a-f0-9]{20}|[a-f0-9]{64})\z"), "bad_event_id")
        .when(other("_p.source_id", hex64), "bad_source_id")
        .when(~F.coalesce(F.col("_p.decision").isin("notify", "review"), F.lit(False)), "bad_decision")
        .when(~_judgment_fits(F.col("_p.judgment")), "bad_judgment")
        .when(~F.coalesce((F.col("_p.recurrence_count") >= 1) & (F.col("_p.observed_at") >= 0), F.lit(False)), "bad_count")
        .when(~F.coalesce(F.col("status").isin("pending", "delivered", "dead"), F.lit(False)), "bad_status")
        .when(~F.coalesce((F.col("attempts") >= 0) & (F.col("attempts") <= MAX_ATTEMPTS), F.lit(False)), "bad_attempts")
    )
    return d.withColumn("reason", reason).where("reason IS NOT NULL").select("notification_id", "reason")


def incident_violations(incidents: DataFrame) -> DataFrame:
    """Incident rows outside their allowed ranges, with the reason."""
    reason = (
        F.when(~F.col("incident_key").rlike(r"^[0-9a-fA-F]{64}\z"), "bad_id")
        .when((F.col("count") < 0) | (F.col("count") > 1000000000), "bad_count")
        .when((F.col("level") < 0) | (F.col("level") > 32), "bad_level")
        .when(F.col("seq") < 0, "bad_sequence")
        .when(F.col("last_decision").isNotNull() & ~F.col("last_decision").isin("notify", "review"), "bad_decision")
    )
    return incidents.withColumn("reason", reason).where("reason IS NOT NULL").select("incident_key", "reason")
