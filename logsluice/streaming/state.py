"""Keyed state for verdict reuse and incidents on unbounded event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import classify as C
from ..schema import JUDGMENT
from ..functions.classify import Policy
from ..functions.templates import families
from ..operators import incidents as I
from .ordered import SortedRuns


def _millis(seconds: int | None) -> int | None:
    return None if seconds is None else seconds * 1000


_REUSE_STATE = (
    "held boolean, stale boolean, expires bigint, seen bigint, audit_at bigint, step bigint, "
    "rep string, verdict string, high bigint"
)
REUSE_OUT = (
    "template_key string, id string, arrival bigint, reused boolean, reason string, "
    "representative_id string, verdict string"
)


class ReuseVerdicts(StatefulProcessor):
    """One family: the verdict in force, its expiry and its next audit."""

    def __init__(self, ttl: int, adaptive: bool, max_interval: int, keep_s: int | None, stamped: bool):
        self.ttl, self.adaptive, self.max_interval, self.keep_s = ttl, adaptive, max_interval, keep_s
        self.order = ["arrival"] if stamped else ["ts_s", "arrival"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("family", _REUSE_STATE, _millis(self.keep_s))
        self.runs = SortedRuns(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, stale, expires, seen, audit_at, step, rep, verdict, high = (
            self.state.get() if self.state.exists()
            else (False, False, 0, 0, 0, 16, None, None, 0)
        )
        for todo in self.runs.in_order(rows, self.order):
            out = []
            for r in todo.itertuples(index=False):
                seen += 1
                rollback, high = bool(r.rollback) or r.ts_s < high and self.order[0] == "ts_s", max(high, r.ts_s)
                alive = held and r.ts_s < expires and not rollback
                if alive and not (self.adaptive and seen >= audit_at):
                    out.append((key[0], r.id, r.arrival, True, "cached", rep, verdict))
                    continue
                stale = stale or (held and not alive) or rollback
                reason = (
                    "clock_rollback" if rollback else "stable_audit" if alive
                    else "cache_expired" if stale else "new_or_expired"
                )
                held = bool(r.seeds)
                if held:
                    stale, expires, rep, verdict = False, int(r.ts_s) + self.ttl, r.id, r.judgment
                    step = min(self.max_interval, max(32, step * 2)) if r.routine else 32
                    audit_at = seen + step
                out.append((key[0], r.id, r.arrival, False, reason, None, r.judgment))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REUSE_OUT.split(", ")])
        self.state.update((held, stale, int(expires), int(seen), int(audit_at), int(step), rep, verdict, int(high)))

    def close(self) -> None:
        pass


def reuse_stream(events: DataFrame, ttl: int = 60, adaptive: bool = False, max_interval: int = 1024,
                 keep_s: int | None = None) -> DataFrame:
    """Streaming form of ``reuse_verdicts`` for groupable events; ``verdict`` is JSON.

    ``judgment`` is what the judge answers for the event alone. Events without a clock are judged on their
    own. A column ``clock_rollback``, as ``lane.stamp_sink`` gives it, tells which clocks ran backwards on the lane, and events are taken in
    the order of arrival. Without it a clock counts as rolled back against the newest one of its family, whose events are taken by clock. A family unheard of for ``keep_s`` seconds of
    the wall clock starts anew; None keeps it. Expiry follows the wall clock, so a stream with it runs on a
    processing-time trigger and never counts as drained.
    """
    seeds = C.reusable("judgment") & ~F.col("truncated") & ~F.col("sensitive") & ~F.col("parse_uncertain")
    stamped = "clock_rollback" in events.columns
    rollback = F.coalesce("clock_rollback", F.lit(False)) if stamped else F.lit(False)
    d = families(events).select(
        "template_key", "id", "arrival", "ts_s", rollback.alias("rollback"), seeds.alias("seeds"),
        F.coalesce(F.col("judgment.importance") == "routine", F.lit(False)).alias("routine"),
        F.to_json("judgment").alias("judgment"),
    )
    timed = d.where("ts_s IS NOT NULL").groupBy("template_key").transformWithStateInPandas(
        statefulProcessor=ReuseVerdicts(ttl, adaptive, max_interval, keep_s, stamped), outputStructType=REUSE_OUT,
        outputMode="Append", timeMode="None" if keep_s is None else "ProcessingTime",
    )
    return timed.unionByName(d.where("ts_s IS NULL").select(
        "template_key", "id", "arrival", F.lit(False).alias("reused"), F.lit("no_clock").alias("reason"),
        F.lit(None).cast("string").alias("representative_id"), F.col("judgment").alias("verdict"),
    ))


_INCIDENT_STATE = (
    "anchor bigint, count bigint, level bigint, last bigint, seq bigint, prev string"
)
_INCIDENT_OUT = (
    "incident_key string, ts_s bigint, ord bigint, id string, source_id string, decision string, "
    "count bigint, level bigint, seq bigint, judgment string"
)


class FoldIncidents(StatefulProcessor):
    """One incident: recurrence window, escalation level, cooldown. Emits what is enqueued."""

    def __init__(self, policy: Policy, keep_s: int | None):
        self.policy, self.keep_s = policy, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("incident", _INCIDENT_STATE, _millis(self.keep_s))
        self.runs = SortedRuns(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        p = self.policy
        anchor, count, level, last, seq, prev = (
            self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, None)
        )
        for todo in self.runs.in_order(rows, ["ts_s", "arrival"]):
            out = []
            for r in todo.itertuples(index=False):
                now = int(r.ts_s)
                if now < anchor or now - anchor >= p.window:
                    anchor, count, level = now, 0, 0
                count += 1
                reached = min(p.max_escalation, count // p.recurrence)
                send = (
                    seq == 0 or now < last or now - last >= p.cooldown or reached > level
                    or (r.decision == "notify" and prev != "notify")
                )
                level = max(level, reached)
                if send:
                    seq, last, prev = seq + 1, now, r.decision
                    out.append((key[0], now, r.arrival, r.id, r.source_id, r.decision, count, level, seq, r.judgment))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _INCIDENT_OUT.split(", ")])
        self.state.update((anchor, count, level, last, seq, prev))

    def close(self) -> None:
        pass


def incident_stream(events: DataFrame, policy: Policy = Policy(), keep_s: int | None = None) -> DataFrame:
    """Notifications to enqueue from a stream of decided events.

    An incident unheard of for ``keep_s`` seconds of the wall clock starts anew, its sequence numbers
    too; None keeps it. A stream with expiry runs on a processing-time trigger.
    """
    d = events.where(F.col("decision").isin("notify", "review")).select(
        "incident_key", F.coalesce("ts_s", F.lit(0)).alias("ts_s"), "arrival", "id", "source_id", "decision",
        F.to_json("judgment").alias("judgment"),
    )
    return d.groupBy("incident_key").transformWithStateInPandas(
        statefulProcessor=FoldIncidents(policy, keep_s), outputStructType=_INCIDENT_OUT,
        outputMode="Append", timeMode="None" if keep_s is None else "ProcessingTime",
    )


def to_outbox(sent: DataFrame) -> DataFrame:
    """Outbox rows of enqueued notifications; the id depends only on incident and sequence."""
    nid = I.notification_id(F.col("incident_key"), F.col("seq"))
    payload = F.to_json(F.struct(
        F.lit(2).alias("schema"), nid.alias("notification_id"), F.col("incident_key").alias("incident_id"),
        F.col("id").alias("event_id"), "source_id", "decision",
        F.from_json("judgment", JUDGMENT).alias("judgment"),
        F.col("count").alias("recurrence_count"), F.col("ts_s").alias("observed_at"),
    ))
    return sent.select(
        nid.alias("notification_id"), "incident_key", payload.alias("payload"), F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("attempts"), F.col("ts_s").alias("due"), F.col("ts_s").alias("updated"),
    )
