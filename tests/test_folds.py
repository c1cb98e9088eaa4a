"""Verdict reuse and incidents against straightforward sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from logsluice.functions import classify as C
from logsluice.functions.classify import Policy
from logsluice.operators import incidents as I, reuse as U, scale, usage as G


def fold_reuse(rows, ttl, adaptive, cap):
    out, state, high = {}, {}, None
    for key, s, arrival, seeds, routine in sorted(rows, key=lambda r: r[2]):
        if s is None:
            out[arrival] = ("no_clock", None)
            continue
        rollback, high = high is not None and s < high, s if high is None else max(s, high)
        held, stale, expires, seen, audit, step, rep = state.get(key, (False, False, 0, 0, 0, 16, None))
        seen += 1
        alive = held and s < expires and not rollback
        if alive and not (adaptive and seen >= audit):
            out[arrival] = ("cached", rep)
        else:
            stale = stale or (held and not alive) or rollback
            why = "clock_rollback" if rollback else "stable_audit" if alive else "cache_expired" if stale else "new_or_expired"
            out[arrival] = (why, None)
            held = seeds
            if seeds:
                stale, expires, rep = False, s + ttl, str(arrival)
                step = min(cap, max(32, step * 2)) if routine else 32
                audit = seen + step
        state[key] = held, stale, expires, seen, audit, step, rep
    return out


def reuse_frame(spark, rows):
    df = spark.createDataFrame(rows, "template_key string, ts_s long, arrival long, seeds boolean, routine boolean")
    j = C.judgment(
        F.when(F.col("routine"), "routine").otherwise("important"), "info", "data",
        F.when(F.col("seeds"), 0.9).otherwise(0.1), F.lit(0.9), F.lit(0.9),
    )
    return df.select(
        "template_key", "ts_s", "arrival", F.col("arrival").cast("string").alias("id"), j.alias("judgment"),
        *[F.lit(False).alias(n) for n in ("truncated", "sensitive", "parse_uncertain")],
    )


@pytest.mark.parametrize("adaptive,cap", [(False, 1024), (True, 64)])
def test_reuse_matches_sequential(spark, adaptive, cap):
    rng = random.Random(cap)
    rows = []
    for i in range(3000):
        key = rng.choice("aaaaaabc")  # one family owns most rows
        at = None if rng.random() < 0.05 else i // 25 - (rng.randint(0, 30) if rng.random() < 0.02 else 0)
        rows.append((key, at, i, rng.random() < (0.97 if key == "a" else 0.4), rng.random() < 0.7))
    got = {
        r.arrival: (r.reason, r.representative_id)
        for r in U.reuse_verdicts(reuse_frame(spark, rows), 20, adaptive, cap).collect()
    }
    assert got == fold_reuse(rows, 20, adaptive, cap)


def test_fold_rows_follow_seconds_not_changes(spark):
    """One family that alternates between two kinds of reusable verdict, and one call."""
    rows = [("t", i // 5000, i, True, i % 2 == 0) for i in range(20_000)]
    df = U.lane_clock(reuse_frame(spark, rows)).withColumns({"_seeds": F.lit(True), "_routine": F.col("judgment.importance") == "routine"})
    for adaptive in (False, True):
        assert U.seconds_of(df, adaptive, "arrival")[1].count() == 4
    got = U.reuse_verdicts(reuse_frame(spark, rows), 60).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {"new_or_expired": 1, "cached": 19_999}


def test_one_clock_far_in_the_future(spark, monkeypatch):
    """All later events ran backwards: a stretch is one entry, whatever its length, and is placed block by block."""
    rng = random.Random(11)
    rows = [(rng.choice("aab"), 10 ** 10 if i == 40 else i // 10, i, rng.random() < 0.8, rng.random() < 0.6) for i in range(4000)]
    df = U.lane_clock(reuse_frame(spark, rows)).withColumns({
        "_seeds": F.lit(True), "_routine": F.col("judgment.importance") == "routine"})
    for wide in (scale.WIDE, 100):
        monkeypatch.setattr(scale, "WIDE", wide)
        folded = U.seconds_of(df, False, "arrival")[1].collect()
        assert max(len(r.back_from) for r in folded) <= 2 and max(r.n for r in folded) > 1000
        for adaptive, cap in ((False, 1024), (True, 64)):
            got = {r.arrival: (r.reason, r.representative_id) for r in U.reuse_verdicts(reuse_frame(spark, rows), 20, adaptive, cap).collect()}
            assert got == fold_reuse(rows, 20, adaptive, cap)


def test_thousand_events_one_call(spark):
    rows = [("t", i // 20, i, True, True) for i in range(1000)]
    got = U.reuse_verdicts(reuse_frame(spark, rows), 60).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {"new_or_expired": 1, "cached": 999}


def test_audits_and_expiry(spark):
    rows = [("t", 0, i, True, True) for i in range(34)] + [("t", 59, 34, True, True), ("t", 60, 35, True, True)]
    got = {r.arrival: r.reason for r in U.reuse_verdicts(reuse_frame(spark, rows), 60, True, 32).collect()}
    assert [a for a, r in sorted(got.items()) if r == "stable_audit"] == [32]
    plain = {r.arrival: r.reason for r in U.reuse_verdicts(reuse_frame(spark, rows), 60).collect()}
    assert plain[34] == "cached" and plain[35] == "cache_expired"


def test_vetoed_family_is_always_judged(spark):
    rows = [("t", 0, i, True, True) for i in range(5)]
    veto = spark.createDataFrame([("t",)], "template_key string")
    reasons = {r.reason for r in U.reuse_verdicts(reuse_frame(spark, rows), 60, vetoes=veto).collect()}
    assert reasons == {"review_required"}


def test_audit_points(spark):
    seen = spark.range(1, 3200).where(U.audit_due(F.col("id"))).collect()
    assert [r.id for r in seen] == [1, 33, 97, 225, 481, 993, 2017, 3041]


def test_lookup_outside_span_deletes(spark):
    good = C.judgment("routine", "info", "data", F.lit(0.9), F.lit(0.9), F.lit(0.9))
    stored = spark.range(1).select(
        F.lit("k").alias("key"), F.lit(1000).alias("created"), F.lit(1060).alias("expires"), good.alias("judgment"))

    def hits(*times):
        req = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "key string, now long, seq long")
        return [r.hit for r in U.lookup_verdicts(req, stored, 60).orderBy("seq").collect()]

    assert hits(999, 1060, 1001) == [False, False, False]
    assert hits(1000, 1059, 1060, 1001) == [True, True, False, False]


def fold_incidents(rows, p):
    sent = set()
    for key in {r[0] for r in rows}:
        win = count = level = last = seq = 0
        prev = None
        for _, now, arrival, decision in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if now < win or now - win >= p.window:
                win, count, level = now, 0, 0
            count += 1
            new = min(p.max_escalation, count // p.recurrence)
            if seq == 0 or now < last or now - last >= p.cooldown or new > level or (decision == "notify" and prev != "notify"):
                seq, last, prev = seq + 1, now, decision
                sent.add((key, arrival, count, seq, max(level, new)))
            level = max(level, new)
    return sent


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_incidents_match_sequential(spark, seed):
    rng = random.Random(seed)
    p = Policy(window=rng.choice([30, 90]), cooldown=rng.choice([1, 7, 40]), recurrence=rng.choice([2, 5]), max_escalation=rng.choice([2, 8]))
    base = rng.choice([0, 1_700_000_000])
    rows = []
    for i in range(4000):
        key = rng.choice("aaaaabcd")
        # Bursts: many events inside the same second.
        rows.append((key, base + int(rng.random() ** 2 * 300), i, rng.choice(["notify", "review", "review"])))
    df = spark.createDataFrame(rows, "incident_key string, ts_s long, arrival long, decision string")
    got = {
        (r.incident_key, r.ord, r["count"], r.seq, r.level)
        for r in I.fold_incidents(df, p).where("enqueued").collect()
    }
    assert got == fold_incidents(rows, p)


@pytest.mark.parametrize("wide", (scale.WIDE, 50))
def test_incidents_without_clocks(spark, monkeypatch, wide):
    """A third of the events has no clock: they are second 0 of their incident, however many they are."""
    monkeypatch.setattr(scale, "WIDE", wide)
    monkeypatch.setattr(I, "ROWS_PER_BLOCK", 64)
    rng = random.Random(wide)
    p = Policy(window=90, cooldown=7, recurrence=3, max_escalation=5)
    rows = [(rng.choice("aab"), None if rng.random() < 0.4 else 1000 + i // 30, i, rng.choice(["notify", "review", "review"])) for i in range(2500)]
    df = spark.createDataFrame(rows, "incident_key string, ts_s long, arrival long, decision string")
    got = {(r.incident_key, r.ord, r["count"], r.seq, r.level) for r in I.fold_incidents(df, p).where("enqueued").collect()}
    assert got == fold_incidents([(k, s or 0, a, d) for k, s, a, d in rows], p)


def test_outbox_lifecycle(spark):
    box = spark.createDataFrame(
        [("n1", "i1", "{}", "pending", 0, 100, 100)],
        "notification_id string, incident_key string, payload string, status string, attempts long, due long, updated long")
    now = 100
    for attempt in range(1, 9):
        box = I.lease(box, now)
        row = box.first()
        assert (row.attempts, row.due) == (attempt, now + 30)
        result = box.selectExpr("notification_id", "attempts", "false AS ok")
        box = spark.createDataFrame(I.record_delivery(box, result, now).collect(), box.schema)
        now = box.first().due
    assert box.first().status == "dead"
    late = spark.createDataFrame([("n1", 3, True)], "notification_id string, attempts long, ok boolean")
    assert I.record_delivery(box, late, now).first().status == "dead"


def test_budget(spark):
    calls = spark.range(1, 6).select(F.col("id").alias("seq"), F.lit(0).cast("long").alias("request_bytes"))
    prices = G.Prices(1000, 1000)
    rows = G.admit_budget(calls, prices, 16384 * 1000 * 3, 100).orderBy("seq").collect()
    assert [r.admitted for r in rows] == [True, True, True, False, False]
    use = spark.createDataFrame([("risk", 1, True, 100, 50), ("risk", 1, True, None, None)],
                                "kind string, request_bytes long, finished boolean, input_tokens long, output_tokens long")
    r = G.usage_rollup(use, prices).first()
    assert r.cost_nano_usd == 150_000 and r.unmetered == 1 and not r.cost_complete
    assert G.usage_totals(G.usage_rollup(use, prices)).first().total_estimated_cost_usd == pytest.approx(0.00015)
