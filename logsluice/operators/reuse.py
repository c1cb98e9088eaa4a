"""Reuse of verdicts over time: lookup, expiry, audits, rollback and invalidation.

Clocks are whole unix seconds. One event per batch: an event sees every earlier verdict of its
family. A family that owns a large share of the input is first reduced to one row per second: how
many events it had, at which of them the kind of verdict changes, and the stretches of events whose clock ran backwards. The
sequential part jumps over certain hits and takes such a stretch as one, so its rows are bounded by time and its steps by the
number of judge calls and changes, also when one clock far in the future makes all later ones run backwards.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C
from ..functions.templates import families, outside_families
from ..session import cut_lineage
from .scale import ROWS_PER_BLOCK, numbered, ordered_fold, preceding_max, running_rank, with_block


def clock_rollback(events: DataFrame, order: str = "arrival", clock: str = "ts_s") -> DataFrame:
    """Flag events whose clock lies below the largest one seen earlier on the whole lane."""
    return lane_clock(events, order, clock).drop("lane_s")


def lane_clock(events: DataFrame, order: str = "arrival", clock: str = "ts_s") -> DataFrame:
    """Add ``clock_rollback`` and ``lane_s``, the largest clock of the lane up to the event itself.

    ``lane_s`` never falls in arrival order; it is null only before the first clock.
    """
    d = preceding_max(with_block(events, order, ROWS_PER_BLOCK), [], [order], F.col(clock), "_high")
    return d.withColumn(
        "clock_rollback", F.coalesce(F.col(clock) < F.col("_high"), F.lit(False))
    ).withColumn("lane_s", F.greatest(clock, "_high")).drop("_high", "_block")


def audit_points(max_interval: int = 1024) -> tuple[list[int], int]:
    """(first audits, last of them): intervals double from 32 up to ``max_interval``."""
    points, at, step = [1], 1, 16
    while True:
        step = min(max_interval, max(32, step * 2))
        at += step
        points.append(at)
        if step == max_interval:
            return points, at


def audit_due(seen: Column, max_interval: int = 1024, important: bool = False) -> Column:
    """Whether the ``seen``-th event of a family with stable reusable verdicts is judged again."""
    if important:
        return (seen - 1) % 32 == 0
    points, last = audit_points(max_interval)
    return seen.isin(points) | ((seen > last) & ((seen - last) % max_interval == 0))


def audit_schedule(events: DataFrame, key: str = "template_key", order: str = "arrival",
                   clock: str = "ts_s", max_interval: int = 1024) -> DataFrame:
    """Add ``seen`` (ordinal in the family) and ``audit`` for families with stable verdicts."""
    d = running_rank(
        families(events).withColumn("_block", F.coalesce(F.col(clock), F.lit(0))),
        [key], [clock, order], "seen",
    ).drop("_block")
    return d.withColumn("audit", audit_due(F.col("seen"), max_interval))


_FOLD_SCHEMA = (
    "template_key string, lane_s bigint, intervals array<struct<a:bigint,b:bigint,first:string,rest:string,seeded:boolean>>, "
    "entry_s bigint, entry_n bigint"
)


def _stretches(a: int, b: int, seeds: bool, seed_flips: list[int], routine: bool, routine_flips: list[int]) -> Iterator[tuple[int, bool, bool]]:
    """(events, seeds, routine) of the parts of a..b in which neither changes."""
    k, m = bisect_right(seed_flips, a), bisect_right(routine_flips, a)
    while a <= b:
        end = min(seed_flips[k] if k < len(seed_flips) else b + 1, routine_flips[m] if m < len(routine_flips) else b + 1, b + 1)
        yield end - a, seeds != (k % 2 == 1), routine != (m % 2 == 1)
        a = end
        k += k < len(seed_flips) and seed_flips[k] == a
        m += m < len(routine_flips) and routine_flips[m] == a


def _reuse_fold(ttl: int, adaptive: bool, max_interval: int):
    """One row per (family, second) to the judged stretches of that second and the verdict held on entry.

    In a stretch from ``a`` to ``b`` every event is judged; the last one's verdict can be reused if
    it is ``seeded``. All events outside the stretches are hits.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.template_key != key:
                    key = r.template_key
                    held = stale = False
                    expires, seen, audit_at, step, rep = 0, 0, 0, 16, (None, None)
                entry = rep if held else (None, None)
                now, seed_flips, routine_flips = int(r.lane_s), list(r.seed_flips), list(r.routine_flips)
                back = [(int(a), int(x["n"]), int(x["s"])) for a, x in zip(r.back_from, r.back_to)] + [(r.n + 1, 0, 0)]
                found, i = [], 1
                while i <= r.n:
                    stop = back[0][0]
                    if i == stop:
                        # All of a stretch is judged; what is held behind it is the last one's verdict.
                        _, last, clock = back.pop(0)
                        for some, seeds_, routine_ in _stretches(i, last, bool(r.seeds), seed_flips, bool(r.routine), routine_flips):
                            if seeds_:
                                step = min(max_interval, step << min(some, 16)) if routine_ else 32
                            held, stale = seeds_, not seeds_
                        found.append({"a": i, "b": last, "first": "clock_rollback", "rest": "clock_rollback", "seeded": held})
                        seen += last - i + 1
                        i = last + 1
                        if held:
                            expires, rep, audit_at = clock + ttl, (now, last), seen + step
                        continue
                    until = stop - 1
                    if held and now < expires:
                        # Jump over the events that are certain hits.
                        hits = until - i + 1
                        if adaptive:
                            hits = min(hits, max(0, audit_at - seen - 1))
                        if hits:
                            seen += hits
                            i += hits
                            continue
                        reason = "stable_audit"
                    else:
                        # An expired family stays marked until a reusable verdict replaces it.
                        stale = stale or held
                        reason = "cache_expired" if stale else "new_or_expired"
                    after = "cache_expired" if stale else "new_or_expired"
                    # Judged one by one up to the first reusable verdict.
                    k = bisect_right(seed_flips, i)
                    seeded, last = True, i
                    if bool(r.seeds) == (k % 2 == 1):
                        last = seed_flips[k] if k < len(seed_flips) else until + 1
                    if last > until:
                        seeded, last = False, until
                    found.append({"a": i, "b": last, "first": reason, "rest": after, "seeded": seeded})
                    seen += last - i + 1
                    i = last + 1
                    held = seeded
                    if seeded:
                        routine = bool(r.routine) != (bisect_right(routine_flips, last) % 2 == 1)
                        stale, expires, rep = False, now + ttl, (now, last)
                        step = min(max_interval, max(32, step * 2)) if routine else 32
                        audit_at = seen + step
                out.append((key, now, found, *entry))
            yield pd.DataFrame(out, columns=["template_key", "lane_s", "intervals", "entry_s", "entry_n"]).astype(
                {"entry_s": "Int64", "entry_n": "Int64"}
            )

    return fold


def seconds_of(fam: DataFrame, adaptive: bool, order: str) -> tuple[DataFrame, DataFrame]:
    """(events numbered ``_n`` inside (family, second), one row per (family, second) for the fold)."""
    keys = ["template_key", "lane_s"]
    fam = numbered(fam, keys, order, ["_seeds", "_routine", "clock_rollback", "ts_s"])
    fell, rose = F.col("_prev.clock_rollback"), F.col("clock_rollback")
    fam = fam.withColumns({
        "_sf": F.coalesce(F.col("_prev._seeds") != F.col("_seeds"), F.lit(False)),
        "_rf": F.coalesce(F.col("_prev._routine") != F.col("_routine"), F.lit(False)) & F.lit(adaptive),
    })

    def places(flag: Column, value: Column = F.col("_n")):
        return F.sort_array(F.collect_list(F.when(flag, value)))

    # A stretch of clocks that ran backwards ends with the row before, or with the second.
    ends = places(fell & ~rose, F.struct((F.col("_n") - 1).alias("n"), F.col("_prev.ts_s").alias("s")))
    last = F.max(F.struct(F.col("_n").alias("n"), F.col("ts_s").alias("s"), rose.alias("back")))
    rows = fam.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("_seeds", "_n").alias("seeds"), F.min_by("_routine", "_n").alias("routine"),
        places(F.col("_sf")).alias("seed_flips"), places(F.col("_rf")).alias("routine_flips"),
        places(rose & ~F.coalesce(fell, F.lit(False))).alias("back_from"), ends.alias("_ends"), last.alias("_last"),
    )
    end = F.array(F.struct(F.col("_last.n").alias("n"), F.col("_last.s").alias("s")))
    rows = rows.withColumn("back_to", F.when(F.col("_last.back"), F.concat("_ends", end)).otherwise(F.col("_ends"))).drop("_ends", "_last")
    return fam.drop("_sf", "_rf", "_prev"), rows


def reuse_verdicts(
    events: DataFrame,
    ttl: int = 60,
    adaptive: bool = False,
    max_interval: int = 1024,
    vetoes: DataFrame | None = None,
    order: str = "arrival",
) -> DataFrame:
    """Decide for every groupable event whether it is judged or copies an earlier verdict.

    Needs ``template_key, ts_s, id, judgment, truncated, sensitive, parse_uncertain`` where
    ``judgment`` is what the judge answers for that event alone. Events are taken in the order of
    arrival. A verdict lives ``ttl`` seconds from its judging and is not extended by hits. An event
    whose clock lies below the lane's newest is judged again and so is its family until a reusable verdict
    comes. Adds ``reason``, ``reused``, ``representative_id``, ``verdict``. Ineligible events and those
    without a clock are judged on their own.
    """
    seeds = C.reusable("judgment") & ~F.col("truncated") & ~F.col("sensitive") & ~F.col("parse_uncertain")
    keep = events.columns
    d = lane_clock(events, order).withColumns({
        "_seeds": seeds, "_routine": F.coalesce(F.col("judgment.importance") == "routine", F.lit(False)),
    })
    if vetoes is not None:
        marks = vetoes.select("template_key").distinct().withColumn("_veto", F.lit(True))
        d = d.join(marks, "template_key", "left").withColumn("_veto", F.col("_veto").isNotNull())
    else:
        d = d.withColumn("_veto", F.lit(False))
    # Written once: the fold, the placing and the copied verdicts all read it.
    d = cut_lineage(d)
    grouped = families(d)
    fam, rows = seconds_of(grouped.where("ts_s IS NOT NULL AND NOT _veto"), adaptive, order)
    points = ordered_fold(rows, ["template_key"], ["lane_s"], _reuse_fold(ttl, adaptive, max_interval), _FOLD_SCHEMA)
    points = cut_lineage(points)
    placed = fam.join(points, ["template_key", "lane_s"]).withColumn(
        "_iv", F.get(F.reverse(F.filter("intervals", lambda x: x["a"] <= F.col("_n"))), F.lit(0))
    )
    judged = F.coalesce(F.col("_n") <= F.col("_iv.b"), F.lit(False))
    placed = placed.select(
        *keep, (~judged).alias("reused"),
        F.when(~judged, "cached").when(F.col("_n") == F.col("_iv.a"), F.col("_iv.first")).otherwise(F.col("_iv.rest")).alias("reason"),
        F.when(~judged, F.when(F.col("_iv").isNotNull(), F.col("lane_s")).otherwise(F.col("entry_s"))).alias("_rep_s"),
        F.when(~judged, F.coalesce("_iv.b", "entry_n")).alias("_rep_n"),
    )
    # The judged events themselves give the id and verdict that later members copy.
    source = points.select("template_key", "lane_s", F.explode(F.filter("intervals", lambda x: x["seeded"])["b"]).alias("_n"))
    copied = source.join(fam, ["template_key", "lane_s", "_n"]).select(
        "template_key", F.col("lane_s").alias("_rep_s"), F.col("_n").alias("_rep_n"),
        F.col("id").alias("representative_id"), F.col("judgment").alias("_copied"),
    )
    done = placed.join(copied, ["template_key", "_rep_s", "_rep_n"], "left").select(
        *keep, "reused", "reason", "representative_id",
        F.when(F.col("reused"), F.col("_copied")).otherwise(F.col("judgment")).alias("verdict"),
    )

    def judged_alone(rows: DataFrame, reason) -> DataFrame:
        return rows.select(
            *keep, F.lit(False).alias("reused"), reason.alias("reason"),
            F.lit(None).cast("string").alias("representative_id"), F.col("judgment").alias("verdict"),
        )

    alone = judged_alone(
        grouped.where("ts_s IS NULL OR _veto"), F.when(F.col("_veto"), "review_required").otherwise("no_clock")
    )
    return done.unionByName(alone).unionByName(judged_alone(outside_families(d), F.lit("ineligible")))


def lookup_verdicts(requests: DataFrame, verdicts: DataFrame, ttl: int, key: str = "key",
                    now: str = "now", order: str = "seq") -> DataFrame:
    """As-of lookup of stored verdicts; adds ``verdict`` (NULL on a miss) and ``hit``.

    Each key holds its latest stored verdict, valid while ``created <= now < min(expires,
    created + ttl)``. A lookup outside that span deletes the row, so later lookups of the key
    (in ``order``) miss even if their clock lies inside it again.
    """
    latest = verdicts.groupBy(key).agg(
        F.max_by(F.struct("created", "expires", "judgment"), "created").alias("_v")
    )
    valid = (
        (F.col(now) >= F.col("_v.created")) & (F.col(now) < F.col("_v.expires"))
        & (F.col(now) - F.col("_v.created") < ttl)
    )
    d = requests.join(latest, key, "left").withColumn("_valid", F.coalesce(valid, F.lit(False)))
    dropped = (
        d.where(F.col("_v").isNotNull() & ~F.col("_valid"))
        .groupBy(key).agg(F.min(order).alias("_gone"))
    )
    hit = F.col("_valid") & C.reusable("_v.judgment") & (
        F.col("_gone").isNull() | (F.col(order) < F.col("_gone"))
    )
    return (
        d.join(dropped, key, "left").withColumn("hit", hit)
        .withColumn("verdict", F.when(F.col("hit"), F.col("_v.judgment")))
        .drop("_v", "_valid", "_gone")
    )


def refresh_cache(cache: DataFrame, judged: DataFrame, ttl: int) -> DataFrame:
    """New state of the verdict table after one round of judging.

    ``judged`` carries ``key, now, judgment, mode`` (default, refresh or bypass) and ``unsafe``.
    Unsafe, refreshed and bypassed keys lose their old row first; only safe, reusable and not
    bypassed verdicts are stored.
    """
    drop = judged.where(F.col("unsafe") | (F.col("mode") != "default")).select("key").distinct()
    stored = (
        judged.where(
            ~F.col("unsafe") & (F.col("mode") != "bypass")
            & C.valid_judgment("judgment") & C.reusable("judgment")
        )
        .groupBy("key")
        .agg(F.max_by(F.struct("judgment", F.col("now").alias("created"), (F.col("now") + ttl).alias("expires")), "now").alias("_r"))
        .select("key", "_r.*")
    )
    kept = cache.join(drop, "key", "left_anti").join(stored.select("key"), "key", "left_anti")
    return kept.select("key", "judgment", "created", "expires").unionByName(
        stored.select("key", "judgment", "created", "expires")
    )


def live_rows(table: DataFrame, now: Column, expires: str = "expires") -> DataFrame:
    """Rows that have not expired."""
    return table.where(now < F.col(expires))


def veto_flag(events: DataFrame, vetoes: DataFrame, key: str = "template_key") -> DataFrame:
    """Add ``vetoed``: the family's verdicts may never be reused."""
    marks = vetoes.select(key).distinct().withColumn("_veto", F.lit(True))
    return events.join(marks, key, "left").withColumn("vetoed", F.col("_veto").isNotNull()).drop("_veto")
