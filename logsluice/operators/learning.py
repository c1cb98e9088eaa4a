"""Template learning: evidence, when to ask, proposal replay and escalation-only reviews."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions import classify as C, patterns as P, templates as M
from ..session import written
from .scale import ROWS_PER_BLOCK, ordered_fold, running_rank, running_total, with_block

# Occurrence counts at which a family is shown to the teacher after the first.
LATER_THRESHOLDS = (32, 256, 2048)
MAX_DECISIONS = 1000
PROPOSAL_REASONS = ("opaque_identifiers", "stable_structure", "insufficient_evidence")
REVIEW_REASONS = (
    "no_change", "free_text", "pattern_burst", "authentication_failures", "privileged_action",
    "credential_material", "scanning", "upstream_failure", "resource_exhaustion",
    "insufficient_evidence",
)
VAGUE_REASONS = ("pattern_burst", "no_change", "free_text", "insufficient_evidence")
POINTER = r"^/[A-Za-z0-9_/-]{1,127}\z"


def learning_eligible(events: DataFrame) -> Column:
    """Not reviewed by a human, groupable, not limited, not vetoed and not stale."""
    ok = C.groupable("text", "truncated", "sensitive", "parse_uncertain")
    names = events.columns
    if "review" in names:
        ok = ok & F.col("review").isNull()
    if "judgment" in names:
        ok = ok & (F.coalesce(F.col("judgment.analysis_error"), F.lit("")) != "stale template generation")
    if "reason" in names:
        ok = ok & (F.coalesce(F.col("reason"), F.lit("")) != "review_required")
    for flag in ("vetoed", "evidence_limited", "samples_limited"):
        if flag in names:
            ok = ok & ~F.coalesce(F.col(flag), F.lit(False))
    return ok


def template_evidence(events: DataFrame, key: str = "template_key", order: str = "arrival") -> DataFrame:
    """Per family: occurrences, up to eight distinct samples in first-seen order, last verdict."""
    known = M.families(events) if key == "template_key" else events.where(F.col(key).isNotNull())
    d = known.withColumn("_sid", F.xxhash64("text"))
    # Written, as both results below read it and would each build every template again.
    per_text = written(d.groupBy(key, "_sid", "text").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"),
        F.max_by("judgment", order).alias("j"), F.max(order).alias("last"),
    ).drop("_sid"), "family-texts")
    totals = per_text.groupBy(key).agg(
        F.sum("n").alias("occurrences"), F.max_by("j", "last").alias("current_verdict")
    )
    w = Window.partitionBy(key).orderBy("first")
    samples = (
        per_text.select(key, "first", "text").withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= S.MAX_SAMPLES).groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("first", "text"))).alias("_s"))
        .select(key, F.transform("_s", lambda s: s["text"]).alias("samples"))
    )
    return totals.join(samples, key)


def learning_thresholds(events: DataFrame, min_samples: int, key: str = "template_key",
                        clock: str = "ts_s", order: str = "arrival") -> DataFrame:
    """Events at which their family is shown to the teacher, with its occurrence count.

    With one event per batch the limit of two requests per batch cannot bind; ``learning_requests`` has it.
    """
    if not 2 <= min_samples <= 16:
        raise ValueError("between 2 and 16 samples")
    known = M.families(events) if key == "template_key" else events.where(F.col(key).isNotNull())
    ranked = running_rank(
        known.withColumn("_block", F.coalesce(F.col(clock), F.lit(0))),
        [key], [clock, order], "occurrences",
    ).drop("_block")
    return ranked.where(F.col("occurrences").isin(min_samples, *LATER_THRESHOLDS))


#: Requests that one batch makes at most.
REQUESTS_PER_BATCH = 2
#: Touches after a threshold that a family in dispute shows to the fold, for a start.
_WAIT = 64


def batch_touches(events: DataFrame, key: str = "template_key", batch: str = "batch", order: str = "arrival") -> DataFrame:
    """(key, batch, first, occurrences, total): per family and batch its first eligible event and its count up to the batch's end."""
    known = M.families(events) if key == "template_key" else events.where(F.col(key).isNotNull())
    per_batch = known.where(learning_eligible(known)).groupBy(key, batch).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")
    )
    totals = per_batch.groupBy(key).agg(F.sum("n").alias("total"))
    counted = running_total(with_block(per_batch, batch, ROWS_PER_BLOCK), [key], [batch], F.col("n"), "occurrences")
    return counted.join(totals, key).select(key, batch, "first", "occurrences", "total")


def learning_requests(
    events: DataFrame, min_samples: int, key: str = "template_key", batch: str = "batch", order: str = "arrival",
    per_batch: int = REQUESTS_PER_BATCH, wait: int = _WAIT,
) -> DataFrame:
    """(key, batch, first, occurrences, request): the requests to the teacher, ``per_batch`` at most in each batch.

    A family asks when its count has reached its next threshold (``min_samples``, then ``LATER_THRESHOLDS``), once in a batch; families ask in
    the order of their first events in the batch. One that is refused asks again in the next batch that has an event of it.

    Where nobody is refused a family's requests follow from its own counts, and these are minima that need no order. Families that are
    refused, and those that they displace later, are followed in the order of batches by one fold; it reads their touches
    near the thresholds and the other requests of the same batches, not the events. A family that waits longer than
    ``wait`` occurrences is followed again with more of its touches.
    """
    if not 2 <= min_samples <= 16:
        raise ValueError("between 2 and 16 samples")
    levels = [min_samples, *LATER_THRESHOLDS]
    touches = written(batch_touches(events, key, batch, order).toDF("key", "batch", "first", "occurrences", "total"), "touches")
    place = F.struct("batch", "first", "occurrences")
    firsts = touches.groupBy("key").agg(*[F.min(F.when(F.col("occurrences") >= n, place)).alias(f"t{i}") for i, n in enumerate(levels)])
    # A batch that passes two thresholds at once makes one request.
    crowded = F.lit(False)
    for i in range(1, len(levels)):
        crowded = crowded | F.coalesce(F.col(f"t{i}.batch") == F.col(f"t{i - 1}.batch"), F.lit(False))
    free = written(firsts.select("key", crowded.alias("crowded"), F.posexplode(F.array(*[f"t{i}" for i in range(len(levels))])).alias("level", "t"))
                   .where("t IS NOT NULL").select("key", "crowded", "level", "t.*"), "requests")
    turn = F.row_number().over(Window.partitionBy("batch").orderBy("first"))
    late = free.withColumn("_n", turn).where((F.col("_n") > per_batch) | F.col("crowded"))
    disputed = written(late.select("key").distinct(), "disputed")
    while disputed.limit(1).count():
        near = F.exists(F.array(*[F.lit(n) for n in levels]), lambda n: F.col("occurrences").between(n, n + wait - 1))
        theirs = touches.where(near).join(disputed, "key", "left_semi").withColumn("fixed", F.lit(False))
        others = free.join(disputed, "key", "left_anti").join(theirs.select("batch").distinct(), "batch", "left_semi")
        rows = theirs.unionByName(others.select("key", "batch", "first", "occurrences", F.lit(0).cast("bigint").alias("total"), F.lit(True).alias("fixed")))
        # A batch is shared by all families, so its order is one for all; the rows are the disputed ones alone.
        folded = ordered_fold(rows.withColumn("lane", F.lit(0)), ["lane"], ["batch", "first"], _request_fold(levels, per_batch, wait), _REQUESTS)
        folded = written(folded, "followed")
        displaced = folded.where("outcome = 'displaced'").select("key").distinct()
        starved = folded.where("outcome = 'starved'").limit(1).count()
        if not starved and not displaced.limit(1).count():
            asked = folded.where("outcome = 'asked'").select("key", "batch", "first", "occurrences", "level")
            free = free.join(disputed, "key", "left_anti").select(asked.columns).unionByName(asked)
            break
        disputed = written(disputed.unionByName(displaced).distinct(), "disputed")
        wait = wait * 8 if starved else wait
    return free.select(F.col("key").alias(key), F.col("batch").alias(batch), "first", "occurrences", (F.col("level") + 1).cast("int").alias("request"))


_REQUESTS = "key string, batch bigint, first bigint, occurrences bigint, level int, outcome string"


def _request_fold(levels: list[int], per_batch: int, wait: int):
    """Touches in order to requests: ``asked``, ``displaced`` (a family thought to be undisputed) or ``starved`` (more touches are needed)."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, total, starved, now, used = {}, {}, set(), None, 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.batch != now:
                    now, used = r.batch, 0
                if r.fixed:
                    if used < per_batch:
                        used += 1
                    else:
                        out.append((r.key, r.batch, r.first, r.occurrences, 0, "displaced"))
                    continue
                i = level.get(r.key, 0)
                total[r.key] = r.total
                if i == len(levels) or r.occurrences < levels[i]:
                    continue
                if r.occurrences >= levels[i] + wait:
                    starved.add(r.key)  # touches between were not shown
                if used < per_batch:
                    used += 1
                    level[r.key] = i + 1
                    out.append((r.key, r.batch, r.first, r.occurrences, i, "asked"))
            yield pd.DataFrame(out, columns=["key", "batch", "first", "occurrences", "level", "outcome"])
        starved |= {k for k, n in total.items() if level.get(k, 0) < len(levels) and n >= levels[level.get(k, 0)] + wait}
        yield pd.DataFrame([(k, 0, 0, 0, 0, "starved") for k in starved], columns=["key", "batch", "first", "occurrences", "level", "outcome"])

    return fold


def _paths_ok(paths: Column) -> Column:
    return (
        (F.size(paths) <= 32) & (F.size(F.array_distinct(paths)) == F.size(paths))
        & F.forall(paths, lambda p: p.rlike(POINTER))
    )


def valid_proposal() -> Column:
    """Format of a proposal row ``name, version, required, normalize, protected, confidence, explanation``."""
    return F.coalesce(
        F.col("name").rlike(r"^[A-Za-z0-9_-]{1,64}\z") & (F.col("version") == 1)
        & F.col("confidence").between(0, 1) & ~F.isnan("confidence")
        & F.col("explanation").isin(*PROPOSAL_REASONS) & (F.size("required") > 0)
        & _paths_ok(F.col("required")) & _paths_ok(F.col("normalize")) & _paths_ok(F.col("protected")),
        F.lit(False),
    )


def validate_proposals(evidence: DataFrame, proposals: DataFrame, min_confidence: float = 0.0,
                       key: str = "template_key") -> DataFrame:
    """Replay each proposal over all samples of its family; adds ``accepted``.

    All samples must be JSON objects of one shape that hold every required and protected path,
    and a normalized path may only be an opaque, unprotected request/trace-style id.
    """
    s = evidence.select(key, F.explode("samples").alias("sample")).join(proposals, key)
    s = s.withColumn("_flat", M.flatten_json("sample")).withColumn("_shape", M.shape_hash("_flat.shape"))
    shape, leaves = F.col("_flat.shape"), F.col("_flat.leaves")

    def id_path(p: Column) -> Column:
        name = F.element_at(F.split(p, "/"), -1)
        return (
            ~M.protected_field(p) & name.rlike(rf"^(?:{P.ID_NAME_BODY})\z")
            & F.coalesce(leaves[p].rlike(rf'^"{P.OPAQUE_BODY}"\z'), F.lit(False))
        )

    fine = (
        F.coalesce(shape[""] == "object", F.lit(False))
        & F.forall(F.concat("required", "protected"), lambda p: shape[p].isNotNull())
        & F.forall("normalize", id_path)
    )
    replay = s.withColumn("_fine", F.coalesce(fine, F.lit(False))).groupBy(key, "name").agg(
        F.bool_and("_fine").alias("_all"), F.count(F.lit(1)).alias("_n"),
        F.countDistinct("_shape").alias("_shapes"),
    )
    return (
        proposals.join(replay, [key, "name"], "left")
        .withColumn("accepted", F.coalesce(
            F.col("_all") & (F.col("_n") >= 2) & (F.col("_shapes") == 1) & valid_proposal()
            & (F.col("confidence") >= min_confidence), F.lit(False)))
        .drop("_all", "_n", "_shapes")
    )


def valid_review(r: Column) -> Column:
    return F.coalesce(
        r["confidence"].between(0, 1) & ~F.isnan(r["confidence"]) & r["importance"].isin(*S.IMPORTANCE)
        & r["severity"].isin(*S.SEVERITY, "unknown") & r["category"].isin(*S.CATEGORY)
        & r["explanation"].isin(*REVIEW_REASONS) & (F.size(r["free_text_fields"]) <= 32)
        & F.forall(r["free_text_fields"], lambda f: F.concat(F.lit("/"), f).rlike(POINTER)),
        F.lit(False),
    )


def escalation(current: Column, r: Column) -> Column:
    """The raised verdict, or NULL: a review may raise a family but never lower it."""
    raises = (
        valid_review(r) & (current["importance"] != "important") & (r["importance"] == "important")
        & (r["confidence"] >= 0.75) & ~r["category"].isin("routine", "unknown")
        & ~r["severity"].isin("noise", "unknown") & ~r["explanation"].isin(*VAGUE_REASONS)
    )
    c = r["confidence"]
    return F.when(raises, C.judgment(r["importance"], r["severity"], r["category"], c, c, c))


def apply_escalations(events: DataFrame, evidence: DataFrame, reviews: DataFrame,
                      key: str = "template_key") -> DataFrame:
    """Events with raised verdicts; ``escalated`` tells which.

    ``reviews`` has one ``review`` struct per family. The family side is small beside the
    events, and Spark picks the join by its size.
    """
    up = (
        evidence.select(key, "current_verdict").join(reviews, key)
        .withColumn("_up", escalation(F.col("current_verdict"), F.col("review")))
        .where("_up IS NOT NULL").select(key, "_up")
    )
    hit = F.col("_up").isNotNull() & (F.col("judgment.importance") != "important") & F.col("_may")
    return (
        events.withColumn("_may", learning_eligible(events)).join(up, key, "left")
        .withColumn("escalated", F.coalesce(hit, F.lit(False)))
        .withColumn("judgment", F.when(F.col("escalated"), F.col("_up")).otherwise(F.col("judgment")))
        .drop("_up", "_may")
    )


def ask_teacher(evidence: DataFrame, teacher: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Call a user function on evidence rows; it returns rows of ``schema`` (proposals or reviews)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield teacher(pdf)

    return evidence.mapInPandas(run, schema)


def decisions(fired: DataFrame, proposals: DataFrame | None = None, reviews: DataFrame | None = None,
              evidence: DataFrame | None = None, key: str = "template_key") -> DataFrame:
    """Outcome log of the requests made at the thresholds (newest thousand)."""
    d = fired.select(key, "version_id", F.col("occurrences").alias("seen"), "arrival")
    if proposals is not None:
        d = d.join(proposals.select(key, "accepted"), key, "left").withColumn(
            "outcome", F.when(F.col("accepted"), "shadow_replay_passed").otherwise("rejected")
        ).drop("accepted")
    else:
        r = reviews.join(evidence.select(key, "current_verdict"), key).select(
            key, valid_review(F.col("review")).alias("_ok"),
            escalation(F.col("current_verdict"), F.col("review")).isNotNull().alias("_up"),
        )
        d = d.join(r, key, "left").withColumn(
            "outcome",
            F.when(F.col("_ok") & F.col("_up"), "escalated")
            .when(F.col("_ok"), "reviewed_fields_require_artifact").otherwise("rejected"),
        ).drop("_ok", "_up")
    return d.orderBy(F.desc("arrival")).limit(MAX_DECISIONS)
