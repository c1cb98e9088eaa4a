"""Evidence dossiers, judging, the safety gate and fan-out of verdicts to group members."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import schema as S
from ..functions import classify as C, redact as R, text as X
from ..functions.templates import families
from ..session import written
from .scale import ROWS_PER_BLOCK, running_rank, with_block


def with_ticket(events: DataFrame) -> DataFrame:
    """``ticket``: the template key, or the event's own id where sharing is not allowed."""
    return events.withColumn(
        "ticket", F.coalesce("template_key", F.concat(F.lit("own:"), F.col("id")), F.lit("own:"))
    )


def dossiers(events: DataFrame, batch: str = "batch", order: str = "arrival", redact_json: bool = False) -> DataFrame:
    """One row per (batch, ticket): counts, OR-ed flags and up to eight distinct samples.

    Distinct samples are found by a hash of the sample (spread over all tasks even for one
    dominant template); only the first eight per ticket are ranked, and Spark keeps eight per
    partition before that shuffle.
    """
    d = R.with_redaction(with_ticket(events), "text", redact_json)
    d = d.withColumn("sample", X.clip_bytes("safe", S.MAX_SAMPLE_BYTES)).withColumn(
        "_long", F.octet_length("safe") > S.MAX_SAMPLE_BYTES
    )
    key = [batch, "ticket"]
    d = d.withColumn("_sid", F.xxhash64("sample"))
    # First level: one row per distinct sample, combined on the map side. It is written, as counts and samples both read it.
    by_sample = written(d.groupBy(*key, "_sid", "sample").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(order).alias("first"),
        F.max(F.col("baseline.important")).alias("baseline_important"),
        F.max(C.security_shaped("text")).alias("security_signal"),
        F.max("truncated").alias("truncated"),
        F.max(F.col("sensitive") | F.col("changed")).alias("sensitive"),
        F.max(F.col("_long") | F.col("truncated") | F.col("parse_uncertain")).alias("evidence_limited"),
        F.min_by(
            F.struct(
                F.col("id").alias("evidence_id"), "source_id",
                F.col("template_key") if "template_key" in events.columns else F.lit(None).alias("template_key"),
                F.col("version_id") if "version_id" in events.columns else F.lit(None).alias("version_id"),
                "source",
            ), order,
        ).alias("head"),
    ).drop("_sid"), "batch-samples")
    totals = by_sample.groupBy(*key).agg(
        F.sum("n").alias("window_occurrences"),
        F.count(F.lit(1)).alias("_distinct"),
        F.max("baseline_important").alias("baseline_important"),
        F.max("security_signal").alias("security_signal"),
        F.max("truncated").alias("truncated"),
        F.max("sensitive").alias("sensitive"),
        F.max("evidence_limited").alias("evidence_limited"),
        F.min("first").alias("first_arrival"),
        F.min_by("head", "first").alias("_head"),
    ).withColumn("samples_limited", F.col("_distinct") > S.MAX_SAMPLES).drop("_distinct")
    w = Window.partitionBy(*key).orderBy("first")
    samples = (
        by_sample.select(*key, "first", "sample").withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= S.MAX_SAMPLES)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("first", "sample"))).alias("_s"))
        .select(*key, F.transform("_s", lambda s: s["sample"]).alias("samples"))
    )
    return totals.join(samples, key).select("*", "_head.*").drop("_head")


def unsafe() -> Column:
    """Evidence that may neither be called routine nor seed reuse."""
    return (
        F.col("sensitive") | F.col("truncated") | F.col("evidence_limited")
        | F.col("samples_limited") | F.col("security_signal")
    )


def offline_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """Default judge: the keyword verdict of each dossier."""
    hot = batch["baseline_important"].astype(bool)
    return pd.DataFrame({
        "importance": hot.map({True: "important", False: "uncertain"}),
        "severity": hot.map({True: "degraded", False: "info"}),
        "category": "unknown", "importance_confidence": None, "severity_confidence": None,
        "category_confidence": None, "analysis_error": None,
    })


_J_FIELDS = [f.name for f in S.JUDGMENT.fields]


def score_groups(
    groups: DataFrame,
    judge: Callable[[pd.DataFrame], pd.DataFrame] = offline_judge,
    per_call: int = 64,
    order: Sequence[str] = ("first_arrival",),
    parallelism: int | None = None,
) -> DataFrame:
    """Add ``judgment`` by calling ``judge`` on at most ``per_call`` rows at a time.

    The callable gets a pandas frame and returns one row of verdict fields per input row. A
    failing call or a wrong number of rows makes every verdict of that call unknown.
    ``parallelism`` bounds the number of concurrent callers.
    """
    if not 1 <= per_call <= 64:
        raise ValueError("between 1 and 64 groups per call")
    if parallelism:
        groups = groups.repartition(parallelism)
    out_schema = T.StructType(
        [f for f in groups.schema.fields] + [T.StructField("judgment", S.JUDGMENT)]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            verdicts = []
            for start in range(0, len(pdf), per_call):
                part = pdf.iloc[start:start + per_call].reset_index(drop=True)
                reason, got = "provider analysis unavailable", None
                try:
                    got = judge(part)
                except Exception:
                    got = None
                if got is None or len(got) != len(part):
                    blank = dict.fromkeys(_J_FIELDS)
                    blank |= {"importance": "unknown", "severity": "unknown",
                              "category": "unknown", "analysis_error": reason}
                    verdicts += [dict(blank) for _ in range(len(part))]
                else:
                    got = got.reindex(columns=_J_FIELDS).astype(object)
                    verdicts += got.where(got.notna(), None).to_dict("records")
            yield pdf.assign(judgment=pd.Series(verdicts, index=pdf.index, dtype=object))

    return groups.sortWithinPartitions(*order).mapInPandas(run, out_schema)


def gate_verdicts(judged: DataFrame) -> DataFrame:
    """Validate and soften verdicts, and decide whether each may be copied (``seeds``)."""
    j = F.col("judgment")
    fields = {n: j[n] for n in _J_FIELDS}
    weak = F.isnull(j["importance_confidence"]) | F.isnan(j["importance_confidence"]) | (
        j["importance_confidence"] < 0.7
    )
    soft = F.when((j["importance"] == "routine") & (unsafe() | weak), "uncertain").otherwise(j["importance"])
    softened = C.judgment(soft, *[fields[n] for n in _J_FIELDS[1:]])
    d = judged.withColumn("_valid", C.valid_judgment("judgment")).withColumn(
        "judgment",
        F.when(F.col("_valid"), softened)
        .when(j["analysis_error"] == "provider analysis unavailable", C.unknown("provider analysis unavailable"))
        .otherwise(C.unknown("invalid provider judgment")),
    ).drop("_valid")
    return d.withColumn(
        "seeds", ~unsafe() & C.reusable("judgment") & ~F.col("ticket").startswith("own:")
    )


def fan_out(events: DataFrame, verdicts: DataFrame, batch: str = "batch", order: str = "arrival") -> DataFrame:
    """Give each event the verdict of its dossier.

    Members after the first receive a copy only when the verdict may be reused. The verdict
    side has one row per ticket; a dominant ticket is split by the adaptive skew join.
    """
    v = verdicts.select(
        batch, "ticket", F.col("judgment").alias("_j"), "seeds", "first_arrival", "evidence_id",
        "window_occurrences", "evidence_limited", "samples_limited",
        F.size("samples").cast("bigint").alias("sample_count"),
    )
    first = F.col(order) == F.col("first_arrival")
    return (
        with_ticket(events).join(v, [batch, "ticket"])
        .withColumn("analysis_reused", ~first & F.col("seeds"))
        .withColumn("representative_id", F.when(F.col("analysis_reused"), F.col("evidence_id")))
        .withColumn(
            "judgment",
            F.when(first | F.col("seeds"), F.col("_j"))
            .otherwise(C.unknown("group verdict requires independent review")),
        )
        .drop("_j", "first_arrival", "evidence_id", "seeds")
    )


def analysis_counters(events: DataFrame, judged_groups: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """``(metric, value)`` of one scoring run."""
    per_event = events.agg(F.count_if("analysis_reused").alias("drain_group_fanouts"))
    per_group = judged_groups.agg(
        F.count(F.lit(1)).alias("classifications"),
        F.count(F.lit(1)).alias("drain_group_assessments"),
        F.coalesce(F.sum("window_occurrences"), F.lit(0)).alias("drain_group_occurrences"),
    )

    def tall(df):
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in df.columns
        ])).alias("m")).select("m.*")

    out = tall(per_event).unionByName(tall(per_group))
    if reviewed is not None:
        out = out.unionByName(tall(reviewed.agg(F.count(F.lit(1)).alias("human_expected_events"))))
    return out


def template_checkpoint(events: DataFrame) -> DataFrame:
    """Opaque family counters; carries no text."""
    return families(events).groupBy("template_key", "version_id").agg(
        F.count(F.lit(1)).alias("seen")
    )


def chunk(df: DataFrame, n: int, order: str = "arrival", out: str = "batch") -> DataFrame:
    """Consecutive batches of at most ``n`` rows in ``order``, numbered without one big sort."""
    d = running_rank(with_block(df, order, ROWS_PER_BLOCK), [], [order], "_n")
    return d.withColumn(out, F.floor((F.col("_n") - 1) / n).cast("bigint")).drop("_n", "_block")


def parse_replies(replies: DataFrame, text: str = "reply", expected: str = "expected") -> DataFrame:
    """Typed verdicts of judge replies ``{"judgments": [...]}``; one bad item rejects its reply.

    Adds ``accepted`` and ``judgments`` (NULL when rejected). Unknown or repeated members,
    missing or non-numeric confidences, wrong counts and out-of-range values all reject.
    """
    names = _J_FIELDS[:6]
    outer = F.json_object_keys(text)
    raw = F.from_json(text, "judgments array<string>")["judgments"]
    typed = F.from_json(text, T.StructType([T.StructField("judgments", T.ArrayType(T.StructType(
        [T.StructField(n, T.StringType()) for n in names[:3]]
        + [T.StructField(n, T.DoubleType()) for n in names[3:]]
    )))]))["judgments"]
    d = (
        # Repeated members make the strict parser fail at any depth.
        replies.withColumn("_strict", F.try_parse_json(text).isNotNull())
        .withColumn("_outer", outer).withColumn("_raw", raw).withColumn("_typed", typed)
    )
    exact = F.forall("_raw", lambda r: F.coalesce(
        F.array_sort(F.json_object_keys(r)) == F.lit(sorted(names)), F.lit(False)
    ) & ~r.rlike(r'"[a-z]+_confidence"[ \t\r\n]*:[ \t\r\n]*"'))
    sound = F.forall("_typed", lambda j: F.coalesce(
        j["importance"].isin(*S.IMPORTANCE) & j["severity"].isin(*S.SEVERITY)
        & j["category"].isin(*S.CATEGORY)
        & F.forall(F.array(*[j[n] for n in names[3:]]), lambda c: F.coalesce(
            ~F.isnan(c) & (c >= 0) & (c <= 1), F.lit(False))),
        F.lit(False),
    ))
    ok = (
        F.col("_strict") & (F.col("_outer") == F.array(F.lit("judgments")))
        & (F.size("_raw") == F.col(expected)) & exact & sound
    )
    return (
        d.withColumn("accepted", F.coalesce(ok, F.lit(False)))
        .withColumn("judgments", F.when(F.col("accepted"), F.col("_typed")))
        .drop("_strict", "_outer", "_raw", "_typed")
    )
