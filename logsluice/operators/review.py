"""Human review: expected rules, acknowledgements, the overlay, and edits to both tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C
from ..schema import SOURCE
from ..sources.rulesets import MAX_RULE_BYTES, scalars

SKIPPED = "AI analysis was skipped by a local expected-event rule"
_SEP = "\x1f"
_FIELDS = [f.name for f in SOURCE.fields]


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule_id``: the first enabled rule (list order) that matches text and scope.

    Not a cross join: every rule has a scope, so rules are grouped per set of scope fields and
    joined on their values. The rules of one scope travel as one small array and the first
    match is picked inside the row. Spark broadcasts the rule side only while it is small.
    """
    on = rules.where("enabled").withColumn("_keys", F.array_sort(F.map_keys("scope")))
    size = on.agg(
        F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length(F.to_json("scope"))), F.lit(0)).alias("b"),
        F.collect_set("_keys").alias("shapes"),
    ).first()
    if any(not s for s in size["shapes"]):
        raise ValueError("a review rule needs a scope")
    if size["b"] > MAX_RULE_BYTES:
        raise ValueError("review rules exceed 16 MiB")
    shapes = sorted(tuple(s) for s in size["shapes"] if set(s) <= set(_FIELDS))
    d = events.withColumn("_scalars", scalars("source"))
    found = []
    for i, keys in enumerate(shapes):
        rule = F.struct(
            "pos", "id", "pattern", F.coalesce(F.col("match") == "exact", F.lit(False)).alias("exact")
        )
        side = (
            on.where(F.col("_keys") == F.array(*[F.lit(k) for k in keys]))
            .withColumn(f"_k{i}", F.concat_ws(_SEP, *[F.col("scope")[k] for k in keys]))
            .groupBy(f"_k{i}").agg(F.sort_array(F.collect_list(rule)).alias(f"_r{i}"))
        )
        values = [F.col("_scalars")[k] for k in keys]
        complete = values[0].isNotNull()
        for v in values[1:]:
            complete = complete & v.isNotNull()
        d = d.withColumn(f"_k{i}", F.when(complete, F.concat_ws(_SEP, *values))).join(side, f"_k{i}", "left")
        text = F.col("text")
        hits = F.filter(F.col(f"_r{i}"), lambda r: F.when(
            r["exact"], F.trim(text, F.lit(" \t\n\r\f\x0b")) == r["pattern"]).otherwise(text.contains(r["pattern"])))
        first = F.get(hits, F.lit(0))
        d = d.withColumn(f"_m{i}", F.when(first.isNotNull(), F.struct(first["pos"].alias("pos"), first["id"].alias("id"))))
        found.append(f"_m{i}")
    if not found:
        best = F.lit(None).cast("string")
    elif len(found) == 1:
        best = F.col(found[0])["id"]
    else:
        best = F.array_min(F.array_compact(F.array(*[F.col(c) for c in found])))["id"]
    return d.withColumn("rule_id", best).select(*events.columns, "rule_id")


def acknowledged(events: DataFrame, acks: DataFrame, report: str) -> DataFrame:
    """Add ``acked``: the event id was acknowledged for this report."""
    ids = acks.where(F.col("report") == report).select("id").distinct().withColumn("_a", F.lit(True))
    return events.join(ids, "id", "left").withColumn("acked", F.col("_a").isNotNull()).drop("_a")


def _overlaid(j: Column) -> Column:
    return C.judgment("routine", j["severity"], j["category"])


def review_overlay(events: DataFrame, rules: DataFrame, acks: DataFrame, report: str) -> DataFrame:
    """Project the review tables onto events.

    A stored original verdict is restored first, so switching a rule off undoes it. A rule wins
    over an acknowledgement. Overlaid events read routine, keep severity and category, and keep
    the verdict they had in ``original_judgment``.
    """
    d = events
    if "original_judgment" in d.columns:
        d = d.withColumn("judgment", F.coalesce("original_judgment", "judgment")).drop("original_judgment")
    d = acknowledged(match_rules(d.drop("review"), rules), acks, report)
    status = F.when(F.col("rule_id").isNotNull(), "expected").when(F.col("acked"), "acknowledged")
    d = d.withColumn("_status", status)
    hit = F.col("_status").isNotNull()
    return (
        d.withColumn("original_judgment", F.when(hit, F.col("judgment")))
        .withColumn("judgment", F.when(hit, _overlaid(F.col("judgment"))).otherwise(F.col("judgment")))
        .withColumn("review", F.when(hit, F.struct(F.col("_status").alias("status"), F.col("rule_id"))))
        .drop("_status", "rule_id", "acked")
    )


def split_expected(events: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expected, rest): events a human rule covers skip the judge.

    They stay unknown underneath, so switching the rule off cannot invent a verdict.
    """
    d = match_rules(events, rules)
    expected = (
        d.where("rule_id IS NOT NULL")
        .withColumn("original_judgment", C.unknown(SKIPPED))
        .withColumn("judgment", C.judgment("routine", "unknown", "unknown"))
        .withColumn("review", F.struct(F.lit("expected").alias("status"), F.col("rule_id")))
        .drop("rule_id")
    )
    return expected, d.where("rule_id IS NULL").drop("rule_id")


def selection_check(selected: DataFrame, events: DataFrame, limit: int = 100000) -> DataFrame:
    """One row ``(selected, missing, repeated, valid)``; an edit applies only when valid."""
    ids = selected.select("id")
    n = ids.agg(F.count(F.lit(1)).alias("selected"), F.countDistinct("id").alias("_d"))
    missing = ids.distinct().join(events.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return (
        n.withColumn("_j", F.lit(1)).join(missing.withColumn("_j", F.lit(1)), "_j")
        .select(
            "selected", "missing", (F.col("selected") - F.col("_d")).alias("repeated"),
            ((F.col("missing") == 0) & (F.col("selected") == F.col("_d"))
             & F.col("selected").between(1, limit)).alias("valid"),
        )
    )


def acknowledge(acks: DataFrame, report: str, ids: DataFrame) -> DataFrame:
    """Acknowledgement table with ``ids`` added to one report."""
    return acks.unionByName(ids.select(F.lit(report).alias("report"), "id")).distinct()


def unacknowledge(acks: DataFrame, report: str, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.lit(report).alias("report"), "id")
    return acks.join(gone, ["report", "id"], "left_anti")


def expected_rule(events: DataFrame, scope: str = "workload") -> DataFrame:
    """Rules proposed by selected events with a ``pattern`` column.

    A pattern shorter than eight characters must equal the whole message. ``scope`` is workload
    (all pods) or source (this pod); files are scoped by path either way. Invalid selections
    come back with a ``reason``.
    """
    if scope not in ("workload", "source"):
        raise ValueError("scope is workload or source")
    pattern = F.trim("pattern", F.lit(" \t\n\r\f\x0b"))
    kube = ["type", "context", "namespace", "container"] + (["pod"] if scope == "source" else [])
    keys = F.when(
        F.col("source.type") == "kubernetes", F.array(*[F.lit(k) for k in kube])
    ).otherwise(F.array(F.lit("type"), F.lit("path")))
    d = (
        events.withColumn("pattern", pattern)
        .withColumn("_keys", keys)
        .withColumn("scope", F.map_filter(scalars("source"), lambda k, v: F.array_contains(F.col("_keys"), k)))
        .withColumn("match", F.when(F.length("pattern") < 8, "exact").otherwise("contains"))
    )
    whole = F.trim("text", F.lit(" \t\n\r\f\x0b")) == F.col("pattern")
    reason = (
        F.when((F.length("pattern") < 1) | (F.length("pattern") > 500) | F.col("pattern").rlike(r"\p{Cc}"), "bad_pattern")
        .when(~F.col("text").contains(F.col("pattern")), "not_literal_text")
        .when((F.col("match") == "exact") & ~whole, "short_pattern_must_match_whole_event")
    )
    rule_id = F.substring(F.sha2(F.to_json(F.struct(
        "pattern", F.array_sort(F.map_entries("scope")).alias("scope"), "match"
    )), 256), 1, 16)
    return d.select(
        rule_id.alias("id"), "pattern", "match", "scope", F.lit(True).alias("enabled"), reason.alias("reason")
    )


def add_rules(rules: DataFrame, proposed: DataFrame) -> DataFrame:
    """Upsert: an equal rule is switched on again, a new one goes to the end of the list."""
    same = F.to_json(F.struct("pattern", F.coalesce("match", F.lit("contains")), F.array_sort(F.map_entries("scope"))))
    new = proposed.select("id", "pattern", "match", "scope", "enabled", same.alias("_same")).dropDuplicates(["_same"])
    old = rules.withColumn("_same", same)
    marks = new.select("_same", F.lit(True).alias("_again"))
    kept = old.join(marks, "_same", "left").withColumn(
        "enabled", F.coalesce("_again", "enabled")
    ).select("pos", "id", "pattern", "match", "scope", "enabled")
    fresh = new.join(old.select("_same"), "_same", "left_anti")
    # New rules share the next position; ties are broken by id wherever rules are ranked.
    end = rules.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("pos")).withColumn("_j", F.lit(1))
    fresh = fresh.withColumn("_j", F.lit(1)).join(end, "_j").select("pos", "id", "pattern", "match", "scope", "enabled")
    return kept.unionByName(fresh)


def toggle_rule(rules: DataFrame, rule_id: str, enabled: bool) -> DataFrame:
    """Switch one rule; an unknown id is an error."""
    if rules.where(F.col("id") == rule_id).isEmpty():
        raise ValueError("rule not found")
    return rules.withColumn(
        "enabled", F.when(F.col("id") == rule_id, F.lit(enabled)).otherwise(F.col("enabled"))
    )
