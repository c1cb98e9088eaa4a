"""Reviewed template rules: which rule normalizes a structured message, and to what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C, templates as M
from ..sources.rulesets import MAX_RULES, scalars

MAX_DEPTH = 32


def match_template_rules(events: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Add ``rule_id`` and ``reviewed_template`` of the first unexpired rule that matches.

    ``rules`` is the output of ``read_template_rules``; at most 256 are allowed and their number
    is checked. Rules are joined by the shape of the JSON payload, so an event meets only rules
    of its own shape; source scope and literals are tested inside the row.
    """
    prefixes = [r[0] for r in rules.select("prefix").distinct().limit(MAX_RULES + 1).collect()]
    if len(prefixes) > MAX_RULES or rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError("too many template rules")
    rule = F.struct(
        "pos", "id", "version", "expires_at", "scope", "required", "protected", "normalize_paths",
    )
    by_shape = rules.groupBy("prefix", "shape_id").agg(F.sort_array(F.collect_list(_sortable(rule))).alias("_rules"))
    ok = C.groupable("text", "truncated", "sensitive", "parse_uncertain")
    # A message may fit several payload prefixes; nearly always there is just the empty one.
    fits = F.filter(
        F.array(*[F.lit(p) for p in sorted(prefixes)]).cast("array<string>"),
        lambda p: F.col("text").startswith(p),
    )
    d = events.withColumn("_row", F.col("id"))
    c = d.where(ok).withColumn("prefix", F.explode(fits))
    c = c.withColumn("_flat", M.flatten_json(F.expr("substr(text, length(prefix) + 1)")))
    c = c.withColumn("shape_id", M.shape_hash("_flat.shape"))
    shallow = F.forall(
        F.map_keys("_flat.shape"), lambda k: F.length(k) - F.length(F.replace(k, F.lit("/"), F.lit(""))) <= MAX_DEPTH
    )
    c = c.where(F.col("_flat.shape").isNotNull() & shallow).withColumn("_src", scalars("source"))
    c = c.join(by_shape, ["prefix", "shape_id"])

    def holds(want: Column, have: Column) -> Column:
        return F.forall(F.map_entries(want), lambda e: have[e["key"]].eqNullSafe(e["value"]))

    leaves = F.col("_flat.leaves")
    hit = F.get(F.filter("_rules", lambda r: (
        (now < r["expires_at"]) & holds(_map(r["scope"]), F.col("_src"))
        & holds(_map(r["required"]), leaves) & holds(_map(r["protected"]), leaves)
    )), F.lit(0))
    c = c.withColumn("_hit", hit).where("_hit IS NOT NULL")
    masked = F.transform_values(
        leaves, lambda k, v: F.when(F.array_contains(F.col("_hit.normalize_paths"), k), '"<reviewed>"').otherwise(v)
    )
    template = F.sha2(F.to_json(F.struct(
        F.col("_hit.id").alias("id"), F.col("_hit.version").alias("version"),
        F.col("_hit.scope").alias("scope"), "shape_id",
        F.array_sort(F.map_entries(masked)).alias("leaves"),
    )), 256)
    best = c.withColumn("_t", template).groupBy("_row").agg(
        F.min_by(F.struct(F.col("_hit.id").alias("rule_id"), F.col("_t").alias("reviewed_template")), F.col("_hit.pos")).alias("_b")
    )
    return d.join(best, "_row", "left").select(
        *events.columns, F.col("_b.rule_id").alias("rule_id"),
        F.col("_b.reviewed_template").alias("reviewed_template"),
    )


def _sortable(rule: Column) -> Column:
    """Maps cannot be sorted; carry them as sorted entry lists."""
    return F.struct(
        "pos", "id", "version", "expires_at",
        *[F.array_sort(F.map_entries(F.col(c))).alias(c) for c in ("scope", "required", "protected")],
        "normalize_paths",
    )


def _map(entries: Column) -> Column:
    return F.map_from_entries(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")))


def with_grouping(
    events: DataFrame, strategy: str = "drain", masking: str = "strict", rules: DataFrame | None = None,
    now: Column | None = None, with_json: bool = True,
) -> DataFrame:
    """Add ``eligible``, ``version_id``, ``template_key`` and ``grouping`` (why or how an event is grouped).

    A reviewed rule that matches takes precedence over any strategy: the event gets the reviewed
    template in the scope of its full source, under a version of the kind ``reviewed``. The semantic strategy groups
    nothing else, and without rules it only watches.
    """
    if rules is not None:
        d = match_template_rules(events, rules, now)
    else:
        d = events.withColumns({"rule_id": F.lit(None).cast("string"), "reviewed_template": F.lit(None).cast("string")})
    semantic = strategy == "semantic"
    d = M.with_template_key(d, "exact" if semantic else strategy, masking, with_json)
    hit = F.col("eligible") & F.col("reviewed_template").isNotNull()
    version = M.version_id(strategy, masking, F.concat_ws("\x1f", F.lit("reviewed"), "reviewed_template"))
    key = F.sha2(F.concat_ws(
        "\x1f", F.lit("family-v1"), F.to_json("source", {"ignoreNullFields": "false"}), version,
        F.col("baseline.important").cast("string"),
    ), 256)
    miss = F.lit("shadow_only" if rules is None else "reviewed_miss") if semantic else F.lit(strategy)
    grouping = F.when(hit, "reviewed").when(F.col("eligible"), miss).otherwise("ineligible")
    own = F.lit(None).cast("string") if semantic else F.col("template_key")
    return d.withColumns({
        "version_id": F.when(hit, version).otherwise(F.col("version_id")), "template_key": F.when(hit, key).otherwise(own),
        "grouping": grouping, "eligible": hit if semantic else F.col("eligible"),
    })
