"""Rule files: human review rules and reviewed template rules, with their checks.

Scopes and literals are maps from name to JSON scalar text, so 200 and "200" stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions import templates as M

MAX_RULES = 256
MAX_RULE_BYTES = 16 << 20


def scalars(source) -> Column:
    """Source fields as a map of JSON scalar texts (absent fields are left out)."""
    source = F.col(source) if isinstance(source, str) else source
    pairs = [
        F.struct(F.lit(f.name).alias("k"), F.regexp_replace(F.to_json(F.array(source[f.name])), r"^\[|\]\z", "").alias("v"))
        for f in S.SOURCE.fields
    ]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull() & (p["v"] != "null")))


def _member_map(text: str) -> Column:
    """Top-level members of a JSON object as name to scalar text."""
    leaves = M.flatten_json(text)["leaves"]
    return F.transform_keys(
        leaves, lambda k, v: F.replace(F.replace(F.substr(k, F.lit(2)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    )


def read_human_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, acknowledgements) of one review file; rules keep their list order in ``pos``.

    A file with a rule that ``human_rule_violations`` names is refused as a whole.
    """
    doc = spark.read.schema(S.HUMAN_RULES).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rules = doc.where("version = 1").select(F.posexplode("rules").alias("pos", "r")).select("pos", "r.*")
    rules = rules.withColumn("scope", _member_map("scope"))
    bad = human_rule_violations(rules).first()
    if bad is not None:
        raise ValueError(f"review rule {bad['id']!r} is invalid: {bad['reason']}")
    acks = doc.where("version = 1").select(F.explode("acknowledged").alias("report", "ids")).select(
        "report", F.explode("ids").alias("id")
    )
    return rules, acks


def human_rule_violations(rules: DataFrame) -> DataFrame:
    """``(id, reason)`` of rules that must not be used."""
    control = r"\p{Cc}"
    scope_size = F.coalesce(F.size("scope"), F.lit(0))
    reason = (
        F.when((F.coalesce(F.col("id"), F.lit("")) == "") | (F.length("id") > 256) | F.col("id").rlike(control), "bad_id")
        .when((F.coalesce(F.col("pattern"), F.lit("")) == "") | (F.length("pattern") > 500) | F.col("pattern").rlike(control), "bad_pattern")
        .when(F.col("match").isNotNull() & ~F.col("match").isin("", "exact", "contains"), "bad_match")
        .when((scope_size < 1) | (scope_size > 32), "bad_scope")
        .when(~F.forall(F.map_values("scope"), lambda v: v.rlike(r'^(?:"[\s\S]*"|true|false|-?[0-9]+)\z') & (F.length(v) <= 4098)), "bad_scope")
        .when(F.col("enabled").isNull(), "bad_enabled")
    )
    own = rules.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "reason")
    body = F.to_json(F.struct(
        "pattern", "match", "enabled", F.array_sort(F.map_entries("scope")).alias("scope")
    ), {"ignoreNullFields": "false"})
    clash = (
        rules.select("id", body.alias("_b")).groupBy("id")
        .agg(F.countDistinct("_b").alias("n")).where("n > 1")
        .select("id", F.lit("conflicting_duplicate").alias("reason"))
    )
    return own.unionByName(clash)


def read_template_rules(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed template rules of one artifact (version 2, schema 1), in list order."""
    doc = spark.read.schema(S.TEMPLATE_RULES).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rules = doc.where("artifact_version = 2 AND schema_version = 1").select(
        F.posexplode("rules").alias("pos", "r")
    ).select("pos", "r.*")
    return typed_template_rules(rules)


def typed_template_rules(rules: DataFrame) -> DataFrame:
    """Parse the JSON-text columns of template rules into typed maps."""
    return (
        rules.withColumn("scope", _member_map("source_scope"))
        .withColumn("required", _member_map("required_literals"))
        .withColumn("protected", _member_map("protected_literals"))
        .withColumn("prefix", F.coalesce("prefix_identity.text", F.lit("")))
        .withColumn("shape_id", M.shape_hash("shape"))
        .drop("source_scope", "required_literals", "protected_literals")
    )


def template_rule_violations(rules: DataFrame, now: Column) -> DataFrame:
    """``(id, reason)`` of template rules that must not be used at ``now`` (unix seconds)."""
    r = F.col("review")

    def blank(c):
        return F.coalesce(c, F.lit("")) == ""

    def unsafe(p):
        return (
            ~p.startswith("/") | (F.octet_length(p) > 128) | M.protected_field(p)
            | ~F.coalesce(F.col("shape")[p] == "string", F.lit(False))
            | F.col("protected")[p].isNotNull() | F.col("required")[p].isNotNull()
        )

    reason = (
        F.when(blank(F.col("id")) | (F.octet_length("id") > 128), "bad_id")
        .when(F.col("version") < 1, "bad_version")
        .when(F.col("expires_at") <= now, "expired")
        .when((r["reviewed_at"] <= 0) | (r["reviewed_at"] > now) | blank(r["compiler"]) | blank(r["reviewer"]) | blank(r["review_id"]), "not_reviewed")
        .when((F.coalesce(F.size("scope"), F.lit(0)) < 1) | (F.coalesce(F.size("shape"), F.lit(0)) < 1), "no_scope_or_shape")
        .when(~blank(F.col("prefix_identity.clock_grammar")), "clock_prefix_unsupported")
        .when((F.size("normalize_paths") > 64) | (F.size(F.array_distinct("normalize_paths")) < F.size("normalize_paths")), "bad_paths")
        .when(F.exists("normalize_paths", unsafe), "unsafe_normalization")
    )
    own = rules.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "reason")
    again = rules.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("reason"))
    many = rules.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_RULES).select(
        F.lit("*").alias("id"), F.lit("too_many_rules").alias("reason")
    )
    return own.unionByName(again).unionByName(many)
