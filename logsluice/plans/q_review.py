"""Queries: human rules, acknowledgements, the overlay and edits."""

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import review as V
from ..sources import rulesets as RS
from . import adapters as A, oracle as O
from .catalog import query

# Rules derived from the data: one per namespace, and two kinds per tenth pod.
_RULES = """
rules AS (
  SELECT DISTINCT 100000 + user_id % 3 AS pos, 'ns' || (user_id % 3) AS id, 'INFO view' AS pattern,
    source.namespace AS namespace, NULL::VARCHAR AS pod, user_id % 3 <> 2 AS enabled FROM ev
  UNION SELECT user_id, 'e' || user_id, 'ERROR error', source.namespace, source.pod, true FROM ev WHERE user_id % 10 = 0
  UNION SELECT 50000 + user_id, 'v' || user_id, 'view', source.namespace, source.pod, user_id % 40 = 0 FROM ev WHERE user_id % 20 = 0
),
matched AS (
  SELECT e.arrival, min_by(r.id, r.pos) AS rule_id FROM ev e JOIN rules r
    ON r.enabled AND r.namespace = e.source.namespace AND (r.pod IS NULL OR r.pod = e.source.pod) AND contains(e.text, r.pattern)
  GROUP BY e.arrival
)"""


def _rules(spark, sf_dir):
    ev = A.load(spark, sf_dir, "events", ["user_id"]).distinct()
    u = F.col("user_id")

    def quoted(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    def scope(with_pod):
        pairs = [
            F.lit("type"), F.lit('"kubernetes"'), F.lit("context"), F.lit('"demo"'), F.lit("namespace"),
            quoted(F.concat(F.lit("ns"), (u % 3).cast("string"))), F.lit("container"), F.lit('"app"'),
        ]
        if with_pod:
            pairs += [F.lit("pod"), quoted(F.concat(F.lit("pod"), u.cast("string")))]
        return F.create_map(*pairs).alias("scope")

    def rows(df, pos, rule_id, pattern, with_pod, enabled):
        return df.select(
            pos.cast("bigint").alias("pos"), rule_id.alias("id"), F.lit(pattern).alias("pattern"),
            F.lit("contains").alias("match"), scope(with_pod), enabled.alias("enabled"),
        )

    ns = rows(ev, u % 3 + 100000, F.concat(F.lit("ns"), (u % 3).cast("string")), "INFO view", False, u % 3 != 2)
    return (
        ns.dropDuplicates(["id"])
        .unionByName(rows(ev.where("user_id % 10 = 0"), u, F.concat(F.lit("e"), u.cast("string")), "ERROR error", True, F.lit(True)))
        .unionByName(rows(ev.where("user_id % 20 = 0"), u + 50000, F.concat(F.lit("v"), u.cast("string")), "view", True, u % 40 == 0))
    )


def _acks(ev):
    return ev.where("arrival % 50 = 0").select(F.lit("r1").alias("report"), "id")


_OVERLAY = """
over AS (
  SELECT j.*, rule_id, j.arrival % 50 = 0 AS acked, CASE WHEN rule_id IS NOT NULL THEN 'expected' WHEN j.arrival % 50 = 0 THEN 'acknowledged' END AS status
  FROM judged j LEFT JOIN matched USING (arrival))"""
ALL = (O.EVENTS, O.BASE, O.JUDGED, _RULES, _OVERLAY)


@query("review_overlay", O.with_ctes(*ALL, """
SELECT id, CASE WHEN status IS NULL THEN importance ELSE 'routine' END AS importance, severity, category, status, rule_id,
  CASE WHEN status IS NOT NULL THEN importance END AS original_importance,
  CASE WHEN status IS NULL THEN i_conf END AS importance_confidence FROM over"""))
def review_overlay(spark, sf_dir):
    ev = A.judged_events(spark, sf_dir)
    d = V.review_overlay(ev, _rules(spark, sf_dir), _acks(ev), "r1")
    return d.select(
        "id", "judgment.importance", "judgment.severity", "judgment.category",
        F.col("review.status").alias("status"), F.col("review.rule_id").alias("rule_id"),
        F.col("original_judgment.importance").alias("original_importance"),
        "judgment.importance_confidence",
    )


@query("reviewed_summary", O.with_ctes(*ALL, """
SELECT CASE WHEN status IS NULL THEN importance ELSE 'routine' END AS importance, count(*) AS events FROM over GROUP BY 1"""))
def reviewed_summary(spark, sf_dir):
    ev = A.judged_events(spark, sf_dir)
    d = V.review_overlay(ev, _rules(spark, sf_dir), _acks(ev), "r1")
    return d.groupBy(F.col("judgment.importance").alias("importance")).agg(F.count(F.lit(1)).alias("events"))


@query("restored_verdicts", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, "SELECT id, importance, severity, i_conf FROM judged"))
def restored_verdicts(spark, sf_dir):
    """Overlay, then project again with every rule off and no acknowledgement."""
    ev = A.judged_events(spark, sf_dir)
    rules = _rules(spark, sf_dir)
    first = V.review_overlay(ev, rules, _acks(ev), "r1")
    again = V.review_overlay(first, rules.withColumn("enabled", F.lit(False)), _acks(ev), "other")
    return again.select("id", "judgment.importance", "judgment.severity", F.col("judgment.importance_confidence").alias("i_conf"))


@query("expected_before_judging", O.with_ctes(*ALL, """
SELECT id, rule_id, 'unknown' AS original_importance FROM over WHERE rule_id IS NOT NULL"""))
def expected_before_judging(spark, sf_dir):
    ev = A.events_log(spark, sf_dir)
    expected, _ = V.split_expected(ev, _rules(spark, sf_dir))
    return expected.select("id", F.col("review.rule_id").alias("rule_id"), F.col("original_judgment.importance").alias("original_importance"))


@query("acknowledged_ids", O.with_ctes(O.EVENTS, """
SELECT 'r1' AS report, id FROM ev WHERE (arrival % 50 = 0 OR arrival % 75 = 0) AND arrival % 100 <> 0"""))
def acknowledged_ids(spark, sf_dir):
    ev = A.events_log(spark, sf_dir).select("arrival", "id")
    acks = V.acknowledge(_acks(ev), "r1", ev.where("arrival % 75 = 0"))
    return V.unacknowledge(acks, "r1", ev.where("arrival % 100 = 0"))


@query("selection_check", O.with_ctes(O.EVENTS, """
SELECT count(*) AS selected, count(*) FILTER (arrival % 7 = 0) AS missing, 0::BIGINT AS repeated, false AS valid FROM ev WHERE event_type = 'error'"""))
def selection_check(spark, sf_dir):
    ev = A.events_log(spark, sf_dir)
    return V.selection_check(ev.where("event_type = 'error'"), ev.where("arrival % 7 <> 0"))


@query("proposed_rules", O.with_ctes(O.EVENTS, """
SELECT source.namespace AS namespace, split_part(text, ' ', 2) AS pattern,
  CASE WHEN length(split_part(text, ' ', 2)) < 8 THEN 'exact' ELSE 'contains' END AS match,
  CASE WHEN length(split_part(text, ' ', 2)) < 8 THEN 'short_pattern_must_match_whole_event' END AS reason, count(*) AS events
FROM ev GROUP BY ALL"""))
def proposed_rules(spark, sf_dir):
    ev = A.events_log(spark, sf_dir).withColumn("pattern", F.split("text", " ")[1])
    return V.expected_rule(ev).groupBy(
        F.replace(F.col("scope")["namespace"], F.lit('"'), F.lit("")).alias("namespace"), "pattern", "match", "reason"
    ).agg(F.count(F.lit(1)).alias("events"))


@query("rules_after_edit", O.with_ctes(O.EVENTS, _RULES, """
SELECT pattern, coalesce(pod, '') AS pod, bool_or(on_now) AS enabled, count(*) AS rules FROM (
  SELECT pattern, namespace, pod, enabled OR pattern = 'INFO view' AS on_now FROM rules
  UNION ALL SELECT DISTINCT 'status=503', source.namespace, NULL, true FROM ev) GROUP BY 1, 2"""))
def rules_after_edit(spark, sf_dir):
    """Re-adding the namespace rules switches them on; one new pattern is appended per namespace."""
    ev = A.events_log(spark, sf_dir)
    rules = _rules(spark, sf_dir)
    view = ev.where("event_type = 'view'").withColumn("pattern", F.lit("INFO view"))
    fault = ev.where(F.col("text").contains("status=503")).withColumn("pattern", F.lit("status=503"))
    edited = V.add_rules(rules, V.expected_rule(view.unionByName(fault)))
    pod = F.coalesce(F.replace(F.col("scope")["pod"], F.lit('"'), F.lit("")), F.lit(""))
    return edited.groupBy("pattern", pod.alias("pod")).agg(
        F.max("enabled").alias("enabled"), F.count(F.lit(1)).alias("rules")
    )


@query("human_rule_violations", O.with_ctes(O.EVENTS, _RULES, """
SELECT id, CASE WHEN id LIKE 'e%' THEN 'bad_match' ELSE 'bad_pattern' END AS reason FROM rules WHERE id NOT LIKE 'ns%'"""))
def human_rule_violations(spark, sf_dir):
    bad = _rules(spark, sf_dir).withColumn(
        "match", F.when(F.col("id").startswith("e"), "regex").otherwise(F.col("match"))
    ).withColumn("pattern", F.when(F.col("id").startswith("v"), "a\tb").otherwise(F.col("pattern")))
    return RS.human_rule_violations(bad)


@query("toggled_rules", O.with_ctes(O.EVENTS, _RULES, "SELECT id, CASE WHEN id = (SELECT min(id) FROM rules) THEN NOT enabled ELSE enabled END AS enabled FROM rules"))
def toggled_rules(spark, sf_dir):
    """The first rule by id switched over."""
    rules = _rules(spark, sf_dir)
    first = rules.orderBy("id").first()
    return V.toggle_rule(rules, first.id, not first.enabled).select("id", "enabled")
