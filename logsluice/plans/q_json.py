"""Queries: structured messages, template rules and learning."""

import uuid

from pyspark.sql import functions as F

from ..functions import redact as R, templates as M
from ..operators import learning as N, rules as TR
from ..session import shared_dir, written
from ..sources import rulesets as RS
from . import adapters as A, oracle as O
from .catalog import query
from .q_groups import ALL as GROUPS, keyed_events

# A structured message per event, members out of order and one secret.
_DOC = """
docs AS (
  SELECT *, md5('s' || arrival) AS rid,
    CASE WHEN k % 10 = 3 THEN '{"status":200,"request_id":"' || md5('s' || arrival) || '","kind":"' || event_type || '"}'
         WHEN k % 10 = 4 THEN '{"status":"200","request_id":"' || md5('s' || arrival) || '","kind":"' || event_type || '"}'
         WHEN k % 10 = 5 THEN '{"n": ' || k || ', "a":[' || k || ',"x"],"n":1,"api_key":"q' || k || '"}'
         ELSE '{"z":"user ' || user_id || '", "inner":{"password":"p' || k || '","n": ' || k || '.50},"a":[true,null]}' END AS doc
  FROM judged
)"""
ALL = (O.EVENTS, O.BASE, O.JUDGED, _DOC)


def documents(spark, sf_dir):
    k = F.col("k").cast("string")
    rid = F.md5(F.concat(F.lit("s"), F.col("arrival").cast("string")).cast("binary"))
    tail = F.concat(F.lit(',"request_id":"'), rid, F.lit('","kind":"'), F.col("event_type"), F.lit('"}'))
    kind = F.col("k") % 10
    doc = (
        F.when(kind == 3, F.concat(F.lit('{"status":200'), tail))
        .when(kind == 4, F.concat(F.lit('{"status":"200"'), tail))
        .when(kind == 5, F.concat(F.lit('{"n": '), k, F.lit(', "a":['), k, F.lit(',"x"],"n":1,"api_key":"q'), k, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"z":"user '), F.col("user_id").cast("string"), F.lit('", "inner":{"password":"p'), k,
                            F.lit('","n": '), k, F.lit('.50},"a":[true,null]}')))
    )
    return A.judged_events(spark, sf_dir).withColumn("doc", doc)


@query("redacted_documents", O.with_ctes(*ALL, """
SELECT id, k % 10 = 5 OR k % 10 NOT IN (3, 4, 5) AS changed, k % 10 = 5 AS ambiguous,
  CASE WHEN k % 10 = 3 THEN '{"kind":"' || event_type || '","request_id":"' || rid || '","status":200}'
       WHEN k % 10 = 4 THEN '{"kind":"' || event_type || '","request_id":"' || rid || '","status":"200"}'
       WHEN k % 10 = 5 THEN '{"n":' || k || ',"a":[' || k || ',"x"],"n":1,"api_key":"[REDACTED]"}'
       ELSE '{"a":[true,null],"inner":{"n":' || k || '.50,"password":"[REDACTED]"},"z":"user ' || user_id || '"}' END AS safe
FROM docs"""))
def redacted_documents(spark, sf_dir):
    return R.with_redaction(documents(spark, sf_dir), "doc").select("id", "safe", "changed", "ambiguous")


@query("document_templates", O.with_ctes(*ALL, """
SELECT CASE WHEN k % 10 = 3 THEN '{"kind":"' || event_type || '","request_id":"<id>","status":200}'
       WHEN k % 10 = 4 THEN '{"kind":"' || event_type || '","request_id":"<id>","status":"200"}'
       WHEN k % 10 = 5 THEN '{"a":[' || k || ',"x"],"api_key":"q' || k || '","n":1}'
       ELSE '{"a":[true,null],"inner":{"n":' || k || '.50,"password":"p' || k || '"},"z":"user ' || user_id || '"}' END AS template, count(*) AS events
FROM docs GROUP BY 1"""))
def document_templates(spark, sf_dir):
    return M.with_template(documents(spark, sf_dir), "doc").groupBy("template").agg(F.count(F.lit(1)).alias("events"))


@query("document_shapes", O.with_ctes(*ALL, """
SELECT CASE WHEN k % 10 = 3 THEN '=object,/kind=string,/request_id=string,/status=number'
            WHEN k % 10 = 4 THEN '=object,/kind=string,/request_id=string,/status=string'
            WHEN k % 10 <> 5 THEN '=object,/a=array,/a/0=boolean,/a/1=null,/inner=object,/inner/n=number,/inner/password=string,/z=string' END AS shape,
  count(*) AS events, count(DISTINCT CASE WHEN k % 10 IN (3, 4) THEN '"' || rid || '"' END) AS ids FROM docs GROUP BY 1"""))
def document_shapes(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("f", M.flatten_json("doc"))
    shape = F.when(F.col("f.shape").isNotNull(), F.array_join(F.transform(
        F.array_sort(F.map_entries("f.shape")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))
    return d.groupBy(shape.alias("shape")).agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct(F.try_element_at(F.col("f.leaves"), F.lit("/request_id"))).alias("ids"),
    )


def _template_rules(spark, sf_dir):
    """One reviewed rule per namespace, built from the namespaces in the data."""
    ns = A.load(spark, sf_dir, "events", [(F.col("user_id") % 3).alias("n")]).distinct()
    shape = F.create_map(*[F.lit(x) for x in (
        "", "object", "/kind", "string", "/request_id", "string", "/status", "number")])
    name = F.concat(F.lit("ns"), F.col("n").cast("string"))
    return RS.typed_template_rules(ns.select(
        F.col("n").alias("pos"), F.concat(F.lit("rule-"), name).alias("id"), F.lit(1).alias("version"),
        (F.lit(2000000000) - F.when(F.col("n") == 2, 1000000000).otherwise(0)).cast("bigint").alias("expires_at"),
        F.concat(F.lit('{"type":"kubernetes","namespace":"'), name, F.lit('"}')).alias("source_scope"),
        shape.alias("shape"), F.lit('{"/kind":"click"}').alias("required_literals"),
        F.array(F.when(F.col("n") == 1, "/status").otherwise("/request_id")).alias("normalize_paths"),
        F.lit('{"/status":200}').alias("protected_literals"),
        F.struct(F.lit("r").alias("reviewer"), F.lit("r1").alias("review_id"), F.lit("manual-v1").alias("compiler"),
                 F.lit(1600000000).cast("bigint").alias("reviewed_at")).alias("review"),
        F.struct(F.lit("").alias("text"), F.lit("").alias("clock_grammar")).alias("prefix_identity"),
    ))


@query("template_rule_violations", """
SELECT DISTINCT 'rule-ns' || (user_id % 3) AS id, CASE user_id % 3 WHEN 1 THEN 'unsafe_normalization' ELSE 'expired' END AS reason
FROM events WHERE user_id % 3 <> 0""")
def template_rule_violations(spark, sf_dir):
    return RS.template_rule_violations(_template_rules(spark, sf_dir), F.lit(1700000000))


@query("reviewed_templates", O.with_ctes(*ALL, """
SELECT CASE WHEN k % 10 = 3 AND event_type = 'click' AND source.namespace = 'ns0' AND NOT truncated AND NOT sensitive AND NOT parse_uncertain
  THEN 'rule-ns0' END AS rule_id, count(*) AS events,
  count(DISTINCT CASE WHEN k % 10 = 3 AND event_type = 'click' AND source.namespace = 'ns0' AND NOT truncated AND NOT sensitive AND NOT parse_uncertain THEN 1 END) AS templates
FROM docs GROUP BY 1"""))
def reviewed_templates(spark, sf_dir):
    """All ids collapse to one template; the expired and the unsafe rule never apply."""
    ev = documents(spark, sf_dir).withColumn("text", F.col("doc"))
    rules = _template_rules(spark, sf_dir)
    bad = RS.template_rule_violations(rules, F.lit(1700000000))
    good = rules.join(bad.select("id"), "id", "left_anti")
    return TR.match_template_rules(ev, good, F.lit(1700000000)).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("reviewed_template").alias("templates")
    )


_GROUPED = r"""
grouped AS (SELECT *, k % 10 IN (3, 4, 5) AND NOT truncated AND NOT sensitive AND NOT parse_uncertain AS ok,
  k % 10 = 3 AND event_type = 'click' AND source.namespace = 'ns0' AS ruled,
  CASE WHEN k % 10 IN (3, 4) THEN regexp_replace(doc, '"request_id":"[0-9a-f]{32}"', '"request_id":"<id>"') ELSE doc END AS strict FROM docs),
keys AS (
  SELECT 'off' AS strategy, NULL AS family, 'ineligible' AS grouping FROM grouped
  UNION ALL SELECT 'exact', CASE WHEN ok THEN concat_ws('|', source_json, doc, base_important) END, CASE WHEN ok THEN 'exact' ELSE 'ineligible' END FROM grouped
  UNION ALL SELECT 'semantic', CASE WHEN ok AND ruled THEN concat_ws('|', source_json, base_important) END,
    CASE WHEN NOT ok THEN 'ineligible' WHEN ruled THEN 'reviewed' ELSE 'reviewed_miss' END FROM grouped
  UNION ALL SELECT 'drain', CASE WHEN ok AND ruled THEN concat_ws('|', 'reviewed', source_json, base_important)
      WHEN ok THEN concat_ws('|', source.namespace, strict, base_important) END,
    CASE WHEN NOT ok THEN 'ineligible' WHEN ruled THEN 'reviewed' ELSE 'drain' END FROM grouped)"""


@query("grouping_strategies", O.with_ctes(*ALL, _GROUPED, """
SELECT strategy, grouping, count(*) AS events, count(DISTINCT family) AS families FROM keys GROUP BY ALL"""))
def grouping_strategies(spark, sf_dir):
    """Every strategy over structured messages, with reviewed rules taking precedence."""
    ev = documents(spark, sf_dir).withColumn("text", F.col("doc"))
    rules = _template_rules(spark, sf_dir)
    good = written(rules.join(RS.template_rule_violations(rules, F.lit(1700000000)).select("id"), "id", "left_anti"), "good-rules")
    out = None
    for strategy in ("off", "exact", "semantic", "drain"):
        some = TR.with_grouping(ev, strategy, rules=None if strategy in ("off", "exact") else good, now=F.lit(1700000000))
        some = some.groupBy("grouping").agg(
            F.count(F.lit(1)).alias("events"), F.countDistinct("template_key").alias("families")
        ).withColumn("strategy", F.lit(strategy))
        out = some if out is None else out.unionByName(some)
    return out


@query("template_evidence", O.with_ctes(*GROUPS, """
texts AS (SELECT template_key, text, min(arrival) AS first FROM fam WHERE template_key IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY template_key ORDER BY first) AS r FROM texts),
total AS (SELECT template_key, count(*) AS occurrences, max_by(importance, arrival) AS importance FROM fam WHERE template_key IS NOT NULL GROUP BY 1),
picked AS (SELECT template_key, string_agg(text, '|' ORDER BY first) AS samples FROM ranked WHERE r <= 8 GROUP BY 1)""", """
SELECT template_key, occurrences, importance, samples FROM total JOIN picked USING (template_key)"""))
def template_evidence(spark, sf_dir):
    e = N.template_evidence(keyed_events(spark, sf_dir))
    return e.select(
        "template_key", "occurrences", F.col("current_verdict.importance").alias("importance"),
        F.array_join("samples", "|").alias("samples"),
    )


@query("learning_thresholds", O.with_ctes(*GROUPS, """
SELECT id, template_key, n AS occurrences FROM (SELECT *, row_number() OVER (PARTITION BY template_key ORDER BY ts_s, arrival) AS n
  FROM fam WHERE template_key IS NOT NULL) WHERE n IN (4, 32, 256, 2048)"""))
def learning_thresholds(spark, sf_dir):
    return N.learning_thresholds(keyed_events(spark, sf_dir), 4).select("id", "template_key", "occurrences")


# Families are followed batch by batch; ``nxt`` counts the requests that each has made.
_REQUESTED = """
met AS (SELECT template_key AS key, arrival // 40 AS b, min(arrival) AS first, count(*) AS n FROM fam WHERE template_key IS NOT NULL GROUP BY 1, 2),
touched AS (SELECT key, b, first, sum(n) OVER (PARTITION BY key ORDER BY b) AS occ FROM met),
lane(b, key, nxt, asked, first, occ) AS (
  SELECT DISTINCT -1::BIGINT, key, 0, false, 0::BIGINT, 0::HUGEINT FROM touched
  UNION ALL SELECT l.b + 1, l.key, l.nxt + asks::INT, asks, l.tf, l.tocc FROM (
    SELECT *, ready AND count(*) FILTER (ready) OVER (ORDER BY tf ROWS UNBOUNDED PRECEDING) <= 2 AS asks FROM (
      SELECT s.b, s.key, s.nxt, t.first AS tf, t.occ AS tocc, coalesce(s.nxt < 4 AND t.occ >= [4, 32, 256, 2048][s.nxt + 1], false) AS ready
      FROM lane s LEFT JOIN touched t ON t.key = s.key AND t.b = s.b + 1 WHERE s.b < (SELECT max(b) FROM touched))) l)"""


@query("learning_requests", O.with_ctes(*GROUPS, _REQUESTED, """
SELECT key AS template_key, b AS batch, first, occ::BIGINT AS occurrences, nxt AS request FROM lane WHERE asked"""))
def learning_requests(spark, sf_dir):
    """Batches of forty events, each with two requests at most; refused families wait for their next batch."""
    ev = keyed_events(spark, sf_dir).withColumn("batch", F.floor(F.col("arrival") / 40).cast("bigint"))
    return N.learning_requests(ev, 4)


@query("validated_proposals", O.with_ctes(*ALL, """
SELECT source.pod || '/' || (k % 10) AS template_key, name, name = 'ids' AND k % 10 IN (3, 4) AND count(DISTINCT doc) >= 2 AS accepted
FROM docs, (VALUES ('ids'), ('status')) AS t(name) GROUP BY source.pod, k % 10, name"""))
def validated_proposals(spark, sf_dir):
    """Two proposals per pod and kind of message: one masks the request id, one the protected status. Messages of other kinds lack the paths."""
    ev = documents(spark, sf_dir).withColumn("text", F.col("doc")).withColumn(
        "template_key", F.concat_ws("/", "source.pod", (F.col("k") % 10).cast("string"))
    )
    evidence = N.template_evidence(ev)
    path = F.when(F.col("name") == "ids", "/request_id").otherwise("/status")
    proposals = evidence.select("template_key").withColumn(
        "name", F.explode(F.array(F.lit("ids"), F.lit("status")))
    ).select(
        "template_key", "name", F.lit(1).alias("version"), F.array(F.lit("/kind"), F.lit("/status")).alias("required"),
        F.array(path).alias("normalize"), F.array(F.lit("/status")).alias("protected"),
        F.lit(0.9).alias("confidence"), F.lit("opaque_identifiers").alias("explanation"),
    )
    return N.validate_proposals(evidence, proposals, 0.5).select("template_key", "name", "accepted")


@query("template_rule_file", """
SELECT row_number() OVER (ORDER BY n) - 1 AS pos, 'rule-ns' || n AS id, '"ns' || n || '"' AS namespace, '"click"' AS kind, 4::BIGINT AS paths
FROM (SELECT DISTINCT user_id % 3 AS n FROM events)""")
def template_rule_file(spark, sf_dir):
    """An artifact with one reviewed rule per namespace, written and read back."""
    ns = A.load(spark, sf_dir, "events", [(F.col("user_id") % 3).alias("n")]).distinct()
    name = F.concat(F.lit("ns"), F.col("n").cast("string"))
    shape = F.create_map(*[F.lit(x) for x in ("", "object", "/kind", "string", "/request_id", "string", "/status", "number")])
    rule = F.struct(
        F.concat(F.lit("rule-"), name).alias("id"), F.lit(1).alias("version"), F.lit(2000000000).cast("bigint").alias("expires_at"),
        F.concat(F.lit('{"type":"kubernetes","namespace":"'), name, F.lit('"}')).alias("source_scope"), shape.alias("shape"),
        F.lit('{"/kind":"click"}').alias("required_literals"), F.array(F.lit("/request_id")).alias("normalize_paths"),
    )
    doc = ns.agg(F.to_json(F.struct(
        F.lit(2).alias("artifact_version"), F.lit(1).alias("schema_version"), F.sort_array(F.collect_list(rule.dropFields("shape"))).alias("rules"),
    )).alias("value"))
    doc = doc.select(F.replace("value", F.lit('"normalize_paths"'), F.concat(F.lit('"shape":'), F.to_json(shape), F.lit(',"normalize_paths"'))).alias("value"))
    folder = f"{shared_dir(spark)}/artifact-{uuid.uuid4().hex}"
    doc.write.text(folder)
    return RS.read_template_rules(spark, folder).select(
        F.col("pos").cast("bigint").alias("pos"), "id", F.col("scope")["namespace"].alias("namespace"), F.col("required")["/kind"].alias("kind"),
        F.size("shape").cast("bigint").alias("paths"),
    )


@query("escalated_events", O.with_ctes(*GROUPS, """
cur AS (SELECT template_key, max_by(importance, arrival) AS cur, count(*) AS n FROM fam WHERE template_key IS NOT NULL GROUP BY 1),
act AS (SELECT template_key FROM cur WHERE cur <> 'important' AND n % 2 = 0)""", """
SELECT id, template_key IN (SELECT template_key FROM act) AND importance <> 'important' AS escalated,
  CASE WHEN template_key IN (SELECT template_key FROM act) THEN 'important' ELSE importance END AS importance
FROM fam WHERE template_key IS NOT NULL"""))
def escalated_events(spark, sf_dir):
    """Families of even size get a concrete incident review, the others only a vague one."""
    ev = M.families(keyed_events(spark, sf_dir))
    evidence = N.template_evidence(ev)
    review = F.struct(
        F.array().cast("array<string>").alias("free_text_fields"), F.lit("important").alias("importance"),
        F.lit("impact").alias("severity"), F.lit("dependency").alias("category"), F.lit(0.9).alias("confidence"),
        F.when(F.col("occurrences") % 2 == 0, "upstream_failure").otherwise("pattern_burst").alias("explanation"),
    )
    reviews = evidence.select("template_key", review.alias("review"))
    return N.apply_escalations(ev, evidence, reviews).select("id", "escalated", "judgment.importance")


@query("learning_decisions", O.with_ctes(*GROUPS, """
cur AS (SELECT template_key, max_by(importance, arrival) AS cur, count(*) AS n FROM fam WHERE template_key IS NOT NULL GROUP BY 1),
fired AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template_key ORDER BY ts_s, arrival) AS seen FROM fam WHERE template_key IS NOT NULL) WHERE seen IN (4, 32, 256, 2048))""", """
SELECT template_key, seen, CASE WHEN cur <> 'important' AND n % 2 = 0 THEN 'escalated' ELSE 'reviewed_fields_require_artifact' END AS outcome
FROM fired JOIN cur USING (template_key) ORDER BY arrival DESC LIMIT 1000"""))
def learning_decisions(spark, sf_dir):
    # Written, as evidence and thresholds read them: masking a message costs far more than reading it.
    ev = written(M.families(keyed_events(spark, sf_dir)).select("template_key", "version_id", "text", "judgment", "arrival", "ts_s"), "families")
    evidence = written(N.template_evidence(ev), "evidence")
    review = F.struct(
        F.array().cast("array<string>").alias("free_text_fields"), F.lit("important").alias("importance"),
        F.lit("impact").alias("severity"), F.lit("dependency").alias("category"), F.lit(0.9).alias("confidence"),
        F.when(F.col("occurrences") % 2 == 0, "upstream_failure").otherwise("pattern_burst").alias("explanation"),
    )
    reviews = evidence.select("template_key", review.alias("review"))
    fired = N.learning_thresholds(ev, 4)
    return N.decisions(fired, reviews=reviews, evidence=evidence).select("template_key", "seen", "outcome")
