"""Queries: templates, dossiers, judging and fan-out."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions import templates as M
from ..operators import dossier as D
from . import adapters as A, oracle as O
from .catalog import query

# Only request ids vary in the strict form; every number but a protected one in the classic.
TEMPLATES = r"""
tpl AS (
  SELECT *, regexp_replace(text, 'request_id=[0-9a-f]{32}', 'request_id=<id>') AS strict,
    regexp_replace(regexp_replace(regexp_replace(text, 'request_id=[0-9a-f]{32}', 'request_id=<id>'),
      'user_id=\d+', 'user_id=<value>'), ' n=\d+', ' n=<value>') AS classic
  FROM decided
),
keyed AS (
  SELECT *, NOT parse_uncertain AND NOT truncated AND NOT sensitive AS eligible,
    sha256(concat_ws(chr(31), 'template-v1', 'drain', 'classic', classic)) AS version_id,
    CAST(to_json({'type': 'kubernetes', 'cluster_id': NULL, 'context': 'demo', 'namespace': source.namespace,
      'container': 'app', 'kind': 'container', 'previous': false, 'restart_count': 0}) AS VARCHAR) AS scope
  FROM tpl
),
fam AS (
  SELECT *, CASE WHEN eligible THEN sha256(concat_ws(chr(31), 'family-v1', scope, version_id,
    CASE WHEN base_important THEN 'true' ELSE 'false' END)) END AS template_key FROM keyed
),
tick AS (SELECT *, coalesce(template_key, 'own:' || id) AS ticket, arrival // 1000 AS batch FROM fam)"""

ALL = (O.EVENTS, O.BASE, O.JUDGED, O.DECIDED, TEMPLATES)


def keyed_events(spark, sf_dir, stream=False):
    ev = A.judged_events(spark, sf_dir, stream)
    keyed = M.with_template_key(ev, "drain", "classic", with_json=False)
    return keyed.withColumn("batch", F.floor(F.col("arrival") / 1000).cast("bigint"))


@query("strict_templates", O.with_ctes(*ALL, """
SELECT strict AS template, count(*) AS events FROM tpl GROUP BY strict"""))
def strict_templates(spark, sf_dir):
    ev = A.events_log(spark, sf_dir, with_ids=False)
    return M.with_template(ev).groupBy("template").agg(F.count(F.lit(1)).alias("events"))


@query("classic_templates", O.with_ctes(*ALL, """
SELECT classic AS template, count(*) AS events FROM tpl GROUP BY classic"""))
def classic_templates(spark, sf_dir):
    ev = A.events_log(spark, sf_dir, with_ids=False)
    return M.with_template(ev, masking="classic", with_json=False).groupBy("template").agg(
        F.count(F.lit(1)).alias("events")
    )


@query("template_checkpoint", O.with_ctes(*ALL, """
SELECT template_key, version_id, count(*) AS seen FROM fam WHERE template_key IS NOT NULL GROUP BY ALL"""))
def template_checkpoint(spark, sf_dir):
    return D.template_checkpoint(keyed_events(spark, sf_dir))


_DOSSIERS = """
distinct_samples AS (SELECT batch, ticket, text AS sample, min(arrival) AS first FROM tick GROUP BY batch, ticket, text),
samples AS (SELECT *, row_number() OVER (PARTITION BY batch, ticket ORDER BY first) AS r,
  count(*) OVER (PARTITION BY batch, ticket) AS d FROM distinct_samples),
picked AS (SELECT batch, ticket, any_value(d) > 8 AS samples_limited,
  string_agg(sample, '|' ORDER BY first) FILTER (r <= 8) AS samples FROM samples GROUP BY batch, ticket),
dossier AS (
  SELECT t.*, samples_limited, samples FROM (
    SELECT batch, ticket, count(*) AS window_occurrences, bool_or(base_important) AS baseline_important,
      bool_or(truncated) AS truncated, bool_or(sensitive) AS sensitive,
      bool_or(truncated OR parse_uncertain) AS evidence_limited, min(arrival) AS first_arrival,
      min_by(id, arrival) AS evidence_id FROM tick GROUP BY batch, ticket) t JOIN picked USING (batch, ticket)
)"""


@query("evidence_dossiers", O.with_ctes(*ALL, _DOSSIERS, """
SELECT batch, ticket, window_occurrences, baseline_important, truncated, sensitive, evidence_limited,
  samples_limited, false AS security_signal, first_arrival, evidence_id, samples FROM dossier"""))
def evidence_dossiers(spark, sf_dir):
    d = D.dossiers(keyed_events(spark, sf_dir))
    return d.select(
        "batch", "ticket", "window_occurrences", "baseline_important", "truncated", "sensitive",
        "evidence_limited", "samples_limited", "security_signal", "first_arrival", "evidence_id",
        F.array_join("samples", "|").alias("samples"),
    )


def severity_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in judge that looks at the first sample of each dossier."""
    first = batch["samples"].str[0]
    fault = first.str.contains("status=503", regex=False)
    error = first.str.startswith("ERROR")
    n = batch["window_occurrences"]
    return pd.DataFrame({
        "importance": ["important" if f or e else "routine" for f, e in zip(fault, error)],
        "severity": ["outage" if f else "info" for f in fault],
        "category": ["dependency" if f else "routine" for f in fault],
        "importance_confidence": [0.9 if c < 20 else 0.6 for c in n],
        "severity_confidence": 0.8, "category_confidence": 0.8, "analysis_error": None,
    })


_SCORED = """
scored AS (
  SELECT *, evidence_limited OR truncated OR sensitive OR samples_limited AS unsafe,
    CASE WHEN samples LIKE 'ERROR%' THEN 'important'
         WHEN evidence_limited OR truncated OR sensitive OR samples_limited OR window_occurrences >= 20 THEN 'uncertain'
         ELSE 'routine' END AS importance,
    regexp_matches(split_part(samples, '|', 1), 'status=503') AS fault,
    CASE WHEN window_occurrences < 20 THEN 0.9 ELSE 0.6 END AS i_conf
  FROM dossier
),
gated AS (SELECT *, NOT unsafe AND importance IN ('important', 'routine') AND i_conf >= 0.7 AND ticket NOT LIKE 'own:%' AS seeds FROM scored)"""


@query("gated_verdicts", O.with_ctes(*ALL, _DOSSIERS, _SCORED, """
SELECT batch, ticket, importance, CASE WHEN fault THEN 'outage' ELSE 'info' END AS severity,
  CASE WHEN fault THEN 'dependency' ELSE 'routine' END AS category, seeds FROM gated"""))
def gated_verdicts(spark, sf_dir):
    d = D.score_groups(D.dossiers(keyed_events(spark, sf_dir)), severity_judge)
    return D.gate_verdicts(d).select(
        "batch", "ticket", "judgment.importance", "judgment.severity", "judgment.category", "seeds"
    )


@query("verdict_fan_out", O.with_ctes(*ALL, _DOSSIERS, _SCORED, """
SELECT t.id, CASE WHEN t.arrival = g.first_arrival OR g.seeds THEN g.importance ELSE 'unknown' END AS importance,
  t.arrival <> g.first_arrival AND g.seeds AS analysis_reused,
  CASE WHEN t.arrival <> g.first_arrival AND g.seeds THEN g.evidence_id END AS representative_id
FROM tick t JOIN gated g USING (batch, ticket)"""))
def verdict_fan_out(spark, sf_dir):
    ev = keyed_events(spark, sf_dir).drop("judgment")
    v = D.gate_verdicts(D.score_groups(D.dossiers(ev), severity_judge))
    return D.fan_out(ev, v).select("id", "judgment.importance", "analysis_reused", "representative_id")


@query("analysis_counters", O.with_ctes(*ALL, _DOSSIERS, _SCORED, """
SELECT 'classifications' AS metric, count(*) AS value FROM gated
UNION ALL SELECT 'drain_group_assessments', count(*) FROM gated
UNION ALL SELECT 'drain_group_occurrences', sum(window_occurrences)::BIGINT FROM gated
UNION ALL SELECT 'drain_group_fanouts', sum(CASE WHEN seeds THEN window_occurrences - 1 ELSE 0 END)::BIGINT FROM gated"""))
def analysis_counters(spark, sf_dir):
    ev = keyed_events(spark, sf_dir).drop("judgment")
    v = D.gate_verdicts(D.score_groups(D.dossiers(ev), severity_judge))
    return D.analysis_counters(D.fan_out(ev, v), v)


@query("judging_batches", O.with_ctes(O.EVENTS, """
SELECT batch::BIGINT AS batch, count(*) AS events, min(arrival) AS first, max(arrival) AS last FROM (
  SELECT arrival, (row_number() OVER (ORDER BY arrival) - 1) // 64 AS batch FROM ev) GROUP BY batch"""))
def judging_batches(spark, sf_dir):
    ev = A.events_log(spark, sf_dir, with_ids=False)
    return D.chunk(ev.select("arrival"), 64).groupBy("batch").agg(
        F.count(F.lit(1)).alias("events"), F.min("arrival").alias("first"), F.max("arrival").alias("last")
    )


@query("judge_replies", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
SELECT id, (k % 4 <> 1 AND k NOT IN (99, 13)) AS accepted, CASE WHEN k % 4 <> 1 AND k NOT IN (99, 13) THEN importance END AS importance
FROM judged"""))
def judge_replies(spark, sf_dir):
    """Replies built from the verdicts; every fourth carries an unknown member."""
    ev = A.judged_events(spark, sf_dir)
    six = F.struct(*[F.col(f"judgment.{n}") for n in D._J_FIELDS[:6]])
    body = F.to_json(F.struct(F.array(six).alias("judgments")), {"ignoreNullFields": "false"})
    extra = F.regexp_replace(body, r"^\{", '{"note":"x",')
    replies = ev.select(
        "id", F.when(F.col("k") % 4 == 1, extra).otherwise(body).alias("reply"), F.lit(1).alias("expected")
    )
    out = D.parse_replies(replies)
    return out.select("id", "accepted", F.col("judgments")[0]["importance"].alias("importance"))
