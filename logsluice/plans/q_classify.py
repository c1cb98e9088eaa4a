"""Queries: line cleaning, redaction and classification expressions."""

from pyspark.sql import functions as F

from ..functions import classify as C, redact as R, text as X
from . import adapters as A, oracle as O
from .catalog import query


@query("baseline_counts", O.with_ctes(O.EVENTS, O.BASE, """
SELECT event_type, count(*) AS events, count(*) FILTER (sig_error) AS error_keyword,
  count(*) FILTER (sig_http) AS http_5xx, count(*) FILTER (sig_warn) AS warning_level,
  count(*) FILTER (sig_error OR sig_http OR sig_warn) AS important
FROM base GROUP BY event_type"""))
def baseline_counts(spark, sf_dir):
    ev = A.events_log(spark, sf_dir, with_ids=False).withColumn("b", C.baseline("text"))
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.array_contains("b.signals", "error_or_failure_keyword")).alias("error_keyword"),
        F.count_if(F.array_contains("b.signals", "http_5xx")).alias("http_5xx"),
        F.count_if(F.array_contains("b.signals", "warning_level")).alias("warning_level"),
        F.count_if("b.important").alias("important"),
    )


@query("offline_verdicts", O.with_ctes(O.EVENTS, O.BASE, """
SELECT id, CASE WHEN sig_error OR sig_http OR sig_warn THEN 'important' ELSE 'uncertain' END AS importance,
  CASE WHEN sig_error OR sig_http OR sig_warn THEN 'degraded' ELSE 'info' END AS severity, 'unknown' AS category,
  array_to_string(list_filter([CASE WHEN sig_error THEN 'error_or_failure_keyword' END,
    CASE WHEN sig_http THEN 'http_5xx' END, CASE WHEN sig_warn THEN 'warning_level' END], lambda x: x IS NOT NULL), ',') AS signals
FROM base"""))
def offline_verdicts(spark, sf_dir):
    ev = A.events_log(spark, sf_dir).withColumn("b", C.baseline("text"))
    j = C.offline_judgment("b.important")
    return ev.withColumn("j", j).select(
        "id", "j.importance", "j.severity", "j.category",
        F.array_join("b.signals", ",").alias("signals"),
    )


@query("event_identity", O.with_ctes(O.EVENTS, "SELECT arrival, id, group_id, source_id FROM ev"))
def event_identity(spark, sf_dir):
    return A.events_log(spark, sf_dir).select("arrival", "id", "group_id", "source_id")


@query("policy_decisions", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, O.DECIDED, """
SELECT event_type, importance, category, decision, count(*) AS events FROM decided GROUP BY ALL"""))
def policy_decisions(spark, sf_dir):
    ev = A.judged_events(spark, sf_dir)
    decision = C.policy_decision("judgment", "truncated", "sensitive", "parse_uncertain")
    return ev.groupBy(
        "event_type", F.col("judgment.importance").alias("importance"),
        F.col("judgment.category").alias("category"), decision.alias("decision"),
    ).agg(F.count(F.lit(1)).alias("events"))


@query("verdict_flags", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, O.DECIDED, r"""
SELECT id, reusable,
  (analysis_error IS NULL AND importance IN ('important','routine','uncertain') AND severity <> 'unknown'
    AND i_conf IS NOT NULL AND s_conf IS NOT NULL AND c_conf IS NOT NULL) AS valid,
  (NOT parse_uncertain AND NOT truncated AND NOT sensitive
    AND NOT regexp_matches(text, '(?i)auth|credential|password|permission|privilege|security|fraud|attack|denied|forbidden|token|secret|payment|role')) AS groupable,
  CASE WHEN i_conf IS NULL THEN 'unscored' WHEN i_conf >= 0.9 THEN 'high' WHEN i_conf >= 0.7 THEN 'medium' ELSE 'low' END AS band,
  source.namespace || '/' || source.pod || '/app' AS label,
  importance IN ('important','routine') AND base_important <> (importance = 'important') AS disagrees
FROM decided"""))
def verdict_flags(spark, sf_dir):
    ev = A.judged_events(spark, sf_dir)
    return ev.select(
        "id", C.reusable("judgment").alias("reusable"), C.valid_judgment("judgment").alias("valid"),
        C.groupable("text", "truncated", "sensitive", "parse_uncertain").alias("groupable"),
        C.confidence_band(C.confidence_value("judgment")).alias("band"),
        C.source_label("source").alias("label"),
        C.baseline_disagrees("judgment.importance", "baseline.important").alias("disagrees"),
    )


# The quoted and unquoted forms of a secret pair, in the other engine's dialect.
_SCRUB = r"""
scrubbed AS (
  SELECT path, line_no, raw,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw,
      '(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]+', '\1 [REDACTED]', 'g'),
      '(\b[a-zA-Z][a-zA-Z0-9+.-]{0,31}://)[^\s/@:]+:[^\s/@]+@', '\1[REDACTED]@', 'g'),
      '\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b', '[REDACTED]', 'g'),
      '(?i)(["'']?(?:password|passwd|secret|(?:access_|refresh_)?token|api[-_]?key|access[-_]?key(?:[-_]?id)?|private[-_]?key|authorization|cookie|credentials?)["'']?\s*[:=]\s*)("(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*''|[^\s,;]+)',
      '\1"[REDACTED]"', 'g') AS safe
  FROM doc_lines
)"""


@query("document_lines", O.with_ctes(O.DOC_LINES, """
SELECT path, count(*) AS lines, sum(strlen(raw))::BIGINT AS bytes, max(line_no)::BIGINT AS last_line FROM doc_lines GROUP BY path"""))
def document_lines(spark, sf_dir):
    return A.doc_lines(spark, sf_dir).groupBy(F.col("source.path").alias("path")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length("raw").cast("bigint")).alias("bytes"),
        F.max("line_no").alias("last_line"),
    )


@query("scrubbed_lines", O.with_ctes(O.DOC_LINES, _SCRUB, """
SELECT path, line_no::BIGINT AS line_no, safe, safe <> raw AS changed FROM scrubbed"""))
def scrubbed_lines(spark, sf_dir):
    lines = A.doc_lines(spark, sf_dir)
    return R.with_redaction(lines, "raw", with_json=False).select(
        F.col("source.path").alias("path"), "line_no", "safe", "changed"
    )


@query("console_lines", O.with_ctes(O.DOC_LINES, r"""
SELECT path, line_no::BIGINT AS line_no, regexp_replace(raw, '[\x00-\x1f\x7f-\x{9f}]', ' ', 'g') AS line FROM doc_lines"""))
def console_lines(spark, sf_dir):
    return A.doc_lines(spark, sf_dir).select(
        F.col("source.path").alias("path"), "line_no", X.console_safe("raw").alias("line")
    )


@query("clipped_documents", """
SELECT doc_id, strlen(t) AS kept_bytes, md5(t) AS digest, strlen(text) > 16000 AS truncated FROM (
  SELECT doc_id, text, CASE WHEN strlen(text) <= 16000 THEN text ELSE (
    SELECT max_by(substr(text, 1, n), n) FROM (SELECT unnest(range(4000, 16001)) AS n) WHERE n <= length(text) AND strlen(substr(text, 1, n)) <= 16000)
    END AS t FROM documents)""")
def clipped_documents(spark, sf_dir):
    docs = A.load(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.withColumn("t", X.clip_bytes("text", 16000)).select(
        "doc_id", F.octet_length("t").cast("bigint").alias("kept_bytes"), F.md5("t").alias("digest"),
        (F.octet_length("text") > 16000).alias("truncated"),
    )
