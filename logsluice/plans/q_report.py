"""Queries: report parts and retention."""

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import report as R, usage as G
from . import adapters as A, oracle as O
from .catalog import query
from .q_reuse import _CALLS, _calls


def offline_events(spark, sf_dir):
    """Keyword verdicts only."""
    ev = A.events_log(spark, sf_dir).withColumn("baseline", C.baseline("text"))
    return ev.withColumn("judgment", C.offline_judgment("baseline.important"))


@query("important_groups", O.with_ctes(O.EVENTS, O.BASE, """
SELECT group_id, min_by(source_id, arrival) AS source_id, min_by(text, arrival) AS text,
  'degraded' AS severity, 'unknown' AS category, count(*) AS count
FROM base WHERE sig_error OR sig_http OR sig_warn GROUP BY group_id"""))
def important_groups(spark, sf_dir):
    return R.important_groups(offline_events(spark, sf_dir))


@query("top_important_groups", O.with_ctes(O.EVENTS, O.BASE, """
SELECT group_id, '×' || count(*) || ' ' || min_by(text, arrival) AS line
FROM base WHERE sig_error OR sig_http OR sig_warn GROUP BY group_id
ORDER BY count(*) DESC, group_id LIMIT 20"""))
def top_important_groups(spark, sf_dir):
    return R.top_lines(R.important_groups(offline_events(spark, sf_dir)), 20)


@query("report_summary", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
SELECT count(*) AS events, count(*) AS lines, count(DISTINCT source_id) AS streams,
  count(*) FILTER (importance = 'important') AS important,
  count(*) FILTER (importance = 'routine') AS routine,
  count(*) FILTER (importance = 'uncertain') AS uncertain,
  count(*) FILTER (importance = 'unknown') AS unknown, 0::BIGINT AS reused_events
FROM judged"""))
def report_summary(spark, sf_dir):
    return R.summary(A.judged_events(spark, sf_dir))


@query("run_summary", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, _CALLS, """
spent AS (SELECT count(*) AS n, sum(input_tokens * 1000 + output_tokens * 4000) FILTER (finished AND output_tokens IS NOT NULL)::BIGINT AS nano,
  bool_and(NOT finished OR (output_tokens IS NOT NULL AND input_tokens * 1000 + output_tokens * 4000 <= request_bytes * 1000 + 16384 * 4000)) AS whole FROM calls)""", """
SELECT count(*) AS events, count(*) AS lines, count(DISTINCT source_id) + (SELECT count(DISTINCT user_id) FROM ev WHERE truncated) AS streams,
  count(*) FILTER (importance = 'important') AS important, count(*) FILTER (importance = 'routine') AS routine,
  count(*) FILTER (importance = 'uncertain') AS uncertain, count(*) FILTER (importance = 'unknown') AS unknown, 0::BIGINT AS reused_events,
  count(*) FILTER (truncated) AS coverage_gaps, any_value(n) AS api_requests, any_value(nano) / 1e9::DOUBLE AS total_estimated_cost_usd,
  any_value(whole) AS cost_complete FROM judged, spent"""))
def run_summary(spark, sf_dir):
    """A run with calls that cost money and sources of which only gaps are known."""
    lost = A.events_log(spark, sf_dir, with_ids=False).where("truncated").select(
        A.source_struct(type="file", path=F.concat(F.lit("lost/"), F.col("user_id").cast("string"))).alias("source"),
        F.lit("file_unavailable").alias("status"),
    )
    spent = G.usage_rollup(_calls(spark, sf_dir), G.Prices(input_nano_usd=1000, output_nano_usd=4000))
    return R.summary(A.judged_events(spark, sf_dir), gaps=lost, usage=spent)


def gap_rows(spark, sf_dir):
    """Every truncated event counts as a source whose input was incomplete."""
    ev = A.events_log(spark, sf_dir, with_ids=False)
    return ev.where("truncated").select(
        "source", "arrival",
        F.when(F.col("user_id") % 2 == 0, "input_incomplete").otherwise("stream_reconnect").alias("status"),
    )


_GAPS = """
gaps AS (SELECT arrival, CASE WHEN user_id % 2 = 0 THEN 'input_incomplete' ELSE 'stream_reconnect' END AS status
         FROM ev WHERE truncated),
metrics AS (
  SELECT 'truncated_events' AS metric, count(*) FILTER (truncated) AS value FROM ev
  UNION ALL SELECT 'parse_uncertain', count(*) FILTER (parse_uncertain) FROM ev
  UNION ALL SELECT 'evicted_events', greatest(count(*) - 2000, 0) FROM ev
  UNION ALL SELECT 'coverage_' || status, count(*) FROM gaps GROUP BY status
  UNION ALL SELECT 'coverage_gaps', count(*) FROM gaps
  UNION ALL SELECT 'coverage_records_omitted', greatest(count(*) - 500, 0) FROM gaps
)"""


@query("loss_counters", O.with_ctes(O.EVENTS, _GAPS, "SELECT metric, value FROM metrics"))
def loss_counters(spark, sf_dir):
    ev = A.events_log(spark, sf_dir, with_ids=False)
    return R.loss_counters(ev, gap_rows(spark, sf_dir), retain=2000)


@query("report_completeness", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, _GAPS, """
SELECT bool_and(value = 0) AND (SELECT count(*) = 0 FROM judged WHERE importance = 'unknown')
  AS complete_within_window FROM metrics"""))
def report_completeness(spark, sf_dir):
    judged = A.judged_events(spark, sf_dir)
    metrics = R.loss_counters(judged, gap_rows(spark, sf_dir), retain=2000)
    return R.completeness(
        metrics, unknown_verdicts=judged.where(F.col("judgment.importance") == "unknown")
    )


@query("group_members", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
SELECT group_id, id, arrival FROM judged WHERE importance = 'important'"""))
def group_members(spark, sf_dir):
    return R.group_members(A.judged_events(spark, sf_dir))


@query("retained_tail", O.with_ctes(O.EVENTS, """
SELECT arrival, id, text FROM ev ORDER BY arrival DESC LIMIT 2000"""))
def retained_tail(spark, sf_dir):
    return R.retain_last(A.events_log(spark, sf_dir), 2000).select("arrival", "id", "text")


@query("coverage_log", O.with_ctes(O.EVENTS, _GAPS, """
SELECT arrival, status FROM gaps ORDER BY arrival DESC LIMIT 500"""))
def coverage_log(spark, sf_dir):
    return R.coverage_log(gap_rows(spark, sf_dir), "arrival").select("arrival", "status")


@query("evidence_lines", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
SELECT id, 0::BIGINT AS line_no, '[' || importance || '/' || severity || '/' || category || '] '
  || to_json({'type': 'kubernetes', 'context': 'demo', 'namespace': source.namespace, 'pod': source.pod,
      'container': 'app', 'kind': 'container', 'previous': false, 'restart_count': 0}) || ' #' || id AS line FROM judged
UNION ALL SELECT id, 1, '  ' || text FROM judged
UNION ALL SELECT id, 2, '  analysis: ' || analysis_error FROM judged WHERE analysis_error IS NOT NULL"""))
def evidence_lines(spark, sf_dir):
    return R.evidence_lines(A.judged_events(spark, sf_dir))


@query("evicted_table", O.with_ctes(O.EVENTS, """
SELECT * FROM (SELECT arrival, ts_s AS at FROM ev WHERE NOT truncated ORDER BY ts_s DESC, arrival DESC
  LIMIT greatest(0, 1000 - (SELECT count(*) FROM ev WHERE truncated)))
UNION ALL SELECT arrival, ts_s FROM ev WHERE truncated"""))
def evicted_table(spark, sf_dir):
    ev = A.events_log(spark, sf_dir, with_ids=False)
    return R.evict_oldest(
        ev.select("arrival", F.col("ts_s").alias("at"), "truncated"), 1000, "at", "arrival",
        F.col("truncated"),
    ).drop("truncated")


@query("event_page", O.with_ctes(O.EVENTS, """
SELECT arrival, id, text, false AS event_unavailable, json FROM (
  SELECT arrival, id, text, json, sum(strlen(json) + 1) OVER (ORDER BY arrival) AS used FROM (
    SELECT arrival, id, text, CAST(to_json({'arrival': arrival, 'id': id, 'text': text}) AS VARCHAR) AS json
    FROM ev WHERE contains(lower(text), 'error') ORDER BY arrival LIMIT 200 OFFSET 100))
WHERE used <= 20000"""))
def event_page(spark, sf_dir):
    ev = A.events_log(spark, sf_dir).select("arrival", "id", "text")
    return R.page_events(ev.where(F.lower("text").contains("error")), 100, 200, 20000)
