"""Queries: search, context windows and merged views."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import classify as C, text as X
from ..operators import context as K, search as Z
from ..session import shared_dir, written
from . import adapters as A, oracle as O
from .catalog import query

QUESTION = "why did the error status 503 fail for user_id"

COARSE = """
coarse AS (SELECT * REPLACE (regexp_replace(text, ' request_id=[0-9a-f]+', '') AS text) FROM ev),
grouped AS (
  SELECT sha256(CAST(to_json({'source_id': source_id, 'text': text, 'truncated': truncated, 'sensitive': sensitive, 'parse_uncertain': parse_uncertain}) AS VARCHAR)) AS search_group,
    count(*) AS count, min(ts_raw) AS first_seen, max(ts_raw) AS last_seen, min(arrival) AS first_arrival, min_by(id, arrival) AS id,
    any_value(text) AS text, any_value(truncated) AS truncated, any_value(parse_uncertain) AS parse_uncertain,
    CAST(to_json({'type': 'kubernetes', 'context': 'demo', 'namespace': any_value(source.namespace), 'pod': any_value(source.pod),
      'container': 'app', 'kind': 'container', 'previous': false, 'restart_count': 0}) AS VARCHAR) AS source_json
  FROM coarse GROUP BY ALL
)"""
COARSE = COARSE.replace("FROM coarse GROUP BY ALL", "FROM coarse GROUP BY 1")
ALL = (O.EVENTS, COARSE)


def coarse_events(spark, sf_dir):
    """Events without their request ids, so equal evidence repeats."""
    ev = A.events_log(spark, sf_dir)
    return ev.withColumn("text", F.regexp_replace("text", " request_id=[0-9a-f]+", ""))


def groups(spark, sf_dir):
    # Every event delivered twice: repeated ids count once.
    ev = coarse_events(spark, sf_dir)
    return Z.occurrence_groups(ev.unionByName(ev.withColumn("arrival", F.col("arrival") + 10000000)))


@query("occurrence_groups", O.with_ctes(*ALL, """
SELECT search_group, id, text, count, first_seen, last_seen FROM grouped"""))
def occurrence_groups(spark, sf_dir):
    return groups(spark, sf_dir).select("search_group", "id", "text", "count", "first_seen", "last_seen")


@query("literal_search", O.with_ctes(*ALL, """
SELECT search_group, id, count FROM grouped WHERE contains(lower(text), 'status=503') ORDER BY count DESC, search_group LIMIT 20 OFFSET 20"""))
def literal_search(spark, sf_dir):
    found = Z.literal_search(groups(spark, sf_dir), "STATUS=503")
    return Z.result_page(found, offset=20).select("search_group", "id", "count")


_TERMS = ["503", "deadlock", "did", "error", "errors", "exhausted", "fail", "failed", "failing", "failure", "issue",
          "issues", "status", "timeout", "timeouts", "unavailable", "user_id", "why"]
_SCORE = " + ".join(f"contains(hay, '{t}')::BIGINT" for t in _TERMS)


@query("term_overlap", O.with_ctes(*ALL, f"""
SELECT score, count(*) AS groups FROM (SELECT {_SCORE} AS score FROM (SELECT lower(text) AS hay FROM grouped)) GROUP BY score"""))
def term_overlap(spark, sf_dir):
    return groups(spark, sf_dir).groupBy(Z.term_overlap("text", QUESTION).alias("score")).agg(
        F.count(F.lit(1)).alias("groups")
    )


@query("search_candidates", O.with_ctes(*ALL, f"""
SELECT search_group, score FROM (SELECT *, {_SCORE} AS score FROM (SELECT *, lower(text || source_json) AS hay FROM grouped))
ORDER BY score DESC, first_arrival LIMIT 128"""))
def search_candidates(spark, sf_dir):
    return Z.candidate_groups(groups(spark, sf_dir), QUESTION, 16).select("search_group", "score")


def text_judge(query_text: str, batch: pd.DataFrame) -> pd.DataFrame:
    fault = batch["text"].str.contains("status=503", regex=False)
    error = batch["text"].str.startswith("ERROR")
    return pd.DataFrame({
        "relevance": ["match" if f else "possible" if e else "unrelated" for f, e in zip(fault, error)],
        "confidence": [0.6 if n % 2 else 0.9 for n in batch["text"].str.len()],
    })


_RESULTS = f"""
cand AS (SELECT * FROM (SELECT *, {_SCORE} AS score FROM (SELECT *, lower(text || source_json) AS hay FROM grouped))
  WHERE first_arrival % 5 <> 0 ORDER BY score DESC, first_arrival LIMIT 512),
answered AS (
  SELECT search_group, count, CASE WHEN length(text) % 2 = 1 OR truncated OR parse_uncertain THEN 'possible'
      WHEN contains(text, 'status=503') THEN 'match' WHEN text LIKE 'ERROR%' THEN 'possible' ELSE 'unrelated' END AS relevance,
    CASE WHEN length(text) % 2 = 1 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence, false AS cached FROM cand
  UNION ALL SELECT search_group, count, 'match', 0.75::DOUBLE, true FROM grouped WHERE first_arrival % 5 = 0)"""


def _results(spark, sf_dir):
    g = groups(spark, sf_dir)
    cache = g.where("first_arrival % 5 = 0").select(
        Z.relevance_key(QUESTION).alias("key"), F.lit("match").alias("relevance"),
        F.lit(0.75).alias("confidence"), F.lit(1000).alias("at"),
    )
    return Z.score_relevance(g, QUESTION, text_judge, 64, cache, now=1200)


@query("relevance_page", O.with_ctes(*ALL, _RESULTS, """
SELECT search_group, relevance, confidence, cached FROM answered WHERE relevance <> 'unrelated'
ORDER BY CASE relevance WHEN 'match' THEN 0 ELSE 1 END, confidence DESC, count DESC, search_group LIMIT 20"""))
def relevance_page(spark, sf_dir):
    return Z.result_page(_results(spark, sf_dir)).select("search_group", "relevance", "confidence", "cached")


@query("search_summary", O.with_ctes(*ALL, _RESULTS, """
SELECT (SELECT count(*) FROM grouped) AS total_groups, count(*) AS examined_groups,
  (SELECT count(*) FROM grouped) - count(*) AS unexamined_groups, 0::BIGINT AS failed_groups,
  count(*) FILTER (cached) AS cache_hits, count(*) FILTER (relevance = 'match') AS matched_groups,
  count(*) FILTER (relevance = 'possible') AS possible_groups,
  sum(count) FILTER (relevance = 'match')::BIGINT AS matching_instances, (SELECT count(*) FROM grouped) > count(*) AS partial FROM answered"""))
def search_summary(spark, sf_dir):
    return Z.search_summary(_results(spark, sf_dir))


_ROUNDS = f"""
scored AS (SELECT *, {_SCORE} AS score FROM (SELECT *, lower(text || source_json) AS hay FROM grouped)),
said AS (SELECT *, CASE WHEN length(text) % 2 = 1 OR truncated OR parse_uncertain THEN 'possible'
  WHEN contains(text, 'status=503') THEN 'match' WHEN text LIKE 'ERROR%' THEN 'possible' ELSE 'unrelated' END AS relevance FROM scored),
one AS (SELECT * FROM said WHERE first_arrival % 3 <> 0 ORDER BY score DESC, first_arrival LIMIT 256),
two AS (SELECT * FROM said WHERE search_group NOT IN (SELECT search_group FROM one) ORDER BY score DESC, first_arrival LIMIT 256),
three AS (SELECT * FROM said WHERE search_group NOT IN (SELECT search_group FROM two) ORDER BY score DESC, first_arrival LIMIT 256)"""


@query("search_rounds", O.with_ctes(*ALL, _ROUNDS, """
SELECT 1 AS round, search_group, false AS cached, relevance FROM one UNION ALL SELECT 2, search_group, true, relevance FROM one
UNION ALL SELECT 2, search_group, false, relevance FROM two UNION ALL SELECT 3, search_group, true, relevance FROM two
UNION ALL SELECT 3, search_group, false, relevance FROM three"""))
def search_rounds(spark, sf_dir):
    """One question asked three times: before some groups have come, with all, and when the first answers have expired."""
    g = written(groups(spark, sf_dir), "search-groups")
    folder = f"{shared_dir(spark)}/relevance-{uuid.uuid4().hex}"
    out = None
    for n, (some, now) in enumerate(((g.where("first_arrival % 3 <> 0"), 1000), (g, 1200), (g, 1400)), 1):
        r = Z.search_round(some, QUESTION, text_judge, folder, now, budget=32).where("examined")
        r = r.select(F.lit(n).alias("round"), "search_group", "cached", "relevance")
        out = r if out is None else out.unionByName(r)
    return out


@query("scoped_search_events", O.with_ctes(O.EVENTS, """
SELECT id FROM ev WHERE source.namespace = 'ns1' AND source.pod = (SELECT 'pod' || min(user_id) FROM ev WHERE user_id % 3 = 1)"""))
def scoped_search_events(spark, sf_dir):
    ev = A.events_log(spark, sf_dir)
    pod = ev.where("user_id % 3 = 1").agg(F.min("user_id")).first()[0]
    both = ev.unionByName(ev.withColumn("arrival", F.col("arrival") + 10000000))
    scoped = Z.scope_events(both, {"namespace": "ns1"}, f"ns1/pod{pod}/app")
    return Z.first_by_id(scoped).select("id")


# The last error of each namespace: a few chosen events, however many there are in all.
_ANCHORS = """
anchors AS (SELECT max_by(id, arrival) AS anchor_id, max_by(ts_us, arrival) AS anchor_us FROM ev WHERE event_type = 'error' GROUP BY source.namespace)"""


def _time_context(spark, sf_dir):
    ev = A.events_log(spark, sf_dir)
    anchors = ev.where("event_type = 'error'").groupBy("source.namespace").agg(
        F.max_by("id", "arrival").alias("anchor_id"), F.max_by("ts_us", "arrival").alias("anchor_us")
    ).drop("namespace")
    return K.nearby_in_time(ev, anchors, 900)


@query("context_in_time", O.with_ctes(O.EVENTS, _ANCHORS, """
SELECT anchor_id, id FROM anchors JOIN ev ON ts_us BETWEEN anchor_us - 900000000 AND anchor_us + 900000000"""))
def context_in_time(spark, sf_dir):
    return _time_context(spark, sf_dir).select("anchor_id", "id")


@query("nearest_context", O.with_ctes(O.EVENTS, _ANCHORS, """
SELECT anchor_id, id, row_number() OVER (PARTITION BY anchor_id ORDER BY ts_us, line_start, id) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY abs(ts_us - anchor_us), ts_us, line_start, id) AS d
  FROM anchors JOIN ev ON ts_us BETWEEN anchor_us - 900000000 AND anchor_us + 900000000) WHERE d <= 4"""))
def nearest_context(spark, sf_dir):
    return K.nearest(_time_context(spark, sf_dir), 4).select("anchor_id", "id", "position")


@query("context_in_lines", O.with_ctes(O.CONV_LINES, """
SELECT a.path || '#' || a.line_start AS anchor_id, c.line_start FROM conv a JOIN conv c ON c.path = a.path
WHERE a.role = 'user' AND c.line_end >= a.line_start - 2 AND c.line_start <= a.line_end + 2"""))
def context_in_lines(spark, sf_dir):
    lines = A.conv_lines(spark, sf_dir).withColumn("instance", K.instance_key("source"))
    anchors = lines.where("role = 'user'").select(
        F.concat_ws("#", "path", F.col("line_start").cast("string")).alias("anchor_id"), "instance",
        F.col("line_start").alias("anchor_start"), F.col("line_end").alias("anchor_end"),
    )
    return K.nearby_lines(lines, anchors, 2, width=4).select("anchor_id", "line_start")


@query("fetched_context", O.with_ctes(O.EVENTS, """
anchor AS (SELECT min_by(source_id, arrival) AS source_id, min(arrival) AS arrival FROM ev WHERE event_type = 'error')""", """
SELECT CASE WHEN e.arrival = a.arrival OR e.source_id <> a.source_id THEN e.id ELSE 'f' || e.id END AS id
FROM ev e, anchor a"""))
def fetched_context(spark, sf_dir):
    """The first error's instance is fetched again under new ids."""
    ev = A.events_log(spark, sf_dir).select("arrival", "event_type", "source", "id", "ts_raw", "text", "line_start")
    ev = ev.withColumn("instance", K.instance_key("source"))
    anchor = ev.where("event_type = 'error'").orderBy("arrival").limit(1)
    fetched = ev.join(anchor.select("instance"), "instance", "left_semi").withColumn("id", F.concat(F.lit("f"), "id"))
    return K.with_fetched(ev, fetched, anchor).select("id")


@query("collected_view", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
SELECT id, CASE WHEN arrival % 3 = 0 THEN importance ELSE 'pending' END AS importance FROM judged"""))
def collected_view(spark, sf_dir):
    ev = A.judged_events(spark, sf_dir).select("arrival", "id", "judgment")
    pending = C.judgment("pending", "unknown", "unknown")
    tail = ev.withColumn("judgment", pending)
    return K.collected_view(ev.where("arrival % 3 = 0"), tail).select("id", "judgment.importance")
