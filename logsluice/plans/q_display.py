"""Queries: report views."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import display as Y
from . import adapters as A, oracle as O
from .catalog import query
from .q_search import coarse_events

_J = O.JUDGED.replace("FROM base", "FROM (SELECT * REPLACE (regexp_replace(text, ' request_id=[0-9a-f]+', '') AS text) FROM base)")
_VIEW = """
view AS (SELECT *, substr(sha256(CAST(to_json({'source': source, 'text': text}) AS VARCHAR)), 1, 20) AS display_key,
  CASE WHEN importance <> 'unknown' THEN i_conf END AS v FROM judged),
banded AS (SELECT *, CASE WHEN v >= 0.9 THEN 'high' WHEN v >= 0.7 THEN 'medium' WHEN v IS NOT NULL THEN 'low' END AS b FROM view),
shown AS (
  SELECT display_key, importance, severity, category, count(*) AS instances, min(arrival) AS first, min_by(id, arrival) AS id,
    any_value(text) AS text, min(v) AS min_confidence, max(v) AS max_confidence, count(v) < count(*) AS has_unscored,
    CASE WHEN count(v) = 0 THEN 'unscored' WHEN count(DISTINCT b) = 1 AND count(v) = count(*) THEN min(b) ELSE 'mixed' END AS band
  FROM banded GROUP BY display_key, importance, severity, category)"""
ALL = (O.EVENTS, O.BASE, _J, _VIEW)


def shown_events(spark, sf_dir):
    ev = coarse_events(spark, sf_dir).withColumn("judgment", A.synthetic_judgment())
    return ev.withColumn("group_id", X.group_id("source", "text"))


@query("display_groups", O.with_ctes(*ALL, """
SELECT display_key, importance, severity, category, instances, first, id, min_confidence, max_confidence, band, has_unscored FROM shown"""))
def display_groups(spark, sf_dir):
    return Y.display_groups(shown_events(spark, sf_dir)).drop("review_status", "text")


for _mode, _order in (
    ("high", "max_confidence DESC NULLS LAST, instances DESC, first"),
    ("low", "min_confidence ASC NULLS LAST, instances DESC, first"),
    ("frequency", "instances DESC, first"),
    ("collection", "first"),
):
    def _page(spark, sf_dir, mode=_mode):
        return Y.group_page(Y.display_groups(shown_events(spark, sf_dir)), mode, page=1).select("display_key", "first", "instances")

    query(f"group_page_{_mode}", O.with_ctes(*ALL, f"""
SELECT display_key, first, instances FROM shown ORDER BY {_order} LIMIT 40 OFFSET 40"""))(_page)


@query("filtered_events", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
SELECT id FROM judged WHERE importance IN ('uncertain', 'unknown') AND source.namespace = 'ns0'
  AND contains(lower(text || ' ' || source.namespace || '/' || source.pod || '/app ' || category || ' ' || severity), 'signup')"""))
def filtered_events(spark, sf_dir):
    ev = A.judged_events(spark, sf_dir)
    return Y.filter_events(ev, importance="review", scope={"namespace": "ns0"}, search=" SIGNUP ").select("id")


@query("confidence_filter", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
SELECT id FROM judged WHERE importance = 'important' AND i_conf >= 0.7 AND i_conf < 0.9"""))
def confidence_filter(spark, sf_dir):
    return Y.filter_events(A.judged_events(spark, sf_dir), importance="important", band="medium").select("id")


@query("important_tail", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
SELECT id, arrival FROM judged WHERE importance = 'important' AND contains(lower(text), 'status=503') ORDER BY arrival DESC LIMIT 300"""))
def important_tail(spark, sf_dir):
    return Y.filter_tail(A.judged_events(spark, sf_dir), True, "Status=503").select("id", "arrival")


@query("report_text_search", O.with_ctes(O.EVENTS, "SELECT id FROM ev WHERE contains(lower(text), 'purchase')"))
def report_text_search(spark, sf_dir):
    return Y.search_text(A.events_log(spark, sf_dir), "PURCHASE").select("id")


@query("review_tab", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
SELECT importance, count(*) AS events FROM judged WHERE importance IN ('unknown', 'uncertain', 'pending') GROUP BY 1"""))
def review_tab(spark, sf_dir):
    return Y.tab(A.judged_events(spark, sf_dir), "review").groupBy(
        F.col("judgment.importance").alias("importance")
    ).agg(F.count(F.lit(1)).alias("events"))


@query("pod_facet", O.with_ctes(O.EVENTS, "SELECT DISTINCT source.pod AS pod FROM ev WHERE source.namespace = 'ns2'"))
def pod_facet(spark, sf_dir):
    return Y.facets(A.events_log(spark, sf_dir, with_ids=False), "pod", {"namespace": "ns2"})


@query("group_instances", O.with_ctes(*ALL, """
SELECT id, arrival FROM view WHERE display_key = (SELECT display_key FROM shown ORDER BY instances DESC, first LIMIT 1) ORDER BY arrival LIMIT 40"""))
def group_instances(spark, sf_dir):
    ev = shown_events(spark, sf_dir)
    key = Y.group_page(Y.display_groups(ev), "frequency", size=1).first()["display_key"]
    return Y.instances(ev, key).select("id", "arrival")


@query("suggested_patterns", O.with_ctes(*ALL, """
SELECT display_key, importance, substr(regexp_replace(text, '^(INFO|WARN|ERROR) ', ''), 1, 500) AS pattern FROM shown"""))
def suggested_patterns(spark, sf_dir):
    return Y.suggest_patterns(Y.display_groups(shown_events(spark, sf_dir))).select("display_key", "importance", "pattern")
