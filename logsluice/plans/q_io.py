"""Queries: files that keep arriving, rule files, sinks and exports read back."""

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import rulesets as RS, sinks as K
from ..streaming import framing as SF, live as L
from . import adapters as A, oracle as O
from .catalog import query
from .q_incidents import ALL as INCIDENTS, _BOX, box


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("tailed_lines", O.with_ctes(O.EVENTS, "SELECT source.pod AS pod, line_start AS line_no, text AS raw FROM ev"))
def tailed_lines(spark, sf_dir):
    """Line files taken up one per trigger."""
    folder = _folder(spark, "tail")
    ev = A.events_log(spark, sf_dir, with_ids=False).select("source", F.col("line_start").alias("line_no"), F.col("text").alias("raw"))
    ev.repartition(3, "line_no").write.json(folder)
    return L.drain(SF.tail_stream(spark, folder, files_per_trigger=1)).select("source.pod", "line_no", "raw")


@query("human_rule_file", """
SELECT row_number() OVER (ORDER BY n) - 1 AS pos, 'rule-ns' || n AS id, 'click' AS pattern, '"ns' || n || '"' AS namespace
FROM (SELECT DISTINCT user_id % 3 AS n FROM events)""")
def human_rule_file(spark, sf_dir):
    """A review file with one rule per namespace, written and read back with its checks."""
    ns = A.load(spark, sf_dir, "events", [(F.col("user_id") % 3).alias("n")]).distinct()
    name = F.concat(F.lit("ns"), F.col("n").cast("string"))
    rule = F.struct(
        F.concat(F.lit("rule-"), name).alias("id"), F.lit("click").alias("pattern"), F.lit("contains").alias("match"),
        F.struct(F.lit("kubernetes").alias("type"), name.alias("namespace")).alias("scope"), F.lit(True).alias("enabled"),
    )
    doc = ns.agg(F.to_json(F.struct(
        F.lit(1).alias("version"), F.sort_array(F.collect_list(rule)).alias("rules"),
        F.create_map(F.lit("report"), F.array(F.lit("event"))).alias("acknowledged"),
    )).alias("value"))
    folder = _folder(spark, "rules")
    doc.write.text(folder)
    rules, _ = RS.read_human_rules(spark, folder)
    return rules.select(F.col("pos").cast("bigint").alias("pos"), "id", "pattern", F.col("scope")["namespace"].alias("namespace"))


@query("run_counters", O.with_ctes(O.EVENTS, """
SELECT count(*) AS received, count(*) FILTER (truncated) AS truncated_events, count(*) FILTER (parse_uncertain) AS parse_uncertain FROM ev"""))
def run_counters(spark, sf_dir):
    """Counters taken while another job consumes the events."""
    df, seen = K.observed(A.events_log(spark, sf_dir, with_ids=False))
    df.write.format("noop").mode("overwrite").save()
    c = seen.get
    names = ("received", "truncated_events", "parse_uncertain")
    return spark.createDataFrame([tuple(c[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


@query("prompt_export", O.with_ctes(O.EVENTS, """
SELECT text AS log, 1::BIGINT AS instance_count, id FROM ev WHERE event_type = 'error' ORDER BY arrival LIMIT 20"""))
def prompt_export(spark, sf_dir):
    """The first twenty errors as a user's selection; the evidence in the prompt is read back."""
    chosen = A.judged_events(spark, sf_dir).where("event_type = 'error'").orderBy("arrival").limit(20)
    evidence = F.regexp_extract("prompt", r"\nEVIDENCE\n([\s\S]*)\nEND\n", 1)
    kind = "array<struct<log:string,instance_count:bigint,instances:array<struct<id:string>>>>"
    return K.investigation_prompt(chosen).select(F.explode(F.from_json(evidence, kind)).alias("m")).select(
        "m.log", "m.instance_count", F.col("m.instances")[0]["id"].alias("id")
    )


@query("published_payloads", O.with_ctes(*INCIDENTS, _BOX, "SELECT notification_id, event_id FROM box"))
def published_payloads(spark, sf_dir):
    """Notifications as lines of JSON, read back."""
    folder = _folder(spark, "ndjson")
    K.write_ndjson(box(spark, sf_dir), folder)
    return spark.read.text(folder).select(
        F.get_json_object("value", "$.notification_id").alias("notification_id"), F.get_json_object("value", "$.event_id").alias("event_id")
    )
