"""Queries that pass through files: log files read back, and a saved report document."""

import uuid

from pyspark.sql import functions as F

from ..operators import incidents as I
from ..session import shared_dir
from ..sources import lines as L, reports as RP, sinks as K
from . import adapters as A, oracle as O
from .catalog import query
from .q_incidents import ALL as INCIDENTS, _BOX, box
from .q_report import gap_rows


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("log_files", O.with_ctes(O.EVENTS, """
SELECT text, count(*) AS lines, 0::BIGINT AS gaps FROM ev GROUP BY text"""))
def log_files(spark, sf_dir):
    """Messages written as gzip log files and read back by their folder; a hole in a file's numbers counts as a gap."""
    folder = _folder(spark, "logs")
    text = A.events_log(spark, sf_dir, with_ids=False).select(F.col("text").alias("value"))
    text.write.option("compression", "gzip").text(folder)
    lines, gaps = L.read_log_lines(spark, [folder])
    holes = lines.groupBy("source.path").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last")).where("n <> last")
    lost = gaps.select("source.path").unionByName(holes.select("path")).agg(F.count(F.lit(1)).alias("gaps"))
    per_text = lines.groupBy(F.col("raw").alias("text")).agg(F.count(F.lit(1)).alias("lines"))
    return per_text.withColumn("_j", F.lit(1)).join(lost.withColumn("_j", F.lit(1)), "_j").drop("_j")


def _cut_short(spark, path, most=1 << 16):
    """Replace a file by its beginning, half of it or ``most`` bytes, as a writer that died would have left it."""
    named = spark._jvm.org.apache.hadoop.fs.Path
    fs = named(path).getFileSystem(spark._jsc.hadoopConfiguration())
    source = fs.open(named(path))
    start = source.readNBytes(min(most, fs.getFileStatus(named(path)).getLen() // 2))
    source.close()
    into = fs.create(named(path.replace("part-", "begun-")))
    into.write(start)
    into.close()
    fs.delete(named(path), False)


def _each_file(spark, folder, do):
    named = spark._jvm.org.apache.hadoop.fs.Path
    fs = named(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(named(folder)):
        if s.isFile() and s.getPath().getName().startswith("part-"):
            do(fs, s.getPath().toString())


@query("partly_read_files", O.with_ctes(O.EVENTS, """
SELECT arrival % 4 AS part, NULL AS status, text, count(*) AS lines FROM ev WHERE arrival % 4 <> 3 GROUP BY ALL
UNION ALL SELECT 3, 'input_incomplete', NULL, 0 WHERE EXISTS (FROM ev WHERE arrival % 4 = 3)"""))
def partly_read_files(spark, sf_dir):
    """Four folders of gzip files, the second named in capitals, all files of the last one cut short: the lines of the others are whole."""
    folder = _folder(spark, "broken")
    named = spark._jvm.org.apache.hadoop.fs.Path
    ev = A.events_log(spark, sf_dir, with_ids=False).select(F.col("text").alias("value"), F.col("arrival") % 4)
    for part, rows in ((k, ev.where(ev[1] == k)) for k in range(4)):
        rows.select("value").write.option("compression", "gzip").text(f"{folder}/{part}")
    _each_file(spark, f"{folder}/1", lambda fs, p: fs.rename(named(p), named(p.removesuffix(".gz") + ".GZ")))
    _each_file(spark, f"{folder}/3", lambda fs, p: _cut_short(spark, p))
    lines, gaps = L.read_log_lines(spark, [f"{folder}/0", f"{folder}/1/*", f"{folder}/[23]"])
    part_of = F.element_at(F.split("source.path", "/"), -2).cast("bigint")
    told = gaps.select(part_of.alias("part"), "status").distinct()
    whole = lines.select(part_of.alias("part"), F.col("raw").alias("text"), "partial").join(told, "part", "left").where("status IS NULL AND NOT partial")
    per_text = whole.groupBy("part", "status", "text").agg(F.count(F.lit(1)).alias("lines"))
    return per_text.unionByName(told.select("part", "status", F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("lines")))


@query("report_history", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
SELECT (SELECT count(*) FROM judged) AS events, 'shown' AS status UNION ALL SELECT NULL, 'report_invalid'"""))
def report_history(spark, sf_dir):
    """A saved report and a broken one: the first is shown, the second is a gap."""
    folder = _folder(spark, "history")
    K.write_document(K.report_document(A.judged_events(spark, sf_dir), gap_rows(spark, sf_dir), retain=50), f"{folder}/a.json")
    broken = A.load(spark, sf_dir, "events", ["event_id"]).orderBy("event_id").limit(1).select(F.lit('{"schema_version": 2').alias("value"))
    broken.coalesce(1).write.text(f"{folder}/b.json")
    shown, gaps = L.report_history(spark, f"{folder}/*.json", pattern="part-*")
    return shown.select("summary.events", F.lit("shown").alias("status")).unionByName(
        gaps.select(F.lit(None).cast("bigint").alias("events"), "status")
    )


@query("report_document", O.with_ctes(O.EVENTS, O.BASE, O.JUDGED, """
tail AS (SELECT * FROM judged ORDER BY arrival DESC LIMIT 500)""", """
SELECT (SELECT count(*) FROM judged) AS events, (SELECT count(*) FROM judged WHERE importance = 'important') AS important,
  count(*) AS retained, (SELECT count(*) FROM judged) - count(*) AS evicted, count(*) AS listed,
  count(DISTINCT group_id) FILTER (importance = 'important') AS groups,
  count(*) FILTER (importance = 'important') AS grouped_events, false AS complete FROM tail"""))
def report_document(spark, sf_dir):
    """The schema-2 document of the newest 500 events, written and read back."""
    folder = _folder(spark, "report")
    gaps = gap_rows(spark, sf_dir)
    K.write_document(K.report_document(A.judged_events(spark, sf_dir), gaps, retain=500), folder)
    return RP.read_report(spark, folder).select(
        "summary.events", "summary.important", F.col("summary.retained_events").alias("retained"),
        F.col("summary.evicted_events").alias("evicted"), F.size("events").cast("bigint").alias("listed"),
        F.size("important_groups").cast("bigint").alias("groups"),
        F.aggregate("important_groups", F.lit(0).cast("bigint"), lambda a, g: a + g["count"]).alias("grouped_events"),
        "complete",
    )


@query("payload_violations", O.with_ctes(*INCIDENTS, _BOX, """
SELECT notification_id, CASE due % 9 WHEN 0 THEN 'bad_status' WHEN 1 THEN 'bad_schema' WHEN 2 THEN 'id_mismatch' WHEN 3 THEN 'bad_event_id'
  WHEN 4 THEN 'bad_decision' WHEN 5 THEN 'bad_judgment' WHEN 6 THEN 'bad_count' ELSE 'bad_attempts' END AS reason
FROM box WHERE due % 9 < 8"""))
def payload_violations(spark, sf_dir):
    """Outbox rows broken in eight ways, by their second."""
    kind = F.col("due") % 9
    broken = (
        ("schema", 1, r'"schema":2', '"schema":3'), ("incident", 2, r'"incident_id":"[0-9a-f]', '"incident_id":"x'),
        ("event", 3, r'"event_id":"[0-9a-f]', '"event_id":"x'), ("decision", 4, r'"decision":"[a-z]+"', '"decision":"maybe"'),
        ("judgment", 5, r'"importance":"[a-z]+"', '"importance":"huge"'), ("count", 6, r'"recurrence_count":[0-9]+', '"recurrence_count":0'),
    )
    payload = F.col("payload")
    for _, at, pattern, to in broken:
        payload = F.when(kind == at, F.regexp_replace("payload", pattern, to)).otherwise(payload)
    rows = box(spark, sf_dir).withColumns({
        "payload": payload, "status": F.when(kind == 0, "lost").otherwise(F.col("status")),
        "attempts": F.when(kind == 7, F.lit(99)).otherwise(F.col("attempts")).cast("bigint"),
    })
    return I.payload_violations(rows)
