"""Saved reports: reading both schema versions and checking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema as S

MAX_EVENTS = 100000


_BROKEN = "_broken"


def _documents(spark: SparkSession, path: str | list[str], lenient: bool) -> DataFrame:
    """Report documents; a broken one has its text in ``_broken`` where it does not fail the read."""
    schema = T.StructType([*S.REPORT.fields, T.StructField(_BROKEN, T.StringType())]) if lenient else S.REPORT
    reader = spark.read.schema(schema)
    if lenient:
        reader = reader.option("columnNameOfCorruptRecord", _BROKEN)
    return reader.option("multiLine", "true").option("mode", "PERMISSIVE" if lenient else "FAILFAST").json(path)


def report_problems(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, status) of the documents that ``read_report`` leaves out with ``skip_bad``."""
    docs = _documents(spark, path, lenient=True).select("*", F.col("_metadata.file_path").alias("path"))
    return docs.where(F.col(_BROKEN).isNotNull() | ~_valid()).select("path", F.lit("report_invalid").alias("status"))


def read_report(spark: SparkSession, path: str | list[str], mode_aliases: dict | None = None,
                with_path: bool = False, skip_bad: bool = False) -> DataFrame:
    """One row per report document with defaults filled in.

    Broken documents fail the read, or are left to ``report_problems`` with ``skip_bad``. ``mode_aliases`` renames
    legacy mode names. ``complete`` is never true for schema 1.
    """
    docs = _documents(spark, path, lenient=skip_bad)
    if with_path:
        docs = docs.withColumn("path", F.col("_metadata.file_path"))
    if skip_bad:
        docs = docs.where(F.col(_BROKEN).isNull()).drop(_BROKEN)
    mode = F.col("mode")
    for old, new in (mode_aliases or {}).items():
        mode = F.when(F.col("mode") == old, new).otherwise(mode)
    s = F.col("summary")
    filled = F.struct(*[
        (F.coalesce(s[f.name], F.lit(0)) if f.name in S.SUMMARY_COUNTERS else s[f.name]).alias(f.name)
        for f in S.REPORT["summary"].dataType.fields
    ])
    u = F.col("usage")
    in_flight = F.greatest(F.coalesce(u["request_attempts"] - u["requests_finished"], F.lit(0)), F.lit(0))
    out = docs.withColumn("valid", _valid()).withColumn("mode", mode)
    out = out.withColumn("summary", F.when(s.isNotNull(), filled))
    for c in ("coverage", "important_groups", "tail_events"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(S.REPORT[c].dataType)))
    out = out.withColumn("in_flight", in_flight).withColumn(
        "complete", (F.col("schema_version") == 2) & F.coalesce(F.col("summary.complete_within_window"), F.lit(False))
    )
    if skip_bad:
        return out.where("valid").drop("valid")
    return out.withColumn(
        "schema_version", F.when(F.col("valid"), F.col("schema_version")).otherwise(F.raise_error("invalid report"))
    ).drop("valid")


def _valid():
    def sound(events):
        return F.forall(events, lambda e: (
            (F.coalesce(e["id"], F.lit("")) != "") & e["text"].isNotNull() & e["source"].isNotNull()
        ))

    return F.coalesce(
        F.col("schema_version").isin(1, 2) & F.col("summary").isNotNull() & F.col("events").isNotNull()
        & (F.size("events") <= MAX_EVENTS) & sound(F.col("events"))
        & F.coalesce(sound(F.col("tail_events")), F.lit(True)), F.lit(False),
    )


def report_events(docs: DataFrame, collection: str = "events") -> DataFrame:
    """Events of the reports as rows, numbered in report order."""
    d = docs.select(F.posexplode(collection).alias("arrival", "e"))
    j = F.struct(*[F.col(f"e.{f.name}").alias(f.name) for f in S.JUDGMENT.fields])
    rest = [f.name for f in S.REPORT_EVENT.fields if f.name not in [x.name for x in S.JUDGMENT.fields]]
    flags = ("truncated", "sensitive", "parse_uncertain", "analysis_reused")
    return d.select(
        F.col("arrival").cast("bigint").alias("arrival"),
        *[(F.coalesce(F.col(f"e.{n}"), F.lit(False)) if n in flags else F.col(f"e.{n}")).alias(
            "ts_raw" if n == "timestamp" else n) for n in rest],
        j.alias("judgment"),
    )
