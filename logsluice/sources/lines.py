"""Log sources: files, text tables, scoping, byte limits, admission and replay removal."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import schema as S
from ..functions import text as X
from ..operators.scale import BLOCK, LINES_PER_BLOCK, join_keys, running_rank, running_total, split_wide, with_block
from ..session import written
from . import packed as P


def file_source(path: Column) -> Column:
    return F.struct(*[
        (F.lit("file") if f.name == "type" else path if f.name == "path" else F.lit(None))
        .cast(f.dataType).alias(f.name)
        for f in S.SOURCE.fields
    ])


def split_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Any text column as a log source; only a line feed ends a line.

    A trailing line feed ends the last line and does not open another one.
    """
    text = F.col(text_col)
    body = F.when(text.endswith("\n"), F.substring(text, 1, F.length(text) - 1)).otherwise(text)
    rest = [c for c in df.columns if c != text_col]
    return (
        df.where(text.isNotNull() & (text != ""))
        .select(*rest, F.posexplode(F.split(body, "\n")).alias("_pos", "raw"))
        .select(*rest, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "raw")
    )


def _listed(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """(plain files, gzip files, (path, status) of what is no file) behind paths, folders and globs, each file once.

    A folder stands for its visible files; folders inside it are gaps.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    plain, packed, gaps = {}, {}, []

    def add(status) -> None:
        name = status.getPath().toString()
        if not name.lower().endswith(".gz"):
            plain[_literal(name)] = None
        elif status.getLen():
            packed[_literal(name)] = None
        else:
            gaps.append((name, P.GZIP_INVALID))

    for path in paths:
        try:
            p = fs_path(path)
            fs = p.getFileSystem(conf)
            found = fs.globStatus(p) or []
            inside = [list(fs.listStatus(s.getPath())) if s.isDirectory() else [] for s in found]
        except Exception:  # an unreachable file system is a gap like a missing file
            gaps.append((path, "file_unavailable"))
            continue
        if not found:
            gaps.append((path, "file_unavailable"))
        for status, children in zip(found, inside):
            if status.isFile():
                add(status)
                continue
            shown = [c for c in children if not c.getPath().getName().startswith(("_", "."))]
            for c in shown:
                if c.isFile():
                    add(c)
            gaps += [(c.getPath().toString(), "file_type_unsupported") for c in shown if not c.isFile()]
            if not shown:
                gaps.append((status.getPath().toString(), "file_type_unsupported"))
    return list(plain), list(packed), gaps


def _literal(path: str) -> str:
    """A listed path, as a pattern that means this path alone."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def read_log_lines(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(lines, gaps) of plain and gzip log files; paths may be files, folders and globs, and names decide what is packed.

    A missing path, a file that is no gzip and one that ends or breaks off early become gap rows; all
    that could be read is kept, and an unfinished last line of a file that breaks off is ``partial``. An error of the file system
    fails the read.

    Gzip files are read once, a task per file (``packed``); their lines are written to the shared folder, where later steps
    can split them. Plain files stay where they are. Their rows are numbered by ``monotonically_increasing_id`` relative to the first
    row of their split, plus the lines of the splits before: a row per split, written first so that Spark knows
    its size and sends it to the texts.
    """
    plain, packed, missing = _listed(spark, paths)
    gaps = _gaps(spark.createDataFrame(missing, "path string, status string"))
    lines = spark.createDataFrame([], S.LINE).withColumn("partial", F.lit(False))
    if packed:
        records = written(P.packed_records(spark, packed), "unpacked")
        lines = records.where("status IS NULL").select(
            file_source(X.console_safe("path")).alias("source"), "line_no", "raw", "partial"
        )
        gaps = gaps.unionByName(_gaps(records.where("status IS NOT NULL").select("path", "status")))
    if plain:
        some = _plain_lines(spark, plain)
        lines = lines.unionByName(some) if packed else some
    return lines, gaps


def _plain_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("mid"),
    ).withColumn("split", F.xxhash64("path", "start"))
    blocks = raw.groupBy("split", "path", "start").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(blocks.select(
        "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift")
    ), "line-offsets")
    return raw.join(offsets, "split").select(
        file_source(X.console_safe("path")).alias("source"), (F.col("mid") + F.col("shift")).alias("line_no"), "raw", F.lit(False).alias("partial"),
    )


def _gaps(rows: DataFrame) -> DataFrame:
    return rows.select(
        file_source(X.console_safe("path")).alias("source"), "status", F.array(F.lit("collection incomplete")).alias("warnings")
    )


def limit_bytes(lines: DataFrame, max_bytes: int, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Keep the first ``max_bytes`` of each source; every line counts with its line feed.

    The line that crosses the limit is cut, later ones are dropped, and the last line kept of a
    source that had more to give is flagged ``partial``.
    """
    size = (F.octet_length("raw") + 1).cast("bigint")
    d = running_total(
        with_block(lines, "line_no", LINES_PER_BLOCK), keys, ["line_no"], size, "_end"
    ).withColumn("_begin", F.col("_end") - size)
    totals = lines.groupBy(*keys).agg(F.sum(size).alias("_all"))
    room = F.lit(max_bytes) - F.col("_begin")
    cut = X.repair_utf8(
        F.expr(f"cast(substring(cast(raw as binary), 1, cast({max_bytes} - _begin as int)) as string)")
    )
    return (
        d.where(F.col("_begin") < max_bytes)
        .join(totals, list(keys))
        .withColumn("partial", (F.col("_end") >= max_bytes) & (F.col("_all") > max_bytes))
        .withColumn("raw", F.when(F.octet_length("raw") > room, cut).otherwise(F.col("raw")))
        .drop("_begin", "_end", "_all", BLOCK)
    )


def scope_lines(
    df: DataFrame,
    *,
    namespace: str | None = None,
    pod: str | None = None,
    since_us: int | None = None,
    exclude_previous: bool = False,
    selector: dict | None = None,
) -> DataFrame:
    """Row filters on source fields and time; all of them reach the scan."""
    if namespace:
        df = df.where(F.col("source.namespace") == namespace)
    if pod:
        df = df.where(F.col("source.pod") == pod)
    if since_us is not None:
        df = df.where(F.col("ts_us") >= since_us)
    if exclude_previous:
        df = df.where(~F.coalesce(F.col("source.previous"), F.lit(False)))
    for key, value in (selector or {}).items():
        df = df.where(F.col("labels")[key] == value)
    return df


def tail_lines(df: DataFrame, n: int, order: str = "line_start") -> DataFrame:
    """The last ``n`` lines of each source; Spark limits each partition before the shuffle."""
    w = Window.partitionBy("source_id").orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def admit(df: DataFrame, max_events: int, order: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """(admitted, gaps): the first ``max_events`` events, and an ``event_limit`` gap when more came."""
    admitted = df.orderBy(order).limit(max_events)
    # The cap counts as hit as soon as it is reached: later input was never looked at.
    gaps = (
        df.limit(max_events).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_events)
        .select(F.lit("event_limit").alias("status"), F.col("n").alias("admitted"))
    )
    return admitted, gaps


def dedupe_overlapping_fetches(df: DataFrame) -> DataFrame:
    """Drop lines that an earlier fetch of the same stream already delivered.

    Needs ``fetch, source_id, ts_us, raw, line_no`` [, ``partial``]. A line without a time, or cut short, can't
    be told from a repeat and is always kept; ``unproven_gaps`` reports it. Equal lines at the same instant form a
    multiset: a fetch adds only the occurrences beyond the largest count seen before it. Equal
    lines inside one fetch are all kept.

    In the order of fetches a line is new if its place among the equal lines of its fetch lies beyond all places before it; lines
    move once for that. Groups are first counted by a hash of 64 bits, and those too large for a window are ranked block by
    block, so a huge group of equal lines stays distributed.
    """
    proven = _proven(df)
    group = ["source_id", "ts_us", "raw"]
    small, large = split_wide(df.where(proven).withColumn("_hash", F.xxhash64(*group)), ["_hash"])
    inside = Window.partitionBy(*group, "fetch").orderBy("line_no")
    before = Window.partitionBy(*group).orderBy("fetch", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (
        small.drop("_hash").withColumn("_occ", F.row_number().over(inside))
        .withColumn("_seen", F.coalesce(F.max("_occ").over(before), F.lit(0)))
        .where(F.col("_occ") > F.col("_seen")).drop("_occ", "_seen")
    )
    if large is not None:
        fresh = fresh.unionByName(_fresh_by_block(large.drop("_hash")))
    return fresh.unionByName(df.where(~proven))


def _fresh_by_block(lines: DataFrame) -> DataFrame:
    """The new lines of groups of any size."""
    rows = lines.withColumn("_digest", F.sha2(F.col("raw").cast("binary"), 256))
    group = ["source_id", "ts_us", "_digest"]
    per_fetch = rows.groupBy(*group, "fetch").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*group).orderBy("fetch").rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = per_fetch.withColumn("_seen", F.coalesce(F.max("_n").over(earlier), F.lit(0))).drop("_n")
    ranked = running_rank(
        with_block(rows, "line_no", LINES_PER_BLOCK), [*group, "fetch"], ["line_no"], "_occ"
    )
    return (
        join_keys(ranked, seen, [*group, "fetch"]).where(F.col("_occ") > F.col("_seen"))
        .drop("_digest", "_occ", "_seen", BLOCK)
    )


def _proven(df: DataFrame) -> Column:
    whole = ~F.coalesce(F.col("partial"), F.lit(False)) if "partial" in df.columns else F.lit(True)
    return F.col("ts_us").isNotNull() & whole


def unproven_gaps(df: DataFrame) -> DataFrame:
    """A gap row per line that ``dedupe_overlapping_fetches`` could not compare."""
    status = F.when(F.col("ts_us").isNull(), "cursor_untimestamped").otherwise("cursor_truncated")
    return df.where(~_proven(df)).select(
        "source_id", "line_no", status.alias("status"), F.array(F.lit("collection incomplete")).alias("warnings")
    )


def out_of_order_gaps(df: DataFrame, order: str = "arrival") -> DataFrame:
    """Lines whose time lies before the newest time already seen on their source.

    They are kept by every operator here; this only reports them as coverage gaps.
    """
    from ..operators.scale import ROWS_PER_BLOCK, preceding_max

    d = with_block(df, order, ROWS_PER_BLOCK)
    d = preceding_max(d, ["source_id"], [order], F.col("ts_us"), "_newest")
    return d.where(F.col("ts_us") < F.col("_newest")).select(
        "source", F.lit("cursor_out_of_order").alias("status"),
        F.array(F.lit("collection incomplete")).alias("warnings"),
    )


def report_history(spark: SparkSession, folder: str, newest: int = 100, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(the newest saved reports with their projected summaries, gaps of those that can't be read).

    Only the files that are shown are parsed. ``pattern`` is what names of report files match.
    """
    from .reports import read_report, report_problems

    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
        .where(~F.element_at(F.split("path", "/"), -1).startswith("."))
        .orderBy(F.desc("modificationTime"), "path").limit(newest).collect()
    )
    listed = spark.createDataFrame([(r.path, r.modificationTime) for r in files], "path string, modificationTime timestamp")
    if not files:
        empty = listed.select(F.col("path").alias("id"), "modificationTime", F.lit("").alias("created_at"), F.lit("").alias("mode"), F.struct("path").alias("summary"))
        return empty, _gaps(listed.select("path", F.lit("").alias("status")))
    paths = [r.path for r in files]
    docs = read_report(spark, paths, with_path=True, skip_bad=True)
    shown = docs.join(listed, "path").select(
        F.element_at(F.split("path", "/"), -1).alias("id"), "modificationTime", "created_at", "mode", "summary",
    )
    return shown, _gaps(report_problems(spark, paths))
