"""Turn the benchmark tables into log sources.

Each adapter is an ordinary projection (no window over a source): line numbers come from the
row's own identity, so one hot source costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions import classify as C, text as X
from ..operators.scale import task_count
from ..session import written
from ..sources.lines import split_lines

#: Rows of orders and items that one task joins and makes lines of.
ROWS_PER_TASK = 1 << 18


def load(spark: SparkSession, sf_dir: str, table: str, columns=None) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """The same rows on all cores, where the files alone give fewer tasks: few bytes may mean much work.

    Large tables, which have tasks enough, stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """The same rows dealt evenly over all cores: few bytes may mean much work.

    Splits of a file are cut by bytes, and those that begin no row group are empty, so about as many splits as cores is no
    sign that all cores have rows. The rows are written, since Spark moves later filters below a mere repartition, back to the few
    tasks that read the files. Tables with far more splits than cores stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * cores else written(df.repartition(cores), "dealt")


def load_stream(spark: SparkSession, sf_dir: str, table: str, columns=None) -> DataFrame:
    """The same table as an unbounded source, a few files at a time."""
    schema = load(spark, sf_dir, table).schema
    df = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
        .parquet(f"{sf_dir}/{table}*.parquet")
    )
    return df.select(*columns) if columns else df


def source_struct(**values) -> Column:
    """A full source record; unnamed fields are NULL."""
    fields = []
    for f in S.SOURCE.fields:
        v = values.get(f.name)
        v = v if isinstance(v, Column) else F.lit(v)
        fields.append(v.cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def events_log(spark: SparkSession, sf_dir: str, with_ids: bool = True, stream: bool = False) -> DataFrame:
    """One log event per row of ``events``, dealt over all cores: an event is a few bytes in the table and much work after it."""
    ev = (load_stream if stream else load)(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    ev = ev if stream else dealt(ev)
    k = F.get_json_object("props", "$.k").cast("bigint")
    level = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    )
    status = F.when((F.col("event_type") == "error") & (k % 3 == 0), "503").otherwise("200")
    text = F.concat(
        level, F.lit(" "), F.col("event_type"),
        F.lit(" request_id="), F.md5(F.col("event_id").cast("string").cast("binary")),
        F.lit(" user_id="), F.col("user_id").cast("string"),
        F.lit(" status="), status, F.lit(" n="), k.cast("string"),
    )
    source = source_struct(
        type="kubernetes", context="demo",
        namespace=F.concat(F.lit("ns"), (F.col("user_id") % 3).cast("string")),
        pod=F.concat(F.lit("pod"), F.col("user_id").cast("string")),
        container="app", kind="container", previous=False, restart_count=0,
    )
    ts = F.col("ts").cast("timestamp")
    out = ev.select(
        F.col("event_id").alias("arrival"), "event_type", "user_id", k.alias("k"),
        source.alias("source"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_raw"),
        F.unix_micros(ts).alias("ts_us"), F.unix_seconds(ts).alias("ts_s"),
        text.alias("text"),
        (F.col("event_id") + 1).alias("line_start"), (F.col("event_id") + 1).alias("line_end"),
        F.lit(1).cast("bigint").alias("line_count"),
        (k == 50).alias("truncated"), (k == 60).alias("sensitive"),
        (k == 70).alias("parse_uncertain"),
    )
    if with_ids:
        out = (
            out.withColumn("source_id", X.source_id("source"))
            .withColumn("id", X.event_id("source", "ts_raw", "line_start", "text"))
            .withColumn("group_id", X.group_id("source", "text"))
        )
    return out


def synthetic_judgment() -> Column:
    """A deterministic judge over (event_type, k); confidences are tenths."""
    k, kind = F.col("k"), F.col("event_type")
    failed = k == 99
    is_error = kind == "error"
    importance = (
        F.when(failed, "unknown")
        .when(is_error & (k % 5 == 0), "uncertain").when(is_error, "important")
        .when((kind == "signup") & (k % 7 == 0), "uncertain").otherwise("routine")
    )
    severity = (
        F.when(failed, "unknown").when(is_error & (k % 3 == 0), "outage")
        .when(is_error, "degraded").when(kind == "purchase", "info").otherwise("noise")
    )
    category = (
        F.when(failed, "unknown")
        .when(is_error & (k % 4 == 0), "dependency").when(is_error & (k % 4 == 1), "security")
        .when(is_error & (k % 4 == 2), "capacity").when(is_error, "unknown")
        .when((kind == "signup") & (k % 11 == 0), "fraud").otherwise("routine")
    )
    scored = ~failed
    return C.judgment(
        importance, severity, category,
        F.when(scored & (k != 13), (k % 6 + 5) / F.lit(10.0)),
        F.when(scored, (k % 5 + 6) / F.lit(10.0)),
        F.when(scored, (k % 4 + 7) / F.lit(10.0)),
        F.when(failed, "provider analysis unavailable"),
    )


def judged_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """``events_log`` with its keyword baseline and the synthetic verdict."""
    return (
        events_log(spark, sf_dir, stream=stream)
        .withColumn("baseline", C.baseline("text"))
        .withColumn("judgment", synthetic_judgment())
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical lines of every document; the source is a file named after it."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    path = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    return split_lines(
        docs.select(source_struct(type="file", path=path).alias("source"), "text"), "text"
    )


def conv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as single-line events; a turn is a line of its conversation."""
    conv = load(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    return conv.select(
        source_struct(type="file", path=path).alias("source"),
        path.alias("path"), (F.col("turn") + 1).alias("line_start"),
        (F.col("turn") + 1).alias("line_end"), "role", "text",
    )


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack traces with a known answer: an order is a header, its item lines are frames.

    Three dialects by ``o_orderkey % 3``. Sixteen files, so each is a hot source. Rows are dealt by order to tasks of about
    ``ROWS_PER_TASK``: two numbers pack to some bytes in a shuffle and are a whole line after it.
    """
    orders = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    items = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("bigint").alias("n")
    )
    tasks = task_count(orders, orders.count() + items.count(), ROWS_PER_TASK)
    orders = orders.repartition(tasks, "o_orderkey")
    items = items.repartition(tasks, "o_orderkey").distinct()
    rows = orders.withColumn("n", F.lit(0).cast("bigint")).unionByName(
        items.join(orders, "o_orderkey")
    )
    key, n = F.col("o_orderkey"), F.col("n")
    dialect = key % 3
    stamp = F.lit("2024-01-01 00:00:00 ")
    num = n.cast("string")
    odd = n % 2 == 1
    head = F.when(dialect == 0, F.concat(F.lit("ERROR order "), key.cast("string"), F.lit(" failed")))
    head = head.when(
        dialect == 1, F.concat(F.lit("panic: order "), key.cast("string"), F.lit(" failed"))
    ).otherwise(F.concat(stamp, F.lit("ERROR order "), key.cast("string"), F.lit(" failed")))
    frame = (
        F.when(dialect == 0, F.concat(F.lit("    at shop.Item.line(Item.java:"), num, F.lit(")")))
        .when((dialect == 1) & odd, F.concat(F.lit("main.(*Item).line(0x"), num, F.lit(")")))
        .when(dialect == 1, F.concat(F.lit("\t/app/item.go:"), num, F.lit(" +0x1f")))
        .when(odd, F.concat(stamp, F.lit('  File "shop.py", line '), num, F.lit(", in item")))
        .otherwise(F.concat(stamp, F.lit("    item("), num, F.lit(")")))
    )
    path = F.concat(F.lit("orders/"), (F.col("o_custkey") % 16).cast("string"))
    return rows.select(
        source_struct(type="file", path=path).alias("source"),
        (key * 8 + n + 1).alias("line_no"),
        F.when(n == 0, head).otherwise(frame).alias("raw"),
    )
