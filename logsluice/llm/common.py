"""What the operators of this package share: words, shared tables, labelled samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: A word is a run of characters outside space and U+0009 to U+000D; ``bytes.split`` cuts the same.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that every executor and the driver can reach."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The files outlive any executor, and their exact size lets Spark decide for itself whether a
    later join may broadcast them.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_shared(df: DataFrame) -> None:
    """Delete a table of ``write_shared`` that nothing will read again."""
    path = getattr(df, "shared_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, rows: int,
    max_bytes: int,
) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts outside the held-out fold, for fitting a model on the driver.

    Rows are taken in the order of a hash of their id, so the sample does not depend on how the
    table is laid out. Ids with a missing, odd or contradictory label, and texts that are null or
    longer than ``max_bytes``, are not learnt from; of rows that share an id the greatest text is. Only the ids of the sample travel to the
    scan of the texts, so their number (``rows``) bounds the broadcast.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(fold_of(F.col("doc_id"), parts) != held_out)
        .groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_z"))
        .where("_y = _z").drop("_z")
        .withColumn("_o", F.xxhash64("doc_id")).orderBy("_o", "doc_id").limit(rows)
    )
    texts = (
        documents.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(ids), "doc_id")
    )
    picked = texts.groupBy("_o", "doc_id", F.col("_y").cast("int").alias("y")).agg(F.max("text").alias("text")).collect()
    return [(r.text, r.y) for r in sorted(picked, key=lambda r: (r._o, r.doc_id))]
