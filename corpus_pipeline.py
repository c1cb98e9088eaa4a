"""From raw documents to packed training sequences, a stage at a time.

Each stage takes the documents that the one before it kept; its result is written as Parquet and
read again, so a lost executor costs at most the stage that runs. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logsluice.llm import mixing, near_copies, packing, substrings, toxicity
from logsluice.llm.common import drop_shared, labelled_sample, read_table, write_shared

#: Documents that score this much or more are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents by a model learnt from the labelled ones outside the held-out fold."""
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    sample = labelled_sample(docs, labels, "toxic", 5, 0, toxicity.TRAIN_ROWS, toxicity.TRAIN_BYTES)
    scored = toxicity.score_documents(docs, toxicity.fit(sample), keep=tuple(docs.columns))
    return scored.where(F.col("score") < TOXIC).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id; four fifths of the five-word shingles shared link two."""
    return near_copies.keep_one(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; documents that had words and lose them all go as well."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substrings.remove_repeats(docs, with_text=True, keep=(*others, "n_chars"))
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _with_text(left, F.col("kept_text"), F.col("n_removed") > 0, docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in the order of the schedule: documents are left out or repeated, a source's last one cut.

    What a document gives is what the scheduled blocks of its source hold of it; it comes where the first of them does.
    """
    mixed, slots = mixing.scheduled(mixing.with_size(docs).drop("source_size"))
    each = mixing.mixed_texts(mixed.withColumnRenamed("text", "_before").withColumn("text", F.col("_before")))
    changed = _with_text(each, F.col("text"), F.col("text") != F.col("_before"), [*docs.columns, "slot"])
    return mixing.in_slot_order(changed, slots).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; one row per piece of a document."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _with_text(df: DataFrame, text, changed, columns: list[str]) -> DataFrame:
    """``columns`` with a new text, and its length where it changed."""
    n_chars = F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    named = {"text": text, "n_chars": n_chars}
    return df.select([named.get(c, F.col(c)).alias(c) for c in columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("passages", remove_passages),
    ("mixing", mix_sources), ("packing", pack),
]

#: A learnt score and a tokenizer decide about the rows, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_shared(before)
    return docs
