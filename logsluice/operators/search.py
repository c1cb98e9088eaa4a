"""Search over a frozen window: occurrence groups, literal and judged relevance, ordering."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import tables as T
from ..functions import classify as C, redact as R
from ..functions.redact import scrub_value
from ..session import written
from .scale import first_per_key

# Words that carry no meaning in a question, and two families of synonyms.
STOP_WORDS = (
    "a an the me find show get all logs log lines line events event requests request against "
    "from for to with ip address major issue issues any are there what which is in of and"
).split()
SYNONYMS = (
    "db database postgres postgresql mysql sql mongo mongodb redis".split(),
    ("error errors failure failed failing unavailable exhausted deadlock timeout timeouts "
     "issue issues").split(),
)
GROUPS_PER_CALL = 8
PAGE = 20


def clean_query(query: str) -> str:
    """Validate and redact a question: 1 to 500 characters, no control characters."""
    query = query.strip()
    if not 1 <= len(query) <= 500 or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in query):
        raise ValueError("invalid query")
    return scrub_value(query)


def query_terms(query: str) -> list[str]:
    terms = set(re.findall("[a-z0-9_]+", query.lower())) - set(STOP_WORDS)
    for family in SYNONYMS:
        if terms & set(family):
            terms |= set(family)
    return sorted(terms)


def term_overlap(text, query: str) -> Column:
    """Number of distinct query terms contained in the lower-cased text."""
    text = F.col(text) if isinstance(text, str) else text
    low = F.lower(text)
    terms = F.array(*[F.lit(t) for t in query_terms(query)]).cast("array<string>")
    return F.size(F.filter(terms, lambda t: low.contains(t))).cast("bigint")


def first_by_id(events: DataFrame, order: str = "arrival") -> DataFrame:
    """The first occurrence of each event id in arrival order."""
    return first_per_key(events, ["id"], F.col(order))


def scope_events(events: DataFrame, scope: dict | None = None, label: str | None = None) -> DataFrame:
    """Restrict by source fields (empty values are no restriction) and source label."""
    for key, value in (scope or {}).items():
        if key not in ("namespace", "pod", "container"):
            raise ValueError("invalid source filter")
        if value:
            events = events.where(F.col(f"source.{key}") == value)
    if label and label != "all":
        events = events.where(C.source_label("source") == label)
    return events


def occurrence_groups(events: DataFrame, order: str = "arrival", with_json: bool = False) -> DataFrame:
    """Equal evidence counted once: (source, redacted text, flags) after removing repeated ids.

    First and last seen are the smallest and largest timestamps as text.
    """
    d = R.with_redaction(first_by_id(events, order), "text", with_json)
    key = F.sha2(F.to_json(F.struct(
        "source_id", F.col("safe").alias("text"), "truncated", "sensitive", "parse_uncertain"
    )), 256)
    first = F.struct(
        "id", "source", F.col("safe").alias("text"), "truncated", "sensitive", "parse_uncertain",
        F.col(order).alias("first_arrival"),
    )
    return (
        d.withColumn("search_group", key).groupBy("search_group")
        .agg(
            F.count(F.lit(1)).alias("count"), F.min("ts_raw").alias("first_seen"),
            F.max("ts_raw").alias("last_seen"), F.min_by(first, order).alias("_f"),
        )
        .select("search_group", "_f.*", "count", "first_seen", "last_seen")
    )


def literal_search(groups: DataFrame, query: str) -> DataFrame:
    """Case-insensitive containment; every group is examined."""
    hit = F.lower("text").contains(clean_query(query).lower())
    return groups.withColumn("relevance", F.when(hit, "match").otherwise("unrelated")).withColumn(
        "confidence", F.lit(None).cast("double")
    ).withColumn("cached", F.lit(False)).withColumn("examined", F.lit(True))


def candidate_groups(groups: DataFrame, query: str, budget: int) -> DataFrame:
    """The ``budget`` x 8 groups that share most terms with the question; ties by arrival."""
    if not 1 <= budget <= 64:
        raise ValueError("invalid search budget")
    score = term_overlap(F.concat("text", F.to_json("source")), clean_query(query))
    return groups.withColumn("score", score).orderBy(F.desc("score"), "first_arrival").limit(
        budget * GROUPS_PER_CALL
    )


def relevance_key(query: str) -> Column:
    """Cache key: question, group and its occurrence count and span."""
    return F.sha2(F.to_json(F.struct(
        F.lit("search-v1"), F.lit(clean_query(query)), "search_group", "count", "first_seen", "last_seen"
    ), {"ignoreNullFields": "false"}), 256)


def _sound(answers: pd.DataFrame | None, expected: int) -> bool:
    if answers is None or len(answers) != expected or not {"relevance", "confidence"} <= set(answers.columns):
        return False
    known = answers["relevance"].isin(["match", "possible", "unrelated"])
    return bool((known & pd.to_numeric(answers["confidence"], errors="coerce").between(0, 1)).all())


_ANSWER = "search_group string, relevance string, confidence double"


def score_relevance(
    groups: DataFrame,
    query: str,
    judge: Callable[[str, pd.DataFrame], pd.DataFrame],
    budget: int = 16,
    cache: DataFrame | None = None,
    now: int | None = None,
    cache_ttl: int = 300,
) -> DataFrame:
    """Relevance of each group to the question.

    Fresh cache entries ``(key, relevance, confidence, at)`` answer first; the best remaining
    candidates go to ``judge`` eight at a time. A call that fails, or in which any answer is missing, not one of
    match, possible and unrelated, or without a confidence between 0 and 1, counts as a whole as unknown. Doubtful or limited evidence reads possible.
    """
    q = clean_query(query)
    d = groups.withColumn("cache_key", relevance_key(query))
    known = d.sparkSession.createDataFrame([], "cache_key string, _cr string, _cc double")
    if cache is not None:
        fresh = cache if now is None else cache.where(F.lit(now) - F.col("at") < cache_ttl)
        known = fresh.groupBy(F.col("key").alias("cache_key")).agg(
            F.max_by("relevance", "at").alias("_cr"), F.max_by("confidence", "at").alias("_cc")
        )
    d = d.join(known, "cache_key", "left")
    cand = candidate_groups(d.where("_cr IS NULL"), query, budget)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), GROUPS_PER_CALL):
                part = pdf.iloc[start:start + GROUPS_PER_CALL].reset_index(drop=True)
                try:
                    got = judge(q, part)
                except Exception:
                    got = None
                if not _sound(got, len(part)):
                    got = pd.DataFrame({"relevance": ["unknown"] * len(part), "confidence": None})
                yield pd.DataFrame({
                    "search_group": part["search_group"], "relevance": got["relevance"],
                    "confidence": got["confidence"].astype("float64"),
                })

    answers = (
        cand.select("search_group", "id", "text", "source", "count", "first_seen", "last_seen")
        .mapInPandas(run, _ANSWER)
        .withColumnRenamed("relevance", "_r").withColumnRenamed("confidence", "_c")
    )
    out = d.join(answers, "search_group", "left")
    softened = F.when(F.col("_r") == "unknown", "unknown").otherwise(
        C.soften_relevance("_r", "_c", "truncated", "parse_uncertain")
    )
    return (
        out.withColumn("cached", F.col("_cr").isNotNull())
        .withColumn("examined", F.col("_cr").isNotNull() | F.col("_r").isNotNull())
        .withColumn("relevance", F.coalesce("_cr", softened))
        .withColumn("confidence", F.when(F.col("cached"), F.col("_cc")).otherwise(F.col("_c")))
        .drop("_cr", "_cc", "_r", "_c")
    )


def cache_entries(results: DataFrame, now: int) -> DataFrame:
    """Rows to append to the relevance cache."""
    return results.where("examined AND NOT cached AND relevance <> 'unknown'").select(
        F.col("cache_key").alias("key"), "relevance", "confidence", F.lit(now).cast("bigint").alias("at")
    )


#: Answers that the cache keeps, the newest first.
CACHED_ANSWERS = 2048
_CACHE = "key string, relevance string, confidence double, at bigint"


def search_round(
    groups: DataFrame, query: str, judge: Callable[[str, pd.DataFrame], pd.DataFrame], folder: str, now: int,
    budget: int = 16, cache_ttl: int = 300, capacity: int = CACHED_ANSWERS,
) -> DataFrame:
    """``score_relevance`` with a cache in ``folder`` that is carried from round to round.

    What is older than ``cache_ttl`` is dropped, new answers are added, and the newest ``capacity`` are written as the next
    version before the results are given. A round that breaks off leaves the version before it in force; rounds follow each
    other. The judge is asked once per round, as the results are written.
    """
    spark = groups.sparkSession
    done = [int(n) for n in T.children(spark, folder) if T.complete(spark, f"{folder}/{n}")]
    last = max(done, default=-1)
    old = spark.read.schema(_CACHE).parquet(f"{folder}/{last:08d}") if done else spark.createDataFrame([], _CACHE)
    results = written(score_relevance(groups, query, judge, budget, old, now, cache_ttl), "relevance")
    fresh = old.where(F.lit(now) - F.col("at") < cache_ttl).unionByName(cache_entries(results, now))
    kept = fresh.groupBy("key").agg(F.max_by(F.struct("relevance", "confidence", "at"), "at").alias("v")).select("key", "v.*")
    kept.orderBy(F.desc("at"), "key").limit(capacity).write.mode("overwrite").parquet(f"{folder}/{last + 1:08d}")
    for n in done:
        if n < last:
            T.remove(spark, f"{folder}/{n:08d}")
    return results


def result_page(results: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """Matches before possible before unknown, then confidence, count and id.

    Missing confidences sort last inside their class.
    """
    rank = F.expr("CASE relevance WHEN 'match' THEN 0 WHEN 'possible' THEN 1 ELSE 2 END")
    return (
        results.where("examined AND relevance <> 'unrelated'")
        .orderBy(rank, F.desc_nulls_last("confidence"), F.desc("count"), "search_group")
        .offset(offset).limit(limit)
    )


def search_summary(results: DataFrame) -> DataFrame:
    """One row of totals over all groups of a search."""
    rel = F.col("relevance")
    seen = F.col("examined")
    return results.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.count_if(seen).alias("examined_groups"),
        F.count_if(~seen).alias("unexamined_groups"),
        F.count_if(seen & (rel == "unknown")).alias("failed_groups"),
        F.count_if("cached").alias("cache_hits"),
        F.count_if(seen & (rel == "match")).alias("matched_groups"),
        F.count_if(seen & (rel == "possible")).alias("possible_groups"),
        F.coalesce(F.sum(F.when(seen & (rel == "match"), F.col("count"))), F.lit(0)).alias("matching_instances"),
    ).withColumn("partial", (F.col("unexamined_groups") > 0) | (F.col("failed_groups") > 0))
