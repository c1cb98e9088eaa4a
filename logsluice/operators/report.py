"""Report parts: summary, losses and completeness, important groups, retained tail, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

# Counters that alone make a run incomplete.
LOSS_COUNTERS = (
    "dropped", "truncated_events", "parse_uncertain", "evicted_events", "budget_stopped",
    "outbox_backpressure",
)
COVERAGE_KEPT = 500


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def summary(
    events: DataFrame, importance: str = "judgment.importance", gaps: DataFrame | None = None, usage: DataFrame | None = None,
) -> DataFrame:
    """One row of counts; distinct sources are counted on the source hash.

    With ``gaps`` (source, status) sources that only have gaps count as well, and the gaps are counted. ``usage`` is one of
    ``usage_rollup``: its requests and their cost in dollars follow.
    """
    imp = F.col(importance)
    reused = F.col("analysis_reused") if "analysis_reused" in events.columns else F.lit(False)
    rows = events.select("source_id", "line_count", imp.alias("imp"), reused.alias("reused"), F.lit(True).alias("event"))
    if gaps is not None:
        none = F.lit(None)
        rows = rows.unionByName(gaps.select(
            X.source_id("source").alias("source_id"), none.cast("bigint").alias("line_count"), none.cast("string").alias("imp"),
            F.lit(False).alias("reused"), F.lit(False).alias("event"),
        ))
    counts = [
        F.count_if("event").alias("events"),
        F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"),
        F.countDistinct("source_id").alias("streams"),
        *[_n(F.col("imp") == name).alias(name) for name in ("important", "routine", "uncertain", "unknown")],
        _n(F.col("reused")).alias("reused_events"),
    ]
    if gaps is not None:
        counts.append(F.count_if(~F.col("event")).alias("coverage_gaps"))
    out = rows.agg(*counts)
    if usage is None:
        return out
    used = usage.agg(
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("api_requests"),
        F.coalesce(F.sum("cost_nano_usd") / 1e9, F.lit(0.0)).alias("total_estimated_cost_usd"),
        F.coalesce(F.bool_and("cost_complete"), F.lit(True)).alias("cost_complete"),
    )
    # Both sides are single aggregate rows.
    return out.withColumn("_j", F.lit(1)).join(used.withColumn("_j", F.lit(1)), "_j").drop("_j")


def loss_counters(events: DataFrame, gaps: DataFrame | None = None, retain: int | None = None,
                  extra: DataFrame | None = None) -> DataFrame:
    """``(metric, value)``; counters of one name from several places merge by their maximum."""
    base = events.agg(
        F.count_if("truncated").alias("truncated_events"),
        F.count_if("parse_uncertain").alias("parse_uncertain"),
        (F.greatest(F.count(F.lit(1)) - retain, F.lit(0)) if retain else F.lit(0))
        .cast("bigint").alias("evicted_events"),
    )
    names = base.columns
    parts = base.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names
    ])).alias("m")).select("m.*")
    if gaps is not None:
        by_status = gaps.groupBy("status").agg(F.count(F.lit(1)).alias("value"))
        total = by_status.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("g"))
        parts = parts.unionByName(
            by_status.select(F.concat(F.lit("coverage_"), "status").alias("metric"), "value")
        ).unionByName(total.select(F.explode(F.array(
            F.struct(F.lit("coverage_gaps").alias("metric"), F.col("g").alias("value")),
            F.struct(F.lit("coverage_records_omitted").alias("metric"),
                     F.greatest(F.col("g") - COVERAGE_KEPT, F.lit(0)).alias("value")),
        )).alias("m")).select("m.*"))
    if extra is not None:
        parts = parts.unionByName(extra.select("metric", "value"))
    return parts.groupBy("metric").agg(F.max("value").alias("value"))


def completeness(metrics: DataFrame, live: bool = False, unknown_verdicts: DataFrame | None = None) -> DataFrame:
    """One row: whether the window was covered without any recorded loss. Live never is."""
    m = F.col("metric")
    loss = (
        m.startswith("coverage_") | (m.startswith("state_") & m.endswith("_evicted"))
        | m.isin(*LOSS_COUNTERS)
    ) & (F.col("value") > 0)
    out = metrics.agg(F.coalesce(F.bool_and(~loss), F.lit(True)).alias("complete"))
    if live:
        return out.select(F.lit(False).alias("complete_within_window"))
    if unknown_verdicts is None:
        return out.select(F.col("complete").alias("complete_within_window"))
    flag = unknown_verdicts.agg(F.count(F.lit(1)).alias("u"))
    # Both sides are single aggregate rows.
    return out.withColumn("_j", F.lit(1)).join(flag.withColumn("_j", F.lit(1)), "_j").select(
        (F.col("complete") & (F.col("u") == 0)).alias("complete_within_window")
    )


def important_groups(events: DataFrame, order: str = "arrival") -> DataFrame:
    """Important events by group: count and the first member's verdict.

    Member ids stay rows (``group_members``): a group may hold any share of the input.
    """
    first = F.struct("source_id", "text", F.col("judgment.severity"), F.col("judgment.category"))
    return (
        events.where(F.col("judgment.importance") == "important")
        .groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("count"), F.min_by(first, order).alias("_f"))
        .select("group_id", "_f.*", "count")
    )


def group_members(events: DataFrame, order: str = "arrival") -> DataFrame:
    """``(group_id, id)`` of the important events."""
    return events.where(F.col("judgment.importance") == "important").select("group_id", "id", order)


def ranked_groups(groups: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest groups: count descending, then id."""
    return groups.orderBy(F.desc("count"), "group_id").limit(n)


def retain_last(events: DataFrame, n: int, order: str = "arrival") -> DataFrame:
    """The newest ``n`` events (kept per partition first, then merged)."""
    return events.orderBy(F.desc(order)).limit(n)


def coverage_log(gaps: DataFrame, order: str, n: int = COVERAGE_KEPT) -> DataFrame:
    """The newest ``n`` gap records; ``loss_counters`` reports how many were left out."""
    return gaps.orderBy(F.desc(order)).limit(n)


def evidence_lines(events: DataFrame) -> DataFrame:
    """Console evidence: a header line per event and its indented body, one row per line."""
    j = F.col("judgment")
    head = F.concat(
        F.lit("["), j["importance"], F.lit("/"), j["severity"], F.lit("/"), j["category"],
        F.lit("] "), X.console_safe(F.to_json("source")), F.lit(" #"), F.col("id"),
    )
    body = F.transform(F.split("text", "\n"), lambda t: F.concat(F.lit("  "), X.console_safe(t)))
    note = F.when(
        F.coalesce(j["analysis_error"], F.lit("")) != "",
        F.array(F.concat(F.lit("  analysis: "), X.console_safe(j["analysis_error"]))),
    ).otherwise(F.array().cast("array<string>"))
    return events.select(
        "id", F.posexplode(F.concat(F.array(head), body, note)).alias("line_no", "line")
    ).select("id", F.col("line_no").cast("bigint").alias("line_no"), "line")


def top_lines(groups: DataFrame, n: int) -> DataFrame:
    """Plain ``xCOUNT text`` lines of the largest groups."""
    return ranked_groups(groups, n).select(
        "group_id",
        F.concat(F.lit("×"), F.col("count").cast("string"), F.lit(" "), X.console_safe("text")).alias("line"),
    )


def evict_oldest(table: DataFrame, capacity: int, at: str, key: str,
                 protected: Column | None = None) -> DataFrame:
    """Rows that survive when a table is cut to ``capacity``; oldest go first, ties by key.

    Protected rows (undelivered notifications) always stay and use up capacity.
    """
    if protected is None:
        return table.orderBy(F.desc(at), F.desc(key)).limit(capacity)
    kept = table.where(protected)
    room = max(0, capacity - kept.count())
    return kept.unionByName(
        table.where(~protected).orderBy(F.desc(at), F.desc(key)).limit(room)
    )


def page_events(events: DataFrame, offset: int, limit: int, max_bytes: int, order: str = "arrival") -> DataFrame:
    """One page: at most ``limit`` rows and ``max_bytes`` of JSON.

    A row that alone exceeds the budget is replaced by a stub with ``event_unavailable`` set.
    The rows considered are bounded by ``offset + limit`` before anything is numbered.
    """
    if not (0 <= offset <= 100000 and 1 <= limit <= 200):
        raise ValueError("invalid page")
    rows = events.orderBy(order).offset(offset).limit(limit)
    body = F.to_json(F.struct(*[c for c in events.columns]))
    stub = F.to_json(F.struct(
        F.lit("Event exceeds dashboard page limit; inspect the original report").alias("text"),
        F.lit("unknown").alias("importance"), F.lit(True).alias("event_unavailable"),
        F.col(order).alias("report_index"),
    ))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("json", body)
        .withColumn("event_unavailable", F.octet_length("json") > max_bytes)
        .withColumn("json", F.when(F.col("event_unavailable"), stub).otherwise(F.col("json")))
        .withColumn("_used", F.sum((F.octet_length("json") + 1).cast("bigint")).over(w))
        .where(F.col("_used") <= max_bytes)
        .select(*events.columns, "event_unavailable", "json")
    )
