"""Views of a report: filters, display groups, confidence ranges, facets and row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C

PAGE = 40
TAIL = 300


def _reviewed(df: DataFrame) -> Column:
    return F.col("review").isNotNull() if "review" in df.columns else F.lit(False)


def filter_events(
    events: DataFrame,
    importance: str = "all",
    label: str = "all",
    scope: dict | None = None,
    band: str = "all",
    search: str = "",
) -> DataFrame:
    """The event list under its filters. ``review`` means uncertain or unknown."""
    imp = F.col("judgment.importance")
    d = events
    if importance == "review":
        d = d.where(imp.isin("uncertain", "unknown"))
    elif importance in ("expected", "acknowledged"):
        d = d.where(F.col("review.status") == importance)
    elif importance != "all":
        d = d.where(imp == importance)
    for key, value in (scope or {}).items():
        if value:
            d = d.where(F.col(f"source.{key}") == value)
    if label != "all":
        d = d.where(C.source_label("source") == label)
    if band != "all":
        d = d.where(C.confidence_band(C.confidence_value("judgment", _reviewed(events))) == band)
    needle = search.lower().strip()
    if needle:
        hay = F.concat_ws(" ", "text", C.source_label("source"), F.col("judgment.category"), F.col("judgment.severity"))
        d = d.where(F.lower(hay).contains(needle))
    return d


def filter_tail(events: DataFrame, important_only: bool = False, search: str = "", n: int = TAIL,
                order: str = "arrival") -> DataFrame:
    """The newest ``n`` tail rows under the tail's own filters."""
    d = events
    if important_only:
        d = d.where(F.col("judgment.importance") == "important")
    needle = search.lower().strip()
    if needle:
        d = d.where(F.lower(F.concat_ws(" ", "text", C.source_label("source"))).contains(needle))
    return d.orderBy(F.desc(order)).limit(n)


def search_text(events: DataFrame, query: str) -> DataFrame:
    return events.where(F.lower("text").contains(query.lower()))


def tab(events: DataFrame, name: str) -> DataFrame:
    """Console tabs: important, routine, review (with pending) or all."""
    imp = F.col("judgment.importance")
    wanted = {
        "important": imp == "important", "routine": imp == "routine",
        "review": imp.isin("unknown", "uncertain", "pending"), "all": F.lit(True),
    }
    return events.where(wanted[name])


def group_key(df: DataFrame) -> Column:
    """The stored group id, or for old reports a key of source, text and truncation."""
    fallback = F.sha2(F.to_json(F.struct(
        "source", "text", "truncated", F.when(F.col("truncated"), F.col("id")).alias("own")
    )), 256)
    return F.coalesce("group_id", fallback)


def display_groups(events: DataFrame, order: str = "arrival") -> DataFrame:
    """Rows of the grouped event list with their confidence range.

    Instances stay rows (``instances``): a group may hold any share of the report.
    """
    reviewed = _reviewed(events)
    value = C.confidence_value("judgment", reviewed)
    status = F.col("review.status") if "review" in events.columns else F.lit(None).cast("string")
    d = events.withColumn("display_key", group_key(events)).withColumn("_v", value).withColumn(
        "_band", F.when(F.col("_v").isNotNull(), C.confidence_band("_v"))
    )
    grouped = d.groupBy(
        "display_key", F.col("judgment.importance").alias("importance"), status.alias("review_status"),
        F.col("judgment.severity").alias("severity"), F.col("judgment.category").alias("category"),
    ).agg(
        F.count(F.lit(1)).alias("instances"),
        F.min_by(F.struct("id", "text"), order).alias("_f"), F.min(order).alias("first"),
        F.min("_v").alias("min_confidence"), F.max("_v").alias("max_confidence"),
        F.count("_v").alias("_scored"),
        # At most three bands exist, so the distinct count is a set of at most three.
        F.size(F.collect_set("_band")).alias("_bands"), F.min("_band").alias("_only"),
    )
    band = (
        F.when(F.col("_scored") == 0, "unscored")
        .when((F.col("_bands") == 1) & (F.col("_scored") == F.col("instances")), F.col("_only"))
        .otherwise("mixed")
    )
    return grouped.select(
        "display_key", "importance", "review_status", "severity", "category", "instances", "first",
        F.col("_f.id").alias("id"), F.col("_f.text").alias("text"),
        "min_confidence", "max_confidence", band.alias("band"),
        (F.col("_scored") < F.col("instances")).alias("has_unscored"),
    )


def row_order(mode: str) -> list[Column]:
    """Sort columns for the modes high, low, frequency and collection; unscored rows go last."""
    by_size = [F.desc("instances"), F.col("first")]
    return {
        "collection": [F.col("first")],
        "frequency": by_size,
        "high": [F.desc_nulls_last("max_confidence"), *by_size],
        "low": [F.asc_nulls_last("min_confidence"), *by_size],
    }[mode]


def group_page(groups: DataFrame, mode: str = "high", page: int = 0, size: int = PAGE) -> DataFrame:
    return groups.orderBy(*row_order(mode)).offset(page * size).limit(size)


def instances(events: DataFrame, display_key: str, page: int = 0, size: int = PAGE,
              order: str = "arrival") -> DataFrame:
    """One page of the members of a display group."""
    d = events.withColumn("display_key", group_key(events)).where(F.col("display_key") == display_key)
    return d.orderBy(order).offset(page * size).limit(size)


def facets(events: DataFrame, field: str, scope: dict | None = None) -> DataFrame:
    """Distinct values of a source field under the choices made at the levels above it."""
    levels = ["namespace", "pod", "container"]
    d = events
    for above in levels[: levels.index(field)]:
        if (scope or {}).get(above):
            d = d.where(F.col(f"source.{above}") == scope[above])
    return d.select(F.col(f"source.{field}").alias(field)).where(F.col(field) != "").distinct()


#: A line that says what happened, and what in front of a message only says when or how bad.
_SAYING = r"^[\"']?(?i:message|msg|event|reason)[\"']?\s*:\s*\S"
_IN_FRONT = (r"^\d{4}-\d\d-\d\d[ T][\d:.]+(?:Z|[+-]\d\d:\d\d)?\s+", r"^(?i:info|warn|warning|error|debug|fatal)[:\s]+")
#: A literal shorter than this would match too much; a rule holds one up to this long.
_SHORTEST, _LONGEST = 8, 500
_BLANKS = " \t\n\r\f\x0b"


def suggest_pattern(text) -> Column:
    """A literal for an expected-event rule, taken from the message itself.

    Lines are ranked: one that names a message, event or reason, then one with a letter or digit; too
    short ones don't count. The best line loses its trailing object, time and level, unless too
    little would remain. A short message is its own pattern.
    """
    text = F.col(text) if isinstance(text, str) else text
    trim = lambda c: F.trim(c, F.lit(_BLANKS))

    def ranked(line: Column, at: Column) -> Column:
        line = trim(line)
        rank = F.when(line.rlike(_SAYING), 0).when(line.rlike(r"[\p{L}\p{N}]"), 1)
        return F.struct(F.when(F.length(line) >= _SHORTEST, rank).alias("rank"), at.alias("at"), line.alias("line"))

    usable = F.filter(F.transform(F.split(text, "\n"), ranked), lambda x: x["rank"].isNotNull())
    best = F.coalesce(F.array_min(usable)["line"], F.lit(""))
    bare = F.split(best, r"\s+\{", 2)[0]
    for what in _IN_FRONT:
        bare = F.regexp_replace(bare, what, "")
    bare = trim(bare)
    found = F.substring(F.when(F.length(bare) < _SHORTEST, best).otherwise(bare), 1, _LONGEST)
    return F.when(F.length(trim(text)) < _SHORTEST, trim(text)).otherwise(found)


def suggest_patterns(groups: DataFrame) -> DataFrame:
    """One suggested literal per display group."""
    return groups.withColumn("pattern", suggest_pattern("text"))
