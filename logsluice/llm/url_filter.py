"""URL filter: explicit rules first, then templates of a path tree judged by what the rules label.

A rule is ``host/path``; it fits its host and every subdomain where the path starts with the
rule's path. The longest rule wins, and of equally long ones the blocking one.

Addresses that a rule decides are the labelled ones. Per host their paths and all others form a
tree of segments. Segments that vary by their looks (numbers, dates, hex, ids) become ``*`` at
once; below a node that still has many children, mostly seen once, all children become ``*``.
Branches of a host that have the same shape and a similar share of blocked addresses are merged,
and a merged branch is blocked if its share, smoothed towards the share of its host (itself
smoothed towards the share of all), reaches a threshold. A host without labelled addresses is allowed.

Addresses are first counted per host and template, so the tree is built over that small table; one
join brings the verdicts back. Null addresses and those without ``://`` have an empty host and
path, and are judged like any other host. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, write_shared

#: Segments of the tree; what lies deeper belongs to the branch of its first ones.
DEPTH = 4
#: A node with more children than this, over half of them seen once, holds variable segments.
MAX_CHILDREN = 50
#: Weight of the host's share, and of the overall share, in counted addresses.
PRIOR = 4.0
#: Siblings merge if their smoothed shares fall into the same of so many bands.
BANDS = 4
BLOCK_AT = 0.5

_VARIABLE = (
    r"^([0-9]+([-_.][0-9]+)*|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[A-Za-z]+[-_]?[0-9]+)"
    r"(\.[A-Za-z]{1,5})?$"
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of an address; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of ``(verdict, host/path)``, else nulls.

    Rules are a short list of a policy and become one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1]))
    for what, text in ordered:  # the last one wins
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    parts = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, DEPTH)
    return F.transform(parts, lambda s: F.when(
        s.rlike(_VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))
    ).otherwise(s))


def judge_templates(counted: DataFrame) -> DataFrame:
    """``counted``: (host, segments, n, n_labelled, n_blocked), one row per host and raw template.

    Adds ``template`` and ``blocked``.
    """
    t = counted.withColumn("template", F.lit(""))
    for d in range(DEPTH):
        seg = F.get("segments", F.lit(d))
        children = t.withColumn("_s", seg).where(F.col("_s").isNotNull()).groupBy("host", "template", "_s").agg(F.sum("n").alias("n"))
        wild = children.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("_c"), F.count_if(F.col("n") == 1).alias("_once")
        ).where((F.col("_c") > MAX_CHILDREN) & (F.col("_once") * 2 > F.col("_c"))).select("host", "template", F.lit(True).alias("_wild"))
        t = t.join(wild, ["host", "template"], "left").withColumn(
            "template", F.when(seg.isNull(), F.col("template")).otherwise(
                F.concat("template", F.lit("/"), F.when(F.col("_wild"), F.lit("*")).otherwise(seg))
            )
        ).drop("_wild")

    def share(bad: Column, seen: Column, prior: Column) -> Column:
        return (bad + F.lit(PRIOR) * prior) / (seen + F.lit(PRIOR))

    seen = counted.agg(F.sum("n_blocked"), F.sum("n_labelled")).first()  # two numbers
    overall = share(F.lit(seen[0] or 0), F.lit(seen[1] or 0), F.lit(0.0))
    hosts = t.groupBy("host").agg(
        share(F.sum("n_blocked"), F.sum("n_labelled"), overall).alias("_host"), F.sum("n_labelled").alias("_seen")
    )
    branches = t.groupBy("host", "template").agg(F.sum("n_blocked").alias("_b"), F.sum("n_labelled").alias("_l")).join(hosts, "host")
    own = share(F.col("_b"), F.col("_l"), F.col("_host"))
    branches = branches.withColumns({
        "_shape": F.regexp_replace("template", r"[^/*.]+", "+"),
        "_band": F.least(F.floor(own * BANDS), F.lit(BANDS - 1)),
    })
    merged = branches.groupBy("host", "_shape", "_band").agg(
        ((share(F.sum("_b"), F.sum("_l"), F.max("_host")) >= F.lit(BLOCK_AT)) & (F.max("_seen") > 0)).alias("blocked")
    )
    verdicts = branches.join(merged, ["host", "_shape", "_band"]).select("host", "template", "blocked")
    return t.join(verdicts, ["host", "template"])


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, template and verdict ('allow' or 'block').

    Columns of the input with these names are replaced.
    """
    host, path = split_url(F.col(url))
    df = pages.drop("rule", "template", "verdict").withColumn("_h", host).withColumn("_p", path)
    df = df.drop("host", "path").withColumnsRenamed({"_h": "host", "_p": "path"})
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "_said": said, "_segments": _segments(F.col("path"))})
    df = df.withColumn("_raw", F.array_join("_segments", "/"))
    counted = write_shared(df.groupBy("host", "_raw").agg(
        F.first("_segments").alias("segments"), F.count(F.lit(1)).alias("n"), F.count("_said").alias("n_labelled"),
        F.count_if(F.col("_said") == "block").alias("n_blocked"),
    ), "url-templates")
    judged = write_shared(judge_templates(counted).select("host", "_raw", "template", "blocked"), "url-verdicts")
    out = df.join(judged, ["host", "_raw"], "left")
    return out.withColumn(
        "verdict", F.coalesce("_said", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    ).drop("_said", "_segments", "_raw", "blocked")
