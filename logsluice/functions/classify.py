"""Classification expressions over events and verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .. import schema as S
from . import patterns as P
from .text import _col

JUDGMENT_FIELDS = tuple(f.name for f in S.JUDGMENT.fields)
CONFIDENCES = JUDGMENT_FIELDS[3:6]


def judgment(importance, severity, category, i_conf=None, s_conf=None, c_conf=None, error=None):
    """Build a verdict struct from literals or columns."""
    values = (importance, severity, category, i_conf, s_conf, c_conf, error)
    return F.struct(*[
        (v if isinstance(v, Column) else F.lit(v)).cast(f.dataType).alias(f.name)
        for v, f in zip(values, S.JUDGMENT.fields)
    ])


def unknown(reason) -> Column:
    return judgment("unknown", "unknown", "unknown", error=reason)


def baseline_signals(text) -> Column:
    text = _col(text)
    return F.array_compact(F.array(
        F.when(text.rlike(P.RISK_WORDS), F.lit("error_or_failure_keyword")),
        F.when(text.rlike(P.SERVER_FAULT), F.lit("http_5xx")),
        F.when(text.rlike(P.WARN_WORDS), F.lit("warning_level")),
    ))


def baseline(text) -> Column:
    signals = baseline_signals(text)
    return F.struct((F.size(signals) > 0).alias("important"), signals.alias("signals"))


def security_shaped(text) -> Column:
    return _col(text).rlike(P.SECURITY_WORDS)


def offline_judgment(important) -> Column:
    """Keyword verdict; it never claims a confidence."""
    important = _col(important)
    return judgment(
        F.when(important, "important").otherwise("uncertain"),
        F.when(important, "degraded").otherwise("info"),
        "unknown",
    )


def _within(value: Column, low: float) -> Column:
    """NULL and NaN both fail (Spark orders NaN above every number)."""
    return F.coalesce(~F.isnan(value) & (value >= low) & (value <= 1.0), F.lit(False))


def _clean(j: Column) -> Column:
    return F.coalesce(j["analysis_error"], F.lit("")) == ""


def reusable(j) -> Column:
    """Verdicts that may be copied to later events of the same template."""
    j = _col(j)
    ok = _clean(j) & j["importance"].isin("routine", "important")
    ok = ok & ~j["category"].isin("unknown", "security", "fraud")
    for name in CONFIDENCES:
        ok = ok & _within(j[name], 0.7)
    return F.coalesce(ok, F.lit(False))


def valid_judgment(j) -> Column:
    j = _col(j)
    ok = (
        _clean(j) & j["importance"].isin(*S.IMPORTANCE) & j["severity"].isin(*S.SEVERITY)
        & j["category"].isin(*S.CATEGORY)
    )
    for name in CONFIDENCES:
        ok = ok & _within(j[name], 0.0)
    return F.coalesce(ok, F.lit(False))


def token_list(text) -> Column:
    return F.filter(F.split(_col(text), P.TOKEN_GAP), lambda t: t != "")


def groupable(text, truncated, sensitive, parse_uncertain) -> Column:
    """Whether an event may share a verdict with others of its template."""
    text = _col(text)
    return (
        ~_col(parse_uncertain) & ~_col(truncated) & ~_col(sensitive)
        & (F.octet_length(text) <= S.MAX_SAMPLE_BYTES) & ~text.contains("\n")
        & ~security_shaped(text) & (F.size(token_list(text)) <= S.MAX_TOKENS)
    )


@dataclass(frozen=True)
class Policy:
    """Notification policy (fixed values: the defaults)."""

    categories: tuple = ("security", "fraud")
    severities: tuple = ("degraded", "impact", "outage")
    min_confidence: float = 0.85
    cooldown: int = 300
    window: int = 900
    recurrence: int = 5
    max_escalation: int = 8
    abstention: str = "review"

    def __post_init__(self):
        sound = (
            0 < len(self.categories) <= 9
            and set(self.categories) <= set(S.CATEGORY) - {"unknown"}
            and 0 < len(self.severities) <= 5
            and set(self.severities) <= set(S.SEVERITY)
            and 0 <= self.min_confidence <= 1
            and 1 <= self.cooldown <= 86400
            and 1 <= self.window <= 604800
            and 2 <= self.recurrence <= 100000
            and 1 <= self.max_escalation <= 32
            and self.abstention in ("record", "review")
        )
        if not sound:
            raise ValueError("invalid policy")


def policy_decision(j, truncated, sensitive, parse_uncertain, policy: Policy = Policy()) -> Column:
    """notify, review, abstain or ignore."""
    j = _col(j)
    doubt = (
        _col(parse_uncertain) | _col(truncated) | _col(sensitive) | ~_clean(j)
        | j["importance"].isin("unknown", "uncertain")
    )
    for name in CONFIDENCES:
        doubt = doubt | ~_within(j[name], policy.min_confidence)
    urgent = (j["importance"] == "important") & (
        j["category"].isin(*policy.categories) | j["severity"].isin(*policy.severities)
    )
    held = "review" if policy.abstention == "review" else "abstain"
    return F.when(doubt, held).when(urgent, "notify").otherwise("ignore")


def confidence_value(j, reviewed=None) -> Column:
    """Importance confidence where one can honestly be shown, else NULL."""
    j = _col(j)
    shown = _clean(j) & ~j["importance"].isin("pending", "dropped", "unknown")
    shown = shown & _within(j["importance_confidence"], 0.0)
    if reviewed is not None:
        shown = shown & ~_col(reviewed)
    return F.when(shown, j["importance_confidence"])


def confidence_band(value) -> Column:
    value = _col(value)
    return (
        F.when(value.isNull(), "unscored").when(value >= 0.9, "high")
        .when(value >= 0.7, "medium").otherwise("low")
    )


def source_label(source) -> Column:
    source = _col(source)
    blank_is_null = [
        F.when(source[n] != "", source[n]) for n in ("namespace", "pod", "container")
    ]
    return F.when(
        source["type"] == "kubernetes", F.concat_ws("/", *blank_is_null)
    ).otherwise(F.coalesce(F.when(source["path"] != "", source["path"]), F.lit("Unknown source")))


def baseline_disagrees(importance, baseline_important) -> Column:
    importance = _col(importance)
    return importance.isin("important", "routine") & (
        _col(baseline_important) != (importance == "important")
    )


def soften_relevance(relevance, confidence, truncated, parse_uncertain) -> Column:
    limited = (_col(confidence) < 0.7) | _col(truncated) | _col(parse_uncertain)
    return F.when(limited, "possible").otherwise(_col(relevance))
