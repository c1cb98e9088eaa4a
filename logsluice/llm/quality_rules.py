"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule names a measure and the closed range in which it passes. ``measures`` computes what rules
may name, ``verdict`` turns the table into one boolean column. Nothing is shuffled and no user
function runs: a document is judged where it is read.

Null and empty texts have no words; every ratio of them is null and they fail the word minimum.
Repeated rows, and rows sharing an id, are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, words

#: Words in a repeat window.
WINDOW = 5

#: Frequent function words of the languages that the corpus holds.
STOP_WORDS = (
    # English
    "a and are as at be by for from he in is it of on or that the this to was were with "
    # German
    "aber als auch auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie und "
    "von wie zu "
    # French
    "au aux ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    # Spanish
    "al como con del el ella esta este la las lo los más no para por que se su sus un una y"
)


@dataclass(frozen=True)
class Rule:
    measure: str
    low: float | None = None
    high: float | None = None


#: A text that breaks one of these is refused whatever the table says.
BASE_RULES = (Rule("n_words", low=10), Rule("repeat_percent", high=20))

DEFAULT_RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbol_ratio", high=0.08),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("mean_line_words", low=1.5),
)


def measures(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios that rules name. Columns of those names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    stop = sorted(set(STOP_WORDS.split()))
    df = documents.withColumn("_words", words(F.col(text)))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_win", F.when(F.col("n_words") >= WINDOW, _windows(F.col("_words"), F.col("n_words"))))
    df = df.withColumns({
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(
            F.size(F.array_distinct("_win")) < F.size("_win"), _covered(F.col("_win"))
        ).otherwise(F.lit(0)).cast("long"),
        "_n_lines": F.size("_lines"),
        "_n_stop": F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))),
    }).drop("_words", "_lines", "_win")
    some = F.when(F.col("n_words") > 0, F.col("n_words"))
    lines = F.when(F.col("_n_lines") > 0, F.col("_n_lines"))
    return df.withColumns({
        "mean_word_chars": F.col("word_chars") / some,
        "symbol_ratio": F.col("n_symbols") / F.when(F.col("word_chars") > 0, F.col("word_chars")),
        "stop_word_ratio": F.col("_n_stop") / some,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "mean_line_words": F.col("n_words") / lines,
        "repeat_percent": 100 * F.col("n_repeat_words") / some,
    }).drop("_n_stop", "_n_lines")


def _windows(ws: Column, n: Column) -> Column:
    """A 64-bit hash for each window of consecutive words."""
    starts = F.sequence(F.lit(0), (n - WINDOW).cast("int"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))


def _covered(win: Column) -> Column:
    """Words in windows found twice or more: sort (hash, place), keep places with an equal neighbour,
    and add up what each place covers before the next one."""
    ordered = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        alone = lambda x, j: (
            F.coalesce(F.get(s, j - 1)["h"] != x["h"], F.lit(True))
            & F.coalesce(F.get(s, j + 1)["h"] != x["h"], F.lit(True))
        )
        return F.sort_array(F.filter(
            F.transform(s, lambda x, j: F.when(~alone(x, j), x["i"])), lambda v: v.isNotNull()
        ))

    def total(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    # ``transform`` over one element binds its value to a name, so that it is computed once.
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return bind(ordered, lambda s: bind(repeated(s), total))


def verdict(rules) -> Column:
    """One expression, true where every rule passes; a measure that is null breaks its rule."""
    out = F.lit(True)
    for r in rules:
        c = F.col(r.measure)
        if r.low is not None:
            out = out & F.coalesce(c >= r.low, F.lit(False))
        if r.high is not None:
            out = out & F.coalesce(c <= r.high, F.lit(False))
    return out


def judge_quality(documents: DataFrame, rules=DEFAULT_RULES, base=BASE_RULES, text: str = "text") -> DataFrame:
    """``documents`` with its measures, ``base_failed`` and ``kept``.

    Columns of the input that have the name of an added one are replaced; others pass through.
    """
    return measures(documents, text).withColumn("base_failed", ~verdict(base)).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )
