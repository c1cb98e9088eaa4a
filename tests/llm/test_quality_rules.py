import random

from pyspark.sql import functions as F

from logsluice.llm import quality_rules as Q
from helpers import words


def counts(text):
    ws = words(text)
    wins = [tuple(ws[k:k + 5]) for k in range(len(ws) - 4)]
    covered = set()
    for k, w in enumerate(wins):
        if wins.count(w) > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_counts_of_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\r\n", "one", "a b c d", "a b c d e", "a b c d e " * 4, "a\x0bb\x0cc\xa0d é日本 𝔘 <#>|", "same\n\nsame\n same\nsame", "x x x x x x x"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)] + ["line | x\n" * 30 + "the end " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_words": F.lit("x"), "kept": F.lit(1)})
    got = {r.doc_id: r for r in Q.judge_quality(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        n = counts(t)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, t
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.kept and r.base_failed)


def test_table_of_rules(spark):
    text = "the cat and the dog went to a house in the wood and saw it"
    df = spark.createDataFrame([(1, text), (1, text), (2, "zyx " + " ".join(f"w{k}" for k in range(20)))], "doc_id long, text string")
    kept = lambda rules: sorted((r.doc_id, r.kept) for r in Q.judge_quality(df, rules).collect())
    assert kept(()) == [(1, True), (1, True), (2, True)]
    assert kept((Q.Rule("stop_word_ratio", low=0.2),)) == [(1, True), (1, True), (2, False)]
    assert kept((Q.Rule("n_words", 10, 16),)) == [(1, True), (1, True), (2, False)]


def test_no_python_and_no_exchange(spark, sf):
    from logsluice.llm.queries import QUERIES

    plan = QUERIES["op2_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert Q.judge_quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []
