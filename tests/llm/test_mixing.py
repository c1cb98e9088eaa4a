import random

import pytest
from pyspark.sql import functions as F

from logsluice.llm import mixing as M
from helpers import words


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share out by weight again and again until nothing is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {s: 0.0 for s in names}, set(names), share * sum(sizes.values())
    while free and left > 1e-9:
        unit = left / sum(w[s] for s in free)
        left = 0.0
        for s in sorted(free, key=names.index):
            target[s] += unit * w[s]
        for s in list(free):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def corpus(spark, n=300, seed=4):
    rng = random.Random(seed)
    sources = ["big"] * 6 + ["b", "a", None, "ü", "Z"]
    rows = [(k, rng.choice(sources), " ".join("w" * rng.randint(1, 5) for _ in range(rng.randrange(80)))) for k in range(n)]
    rows += [(None, "a", "null id here"), (3, "a", "same id twice"), (3, "a", "same id twice"), (999, "empty", None), (998, "a", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"target": F.lit("x"), "_x": F.lit(1)})


def test_targets_and_what_is_taken(spark):
    rows, df = corpus(spark)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = water_fill(sizes)
    out = M.mix(M.with_size(df)).collect()
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(r.passes)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(repr, out)) == sorted(map(repr, M.mix(M.with_size(df.repartition(3))).collect()))


def test_training_order_holds_the_mix_and_stays_near_the_weights(spark):
    _, df = corpus(spark)
    sized = M.with_size(df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    pieces = M.training_order(sized, slots=1 << 10).collect()
    per_doc, per_source = {}, {}
    for p in pieces:
        per_doc[p.doc_id] = per_doc.get(p.doc_id, 0) + p.words
    mixed = M.mix(sized).collect()
    for r in mixed:
        assert per_doc.get(r.doc_id, 0) == r.taken
        per_source[r.source] = r.target
    total = sum(per_source.values())
    half = [p for p in pieces if p.slot < 512]
    for s, target in per_source.items():
        got = sum(p.words for p in half if p.source == s)
        assert abs(got - target / 2) <= 12 * total / 1024 + 12


def test_texts_of_passes(spark):
    _, df = corpus(spark)
    each = M.mixed_texts(M.mix(M.with_size(df))).collect()
    mixed = M.mix(M.with_size(df)).collect()
    assert sum(len(words(r.text)) for r in each) == sum(r.taken for r in mixed)
    assert len(each) == sum(n > 0 for r in mixed for n in r.passes)


def test_schedule_is_a_permutation_of_slots(spark):
    _, df = corpus(spark)
    targets = M.source_targets(M.with_size(df).drop("target"))
    s = M.schedule(targets, 1 << 9).collect()
    assert sorted(r.slot for r in s) == list(range(1 << 9))
    by = {}
    for r in sorted(s, key=lambda r: r.slot):
        by.setdefault(r._src, []).append(r["rank"])
    assert all(v == list(range(len(v))) for v in by.values())


def test_empty_and_wordless_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mix(M.with_size(empty)).collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in M.mix(M.with_size(blank)).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_no_python(spark, sf):
    from logsluice.llm.queries import QUERIES

    for q in ("op9_mixing", "op5_url_filter"):
        plan = QUERIES[q](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_sources_far_below_a_slot_get_their_target(spark):
    small = {"a": 30, "c": 2250, "d": 1, "f": 34_000, None: 700}
    sizes = [(k, "b" if k % 2 else "e", 10 ** 9) for k in range(4)] + [(10 + k, s, n) for k, (s, n) in enumerate(small.items())]
    sized = spark.createDataFrame(sizes, "doc_id long, source string, size long")
    got = M.mix(sized).collect()
    assert {r.source: r.taken for r in got if r.source in small} == {s: 2 * n for s, n in small.items()}
    for r in got:
        assert r.source in small or r.source_size == 2 * 10 ** 9
    taken, target = (sum(r[c] for r in got if r.source == "b") for c in ("taken", "target"))
    assert abs(taken - target / 2) <= 1


def test_blocks_make_up_what_the_mix_takes(spark):
    """Whatever the grid, adding up the words of scheduled blocks gives what the hash order gives."""
    _, df = corpus(spark)
    copies = spark.createDataFrame([(5, "copies", "one two three")] * 400, "doc_id long, source string, text string")
    sized = M.with_size(df.select("doc_id", "source", "text").unionByName(copies)).drop("text")
    pick = ["doc_id", "source", "size", "source_size", "target", "taken"]
    want = sorted(map(repr, M.mix(sized).select(pick).collect()))
    for slots in (None, 1, 1 << 5, 1 << 12):
        assert sorted(map(repr, M.taken_words(sized, slots=slots).select(pick).collect())) == want


def test_names_that_operators_use(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], "w " * (k + 1)) for k in range(20)], "doc_id long, source string, text string")
    odd = df.selectExpr("*", *[f"'x{k}' AS {c}" for k, c in enumerate(("_src", "_key", "_row", "_cut", "_copy", "_whole", "many", "_end", "rank", "slot"))])
    got = M.mix(M.with_size(odd)).collect()
    plain = {r.doc_id: r.taken for r in M.mix(M.with_size(df)).collect()}
    assert {r.doc_id: r.taken for r in got} == plain and all(r["_src"] == "x0" and r["slot"] == "x9" for r in got)


def test_grid_is_one_rule(spark):
    for words_, slots in ((0, 1), (1024, 1), (1025, 2), (3000, 4), (1 << 30, 1 << 20)):
        sized = spark.createDataFrame([(1, "a", words_)], "doc_id long, source string, size long")
        targets = M.source_targets(sized, share=1.0)
        assert M.slots_for(targets) == slots


def test_scheduled_rows_are_the_mix_in_slot_order(spark):
    """Words by the blocks of the schedule are those of the hash order, and rows come where the first of their blocks does."""
    _, df = corpus(spark)
    copies = spark.createDataFrame([(5, "copies", f"one two {k}", "x", 1) for k in range(400)], "doc_id long, source string, text string, target string, _x int")
    sized = M.with_size(df.unionByName(copies))
    mixed, slots = M.scheduled(sized, slots=1 << 6)
    assert slots == 1 << 6
    pick = ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert sorted(map(repr, mixed.select(pick).collect())) == sorted(map(repr, M.mix(sized).select(pick).collect()))
    first = {}
    for p in M.training_order(sized, slots=1 << 6).collect():
        at = (p.doc_id, p.source)
        first[at] = min(first.get(at, p.slot), p.slot)
    found = M.in_slot_order(M.mixed_texts(mixed), slots).collect()
    assert [r.slot for r in found] == sorted(r.slot for r in found)
    least = {}
    for r in found:
        least[r.doc_id, r.source] = min(least.get((r.doc_id, r.source), r.slot), r.slot)
    assert least == first
    assert sum(len(words(r.text)) for r in found) == sum(r.taken for r in mixed.collect())


def test_the_pipeline_mixes_by_the_schedule(spark):
    import corpus_pipeline as P

    rows = [(k, "w " * (40 + k), "en", "abc"[k % 3], 80 + 2 * k) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in P.mix_sources(spark, docs, "").collect()]
    want = [r.doc_id for r in M.in_slot_order(M.mixed_texts(M.scheduled(M.with_size(docs))[0]), M.scheduled(M.with_size(docs))[1]).collect()]
    starts = {}
    for p in M.training_order(M.with_size(docs)).collect():
        starts[p.doc_id] = min(starts.get(p.doc_id, p.slot), p.slot)
    firsts = [starts[i] for k, i in enumerate(got) if i not in got[:k]]
    assert sorted(got) == sorted(want) and firsts == sorted(firsts)
