import random

import corpus_pipeline as P
from logsluice.llm import near_copies as N, simhash as S
from logsluice.llm.common import read_table
from helpers import near_components, simhash, similar_texts, union_find


def corpus(seed=3):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", " \n", "one two", "ONE two", "one two three"]
    for size in (12, 30, 80, 200, 900):
        for _ in range(4):
            base = fresh(size)
            for _ in range(4):  # copies with more and more words changed, some of them below the similarity
                texts.append(" ".join(base))
                for _ in range(max(1, size // rng.choice((40, 80, 160)))):
                    base[rng.randrange(size)] = fresh(1)[0]
            texts.append(" ".join(base[:size * 9 // 10]))
    return texts


def test_stage_against_similar_texts(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = similar_texts(texts)
    assert want != near_components([simhash(t) for t in texts])
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, df, "").collect()) == sorted(set(want))


def test_small_tiles_and_parts_find_the_same(spark):
    texts = corpus(8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old = N.TILE_ROWS, N.PARTS, N.INDEXED
    marks = N.classes_of(N._marks(df, "doc_id", "text"))
    classes = {r.cls: r["first"] for r in marks.collect()}
    assert old[0][0] > len(classes)
    found = []
    for rows in (old[0], (1, 3)):
        edges = N.candidates(marks, tile_rows=rows).collect()
        at = {c: k for k, c in enumerate(sorted(classes))}
        found.append(union_find(len(at), [(at[e.a], at[e.b]) for e in edges]))
    assert found[0] == found[1]
    members = marks.where("n > 0").selectExpr("0L AS component", "cls", "digest", "n", "first")
    want = {min(c) for c in _groups(similar_texts(texts)).values()}
    for indexed in (old[2], 500):
        edges = N.similar_edges(df, members, indexed).collect()
        ids = {c: i for c, i in classes.items()}
        same = {}
        for i, t in enumerate(texts):
            same.setdefault(N.class_of(N.shingles(t)), []).append(i)
        pairs = [(ids[e.a], ids[e.b]) for e in edges] + [(x[0], y) for x in same.values() for y in x]
        assert set(union_find(len(texts), pairs)) == want


def _groups(component):
    out = {}
    for k, c in enumerate(component):
        out.setdefault(c, []).append(k)
    return out


def test_a_similar_pair_beyond_three_bits_is_one(spark):
    ws = [f"word{k}" for k in range(100)]
    other = ws[:50] + ["changed"] + ws[51:]
    df = spark.createDataFrame([(1, " ".join(ws)), (2, " ".join(other))], "doc_id long, text string")
    assert S.keep_one(df).count() == 2 and [r.doc_id for r in P.drop_near_duplicates(spark, df, "").collect()] == [1]


def test_corpus_tables(spark, sf):
    docs = read_table(spark, sf, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[k][0] for k in similar_texts([t for _, t in rows])}
    assert {r.doc_id for r in N.keep_one(docs).collect()} == want


def test_odd_rows(spark):
    rows = [(4, "a b c d e f"), (None, "a b c d e f"), (2, None), (2, " "), (7, "x"), (7, "x"), (7, "y"), (None, "only null")]
    got = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, ((r.doc_id, (r.text or "").strip()) for r in got))) == sorted(map(repr, [(4, "a b c d e f"), (2, ""), (7, "x"), (7, "y"), (None, "only null")]))
    assert N.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_names_that_the_stage_uses(spark):
    rows = [(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, "other", 9), (3, "other", 9), (3, "third", 5)]
    names = ("_own", "_n", "_id", "_cls", "row", "first", "digest", "own", "place", "many", "cls", "component")
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").selectExpr("*", *[f"n * {k} AS {c}" for k, c in enumerate(names)])
    got = N.keep_one(df).collect()
    assert sorted((r.doc_id, r.text, r.n) for r in got) == [(1, "a b c d e f", 7), (3, "other", 9), (3, "third", 5)]
    assert all(r[c] == r.n * k for r in got for k, c in enumerate(names))
