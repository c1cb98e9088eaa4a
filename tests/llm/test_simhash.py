import random

import pytest
from pyspark.sql import functions as F

from logsluice.llm import simhash as S
from helpers import near_components, rows_of, simhash, union_find


def test_fingerprint_of_whole_texts():
    rng = random.Random(1)
    long_text = " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(70_000))
    for text in (None, "", " \t\n", "One", "one TWO", "Ünï CAFÉ ÀB", "a b c d e f", "x " * 50, "a\x0bb\x0cc\xa0d e", long_text[:4000]):
        assert S.fingerprint(text) == simhash(text)
    old, S._CHUNK = S._CHUNK, 100
    try:
        assert S.fingerprint(long_text[:4000]) == simhash(long_text[:4000])
    finally:
        S._CHUNK = old


def test_edges_connect_what_lies_within_the_radius(spark):
    rng = random.Random(5)
    prints = [0, 1, (1 << 64) - 1, 1 << 63, 7, 15]
    for _ in range(60):
        f = rng.getrandbits(64)
        prints.append(f)
        for _ in range(rng.randrange(6)):  # chains, so that components are wider than the radius
            for _ in range(rng.choice((1, 2, 3, 4))):
                f ^= 1 << rng.randrange(64)
            prints.append(f)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for tile_rows in (8192, 1):
        edges = S.near_edges(spark.createDataFrame([(p,) for p in signed], "fp long"), tile_rows=tile_rows).collect()
        at = {p: k for k, p in enumerate(signed)}
        assert union_find(len(prints), [(at[e.a], at[e.b]) for e in edges]) == near_components(prints)


def test_rows_with_nulls_ties_and_clashing_columns(spark):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(4, text), (2, text + " "), (2, text + " "), (9, None), (7, ""), (None, " \n"), (None, "alone here now"), (8, "Alone HERE now too")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "fingerprint": F.lit("x"), "first": F.lit(2)})
    ids, prints = [r[0] for r in rows], [simhash(r[1]) for r in rows]
    component = near_components(prints)
    least = {}
    for i, c in zip(ids, component):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted([(i, f"{p:016x}", least.get(c)) for i, p, c in zip(ids, prints, component)], key=repr)
    assert rows_of(S.simhash_components(df)) == want
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted({least.get(c, -1) for c in component})


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(S.simhash_components(empty)) == [] and rows_of(S.keep_one(empty)) == []


def test_query_against_brute_force(spark, sf):
    from logsluice.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [simhash(d.text) for d in docs]
    component = near_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, sf).collect()}
    assert got == {d.doc_id: (f"{p:016x}", docs[c].doc_id) for d, p, c in zip(docs, prints, component)}


def test_radius_limit(spark):
    with pytest.raises(ValueError):
        S.near_edges(spark.createDataFrame([(1,)], "fp long"), radius=5)
