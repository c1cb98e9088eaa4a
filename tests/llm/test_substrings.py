import random

import numpy as np
import pytest

from logsluice.llm import substrings as S
from helpers import removed_words, rows_of, substring_rows


def span(a, b):
    return " ".join(f"w{k}" for k in range(a, b))


HAND = [
    (5, span(0, 100)), (1, span(50, 90)), (2, None), (3, ""), (4, span(0, 19)), (6, span(0, 20) + " " + span(0, 20)), (None, span(60, 85)),
    (16, span(200, 240)), (16, span(200, 240)), (7, "x " * 100), (8, "a\tb\x0bc\xa0d  e\n" * 30), (9, "y" * 3000 + " " + span(0, 30)), (10, " \n\t"),
]


@pytest.mark.parametrize("pack_bytes,group_rows", [(1 << 22, 1 << 21), (300, 16), (1, 1)])
def test_hand_made_rows(spark, pack_bytes, group_rows):
    df = spark.createDataFrame(HAND, "doc_id long, text string").repartition(3)
    got = rows_of(S.remove_repeats(df, pack_bytes=pack_bytes, group_rows=group_rows))
    assert got == sorted(substring_rows(HAND), key=repr)


def test_random_passages_and_kept_columns(spark):
    rng = random.Random(8)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    rows = []
    for k in range(60):
        ws = []
        for _ in range(rng.randrange(4)):
            ws += rng.choice(passages) if rng.random() < 0.6 else [str(rng.random()) for _ in range(rng.randrange(30))]
        rows.append((k, " ".join(ws), f"lang{k % 3}", k))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long")
    out = S.remove_repeats(df, pack_bytes=2000, group_rows=200, with_text=True, keep=("lang", "n_words")).collect()
    want = {i: (ws, flags) for i, ws, flags in removed_words([r[:2] for r in rows])}
    assert len(out) == len(rows) and any(r.n_removed for r in out)
    for r in out:
        ws, flags = want[r.doc_id]
        assert r.lang == f"lang{r.doc_id % 3}" and r.n_words == len(ws) and r.n_removed == sum(flags)
        assert r.kept_text == (" ".join(w for w, f in zip(ws, flags) if not f) if r.n_removed else rows[r.doc_id][1])
        covered = [k for s in r.spans for k in range(s["first"], s["end"])]
        assert covered == [k for k, f in enumerate(flags) if f]


def test_word_hashes_do_not_depend_on_spans(monkeypatch):
    text = (" ".join(f"word{k}" for k in range(500)) + "  " + "z" * 700 + "\n" + "é ü  " * 30).encode()
    whole = S.word_hashes(text)
    monkeypatch.setattr(S, "_SPAN", 400)
    cut = S.word_hashes(text)
    assert len(whole) == len(text.split()) == len(cut)
    short = np.array([len(w) < 400 for w in text.split()])
    assert (whole[short] == cut[short]).all()  # a word longer than a span has a hash of its own kind
    assert len(set(whole.tolist())) == len(set(text.split()))


def test_empty_table_and_parameters(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(S.remove_repeats(empty)) == []
    with pytest.raises(ValueError):
        S.remove_repeats(empty, window=8, anchor=6)


def test_query(spark, sf):
    from logsluice.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op8_substrings"](spark, sf)) == sorted(substring_rows(docs), key=repr)
