import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from logsluice.llm import suffix_dedup as S
from logsluice.llm.queries import QUERIES


def plain(rows, window=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k:k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - window + 1):
            if seen[t[k:k + window]] > 1:
                gone[k + 1:k + 1 + window] = True
        edge = np.flatnonzero(np.diff(gone.astype(np.int8))).tolist()
        spans = list(zip(edge[::2], edge[1::2]))
        kept = bytes(b for b, g in zip(t, gone[1:].tolist()) if not g)
        out.append((i, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans))
    return out


def key(r):
    return repr(r)


def corpus(seed, window):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [fresh(n) for n in (window - 1, window, window + 1, 2 * window, 5 * window)]
    rows = [(0, None), (1, ""), (2, "ab"), (3, "x" * (3 * window)), (4, "xyz" * window), (5, "xyz" * window + "q"), (None, passages[4]), (None, None)]
    for k in range(10, 60):
        parts = [fresh(rng.randrange(2 * window)) for _ in range(3)]
        rows.append((k, rng.choice(passages).join(parts)))
    rows += [(10, rows[10][1]), (70, rows[12][1] + "!"), (71, rows[12][1][7:]), (72, fresh(9 * window) + passages[2] + passages[2])]
    rows += [(100 + k, passages[3]) for k in range(40)]
    return rows


@pytest.mark.parametrize("window,anchor,sizes", (
    (200, 64, {}), (200, 64, dict(pack_bytes=3000, shard_bytes=4000, group_rows=20, memory=900)), (20, 20, dict(pack_bytes=500)), (20, 1, dict(pack_bytes=300, shard_bytes=100)),
))
def test_against_brute_force(spark, window, anchor, sizes):
    rows = corpus(window + anchor, window)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 AS pack", "'b' AS body", "2 AS data")
    got = [(*r[:5], bytes(r.kept), [tuple(s) for s in r.spans]) for r in S.remove_repeated_bytes(df, window, anchor, with_bytes=True, **sizes).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, window), key=key)


def test_segments_cover_all_windows_once():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 10, 199, 200, 201, 900, 3)]
    first, many, named = S.segments(b"".join(texts), np.array([len(t) for t in texts]))
    want, at = [], 0
    for t in texts:
        want += range(at, at + len(t) - 199)
        at += len(t)
    assert [f + k for f, n in zip(first.tolist(), many.tolist()) for k in range(n)] == want
    assert len(named) == len(first) and many.max() <= 200 - 64 + 1


def test_equal_windows_name_equal_anchors(monkeypatch):
    monkeypatch.setattr(S, "_SPAN", 300)
    rng = random.Random(7)
    part = bytes(rng.choice(b"abc") for _ in range(500))
    body = part + b"-" * 450 + part[20:] + b"?"
    first, many, named = S.segments(body, np.array([len(body)]))
    of = {}
    for f, n, a in zip(first.tolist(), many.tolist(), named.tolist()):
        for k in range(f, f + n):
            of.setdefault(body[k:k + 200], set()).add(a)
    assert all(len(v) == 1 for v in of.values())
    dashes = [a for f, n, a in zip(first.tolist(), many.tolist(), named.tolist()) if body[f:f + 200] == b"-" * 200]
    assert len(dashes) > 1  # one anchor at several places, so that a period is found


def test_empty_table_and_bad_anchor(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeated_bytes(df).collect() == []
    with pytest.raises(ValueError):
        S.remove_repeated_bytes(df, 10, 11)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_suffix_dedup"](spark, sf).collect()) == sorted(r[:5] for r in plain(rows))
