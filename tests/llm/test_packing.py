import random
import zlib

import numpy as np
import pytest

from logsluice.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    None, "", " ", "  x", "x  ", "\n\n a \n", "a  b\n\n c \x1c d\x85e  f", "it's we'll 3½² ok\u3000z\xa0q", "<|endoftext|> a  <|endoftext|>b",
    "é日本語 𝔘 " * 40, "z" * 5000, "a\tb\x0bc\r\nd", "\u2028x\u200b y", "'s 's's",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_file(reference, monkeypatch):
    rng = random.Random(6)
    alphabet = ["a", "b", " ", " ", "\n", "'s", "1", ".", "é", "\u3000", "\t", "日", "#", "X"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(200)]
    e = P.Encoder(PATH)
    for t in texts:
        assert e.ids(t).tolist() == reference(t), t
    monkeypatch.setattr(P, "_SPAN", 37)
    monkeypatch.setattr(P, "_REMEMBERED", 20)
    e = P.Encoder(PATH)
    for t in texts:
        assert e.ids(t).tolist() == reference(t), t


def check(rows, texts, reference, capacity):
    ids = {k: reference(t) + [1] for k, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert 0 < r.length and r.doc_tokens == len(ids[r.doc_id])
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for k, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[k])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding, sum(map(len, ids.values()))


@pytest.mark.parametrize("capacity,classes", [(2048, 8), (64, 8), (64, 1), (8, 3), (1, 1)])
def test_round_trip(spark, reference, capacity, classes):
    rng = random.Random(capacity)
    texts = dict(enumerate(ODD + [" ".join(rng.choice(["the", "cat", "sat"]) for _ in range(rng.randrange(400))) for _ in range(60)]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = P.pack_documents(df, PATH, capacity=capacity, whole_classes=classes, with_ids=True).collect()
    padding, total = check(rows, texts, reference, capacity)
    assert padding <= 0.01 * total
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, "the cat"), (None, None)]
    out = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id or -1 for r in out if r.start == 0)) == [-1, -1, 1, 1]
    assert sum(r.length for r in out) == 3 * 3 + 1


def test_empty_table_and_capacity(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    with pytest.raises(ValueError):
        P.Packer(0, 100, 8, 0.0)


def test_query(spark, sf, reference):
    from logsluice.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    padding, total = check(QUERIES["op7_packing"](spark, sf).collect(), texts, reference, 2048)
    assert padding <= 0.01 * total
