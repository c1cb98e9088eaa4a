"""The learnt operators: accuracy on rows they never saw, and inputs they must survive."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsluice.llm import quality_model, toxicity
from logsluice.llm.common import labelled_sample
from logsluice.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    scored = QUERIES[query](spark, SF).cache()
    assert scored.where("score < 0 OR score > 1 OR score IS NULL OR predicted != CAST(score >= 0.5 AS INT)").count() == 0
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", "y").collect()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r.y for r in rows])


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
@pytest.mark.parametrize("query,label,accuracy", [("op1_quality_model", "quality", 0.95), ("op6_toxicity", "toxic", 0.97)])
def test_accuracy_on_the_held_out_fold(spark, query, label, accuracy):
    score, predicted, y = held_out(spark, query, label)
    assert len(y) > 500 and (predicted == y).mean() >= accuracy
    assert score[y == 1].mean() - score[y == 0].mean() > 0.6
    if label == "toxic":
        toxic = QUERIES[query](spark, SF).where("predicted = 1").select("sentences").collect()
        assert sum(len(r.sentences) > 0 for r in toxic) > 0.8 * len(toxic) > 0


TRAIN = [(f"A calm text number {k} about rivers. It goes on.", 0) for k in range(60)] + [
    (f"A calm text number {k}. You are a moron and a clown. It goes on.", 1) for k in range(30)
]


def test_toxic_sentences_are_found():
    m = toxicity.fit(TRAIN)
    text = "Rivers are long. What a MORON, really! Clowns and text."
    assert m.score(text) > 0.9 and m.offending(text)[0].strip() == "What a MORON, really"
    assert m.score("Rivers go far. Text on rivers. " * 20_000) < 0.2  # length alone is no sign
    for t in (None, "", " .\n!", "..."):
        assert m.score(t) == m.score("") < 0.5 and m.offending(t) == []


def test_noisy_or_of_sentences():
    m = toxicity.Model({"bad$": 2.0}, -2.0, -30.0)
    assert m.score("bad") == pytest.approx(0.5) and m.score("bad. bad\nBAD!") == pytest.approx(0.875) and m.score("good") < 1e-9


def test_toxicity_against_a_plain_noisy_or(spark, sf):
    """Sentence scores from features one by one, over the whole corpus, and the sentences that the query names."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    m = toxicity.fit([(t, labels[i]) for i, t in docs if labels.get(i) in (0, 1) and t is not None])
    sigmoid = lambda z: 1 / (1 + np.exp(-np.longdouble(z)))
    for _, t in docs:
        clean, named = 1 - sigmoid(m.leak), []
        for s in toxicity.sentences(t):
            ws = [m.weights[f] for w in s.split() for f in toxicity.word_features(w) if f in m.weights]
            if any(ws):
                p = sigmoid(m.bias + sum(ws))
                clean *= 1 - p
                named += [s] if p >= toxicity.OFFENDS else []
        assert m.score(t) == pytest.approx(float(1 - clean), abs=1e-9) and m.offending(t) == named
    rows = QUERIES["op6_toxicity"](spark, sf).collect()
    assert all(r.predicted for r in rows if len(r.sentences) > 0)


def test_quality_against_a_plain_convolution(spark, sf):
    """Every window of every whole text multiplied out, its greatest response taken per filter."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    m = quality_model.fit([(t, k % 2) for k, (_, t) in enumerate(docs[:40]) if t])
    texts = [t for _, t in docs] + [None, "", "é", "x" * 70_000]
    got = m.scores(texts)
    for k, t in enumerate(texts):
        data = np.frombuffer((t or "").encode() or b"\0", np.uint8)
        x = m.bytes_[np.concatenate([data, np.zeros(quality_model.WIDTH - 1, np.uint8)])]
        top = np.full(m.filters.shape[1], -np.inf)
        for lo in range(0, len(data), 4096):
            some = x[lo:lo + 4096 + quality_model.WIDTH - 1]
            n = min(4096, len(data) - lo)
            flat = np.concatenate([some[w:w + n] for w in range(quality_model.WIDTH)], axis=1)
            top = np.maximum(top, (flat @ m.filters).max(axis=0))
        h = np.maximum(np.maximum(top + m.bias, 0) @ m.hidden + m.hidden_bias, 0)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(h @ m.out + m.out_bias)[()])), abs=1e-4)


def test_pooling_reads_whole_texts(monkeypatch):
    m = quality_model.fit([("good words here " * 5, 1), ("%%%% ### " * 9, 0)] * 20)
    texts = ["x" * 700 + "%%%% ### " + "y" * 900, "", None, "short", "good words here " * 40, "%%%% ### "]
    whole = m.pooled(texts)
    for k, t in enumerate(texts):
        assert np.allclose(m.pooled([t]), whole[k:k + 1], atol=1e-4)
    monkeypatch.setattr(quality_model, "CHUNK", 50)
    assert np.allclose(m.pooled(texts), whole, atol=1e-4)
    assert m.scores(texts)[4] > 0.5 > m.scores(texts)[5]


@pytest.mark.parametrize("model", [toxicity, quality_model])
def test_rows_without_labels_or_texts(spark, model):
    m = model.fit([])
    rows = [(1, None), (1, None), (None, ""), (2, "é" * 200_000), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "other": F.lit(7)})
    out = model.score_documents(df, m, keep=tuple(df.columns)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.other == 7 for r in out)
    assert model.score_documents(df.limit(0), m).collect() == []
    assert all(0 <= r.score <= 1 for r in model.score_documents(df, model.fit([("only one kind", 1)])).collect())


def test_sample_of_labels(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)] + [(7, "again"), (None, "x"), (51, None)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(k, k % 2) for k in range(60)] + [(4, 1), (6, 0), (6, 0), (None, 1), (8, None), (10, 5)], "doc_id long, toxic int"
    )
    import zlib

    sample = labelled_sample(docs, labels, "toxic", 5, 0, 1000, 1000)
    learnt = {int(t.split()[1]) for t, _ in sample if t.startswith("text")}
    assert learnt == {k for k in range(50) if zlib.crc32(str(k).encode()) % 5 and k not in (4,)}
    assert all(y == int(t.split()[1]) % 2 for t, y in sample if t.startswith("text"))
    assert len(labelled_sample(docs, labels, "toxic", 5, 0, 9, 1000)) <= 9
