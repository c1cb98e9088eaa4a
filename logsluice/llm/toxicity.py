"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic function of the sum of weights of its words and of the first
letters of its words; a document is toxic if any sentence is, so its probability is the noisy-or of
its sentences' scores. The weights are learnt from document labels alone, through the noisy-or,
on a bounded sample of labelled documents. Scoring then also tells which sentences offend.

Null and blank texts have no sentence and get the score of a document as such. Texts are scored whole, in one pass, with memory
for one sentence at a time beside the text. Repeated rows and rows sharing an id are scored
one by one. Without labels the model is empty and every text scores 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Bounds of the sample that the model is fitted on: documents, and bytes of one document.
TRAIN_ROWS, TRAIN_BYTES = 6144, 1 << 16
#: Letters from the start of a word that are features beside the word.
PREFIXES = (4, 5, 6)
#: A feature is used if it occurs in so many toxic documents of the sample, and in so many standard
#: deviations more of them than its documents would hold by chance.
MIN_DOCS, MIN_SIGMAS = 4, 6.0
#: A sentence from this score on offends.
OFFENDS = 0.5
_ROUNDS, _STEP, _L2 = 200, 0.1, 0.01
_REMEMBERED = 1 << 17

_SENTENCE = re.compile(r"[.!?\n]+")
_EDGES = ".,;:!?\"'()[]{}<>«»“”„…*#$%&|-_"


def sentences(text: str | None) -> Iterator[str]:
    """Stretches with a word between full stops, exclamation and question marks and line feeds."""
    start = 0
    text = text or ""
    for m in _SENTENCE.finditer(text):
        if text[start:m.start()].strip():
            yield text[start:m.start()]
        start = m.end()
    if text[start:].strip():
        yield text[start:]


def word_features(word: str) -> list[str]:
    w = word.strip(_EDGES).lower()
    return [w + "$"] + [w[:n] for n in PREFIXES if len(w) >= n] if w else []


@dataclass
class Model:
    """Weights of features, the logit they are added to, and the logit of a document as such.

    A sentence without a weighted feature adds nothing, so a text doesn't turn toxic by its length.
    """

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    leak: float = -math.inf

    def __post_init__(self):
        self._words: dict[str, float] = {}

    def _word(self, word: str) -> float:
        w = sum(self.weights.get(f, 0.0) for f in word_features(word))
        if len(self._words) >= _REMEMBERED:
            self._words.clear()
        self._words[word] = w
        return w

    def logit(self, sentence: str) -> float:
        """-inf for a sentence without any weighted feature: it can't offend."""
        known, total, found = self._words, self.bias, False
        for w in sentence.split():
            x = known.get(w)
            x = self._word(w) if x is None else x
            if x:
                total, found = total + x, True
        return total if found else -math.inf

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]

    def judge(self, text: str | None, at: float = OFFENDS) -> tuple[float, list[str]]:
        """The noisy-or of the leak and the sentences' scores, and the sentences that score ``at`` or more."""
        log_clean, limit, found = -_softplus(self.leak), math.log(at / (1 - at)), []
        for s in sentences(text):
            z = self.logit(s)
            if z > -math.inf:
                log_clean -= _softplus(z)
                if z >= limit:
                    found.append(s)
        return -math.expm1(log_clean), found

    def offending(self, text: str | None, at: float = OFFENDS) -> list[str]:
        return self.judge(text, at)[1]


def _softplus(z: float) -> float:
    """-log(1 - p) of a logit: what a sentence adds to the evidence."""
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(max(z, -745.0)))


def fit(sample: list[tuple[str, int]]) -> Model:
    """Weights from (text, 0 or 1), by gradient steps on the likelihood of the noisy-or."""
    y = np.array([label for _, label in sample])
    if len(set(y.tolist())) < 2:
        return Model()
    in_toxic: Counter = Counter()
    in_any: Counter = Counter()
    for text, label in sample:
        own = {f for w in set(text.split()) for f in word_features(w)}
        in_any.update(own)
        if label:
            in_toxic.update(own)
    rate = y.mean()
    names = [
        f for f, n in sorted(in_toxic.items())
        if n >= MIN_DOCS and n - in_any[f] * rate >= MIN_SIGMAS * math.sqrt(in_any[f] * rate * (1 - rate))
    ]
    index = {f: k for k, f in enumerate(names)}
    col, row, doc = [], [], []
    for d, (text, _) in enumerate(sample):
        for s in sentences(text):
            ks = [index[f] for w in s.split() for f in word_features(w) if f in index]
            if ks:
                col += ks
                row += [len(doc)] * len(ks)
                doc.append(d)
    col, row, doc = np.array(col, np.int64), np.array(row, np.int64), np.array(doc, np.int64)
    n, k = len(sample), len(names)
    x = np.append(np.zeros(k), [-3.0, -4.0])  # weights, bias, leak
    m1, m2 = np.zeros(k + 2), np.zeros(k + 2)
    for t in range(1, _ROUNDS + 1):
        z = x[k] + np.bincount(row, x[col], minlength=len(doc))
        evidence = np.bincount(doc, np.logaddexp(0, z), minlength=n) + np.logaddexp(0, x[k + 1])
        # Slope of the loss by the evidence e: 1 for clean documents, -1 / (exp(e) - 1) for toxic ones.
        pull = np.where(y == 1, -1 / np.expm1(np.clip(evidence, 1e-9, 50)), 1.0)
        g = pull[doc] / (1 + np.exp(-z))
        grad = np.concatenate([
            np.bincount(col, g[row], minlength=k) + _L2 * x[:k], [g.sum(), pull.sum() / (1 + np.exp(-x[k + 1]))]
        ]) / n
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        x -= _STEP * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-10)
    return Model({f: float(v) for f, v in zip(names, x[:k]) if v}, float(x[k]), float(x[k + 1]))


def score_documents(
    documents: DataFrame, model: Model, with_sentences: bool = False, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """The columns ``keep`` of each row and its score, and the offending sentences where asked for.

    Kept columns called score or sentences are replaced.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)  # taken one at a time, as a batch of texts is large
            scores, found = [], []
            for t in texts:
                score, some = model.judge(t.as_py())
                scores.append(score)
                if with_sentences:
                    found.append(some)
            columns = b.columns[1:] + [pa.array(scores, pa.float64())]
            if with_sentences:
                columns.append(pa.array(found, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, out.fieldNames())

    kept = documents.select([c for c in keep if c not in ("score", "sentences")])
    out = T.StructType(kept.schema.fields + [T.StructField("score", T.DoubleType())])
    if with_sentences:
        out = out.add("sentences", T.ArrayType(T.StringType()))
    return documents.select(F.col(text).alias("_text"), *kept.columns).mapInArrow(run, out)
