"""Quality classifier: a convolution over bytes, in numpy.

Each byte has a short learnt vector; ``FILTERS`` learnt filters look at ``WIDTH`` bytes at a time.
A text is read whole, in chunks that overlap by a filter's width less one, so that every window of
the text lies in one chunk. The largest response of each filter over all chunks goes through a
small dense layer into one probability that the text is good.

The model is fitted on the driver on a bounded sample of labelled texts and sent to the tasks, about
10 kB. Null and empty texts are one padded window and get a score like any other. Repeated rows and
rows sharing an id are scored one by one. Without labels of both kinds every text scores one half
or the only label there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Bounds of the sample that the model is fitted on: documents, and bytes of one document.
TRAIN_ROWS, TRAIN_BYTES = 4096, 1 << 15
FILTERS, WIDTH, DEPTH, HIDDEN = 24, 8, 4, 16
#: Bytes convolved at a time.
CHUNK = 1 << 15
_EPOCHS, _BATCH, _STEP, _DECAY, _SEED = 16, 32, 0.01, 2e-5, 7


@dataclass
class Model:
    bytes_: np.ndarray    # 256 x DEPTH
    filters: np.ndarray   # WIDTH * DEPTH x FILTERS
    bias: np.ndarray      # FILTERS
    hidden: np.ndarray    # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray       # HIDDEN
    out_bias: np.ndarray  # 1

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at every window of ``data`` (bytes)."""
        x = self.bytes_[data]
        windows = np.lib.stride_tricks.sliding_window_view(x.reshape(-1), WIDTH * DEPTH)[::DEPTH]
        return np.ascontiguousarray(windows) @ self.filters

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """The largest response of each filter over each whole text."""
        parts = [_padded(t) for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths) - lengths
        ends = starts + lengths - WIDTH + 1  # windows that begin in the padding belong to no text
        out = np.full((len(parts), FILTERS), -np.inf, np.float32)
        for lo in range(0, len(data) - WIDTH + 1, CHUNK):
            r = self.responses(data[lo:lo + CHUNK + WIDTH - 1])
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, lo + len(r), "left")
            if first < last:
                a, b = np.maximum(starts[first:last] - lo, 0), np.minimum(ends[first:last] - lo, len(r))
                r = np.concatenate([r, np.full((1, FILTERS), -np.inf, np.float32)])  # an end may be that of the chunk
                top = np.maximum.reduceat(r, np.stack([a, b], axis=1).reshape(-1), axis=0)[::2]
                out[first:last] = np.maximum(out[first:last], top)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        top = np.maximum(self.pooled(texts) + self.bias, 0)
        h = np.maximum(top @ self.hidden + self.hidden_bias, 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -60, 60).astype(np.float64)))


def _padded(text: str | None) -> bytes:
    """Every byte of the text begins a window; an empty text has one."""
    return ((text or "").encode() or bytes(1)) + bytes(WIDTH - 1)


def fit(sample: list[tuple[str, int]]) -> Model:
    """Gradient descent on (text, 0 or 1). Of each filter only the window that won the pooling moves it."""
    rng = np.random.default_rng(_SEED)

    def init(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    m = Model(
        (rng.standard_normal((256, DEPTH)) * 0.5).astype(np.float32), init(WIDTH * DEPTH, FILTERS), np.zeros(FILTERS, np.float32),
        init(FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), init(HIDDEN), np.zeros(1, np.float32),
    )
    y = np.array([label for _, label in sample], np.float32)
    if len(set(y.tolist())) < 2:
        m.out[:] = 0
        m.out_bias[:] = 0 if not len(y) else 60 * (2 * y[0] - 1)
        return m
    data = [np.frombuffer(_padded(t), np.uint8) for t, _ in sample]
    params = [m.bytes_, m.filters, m.bias, m.hidden, m.hidden_bias, m.out, m.out_bias]
    m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = _EPOCHS * -(-len(data) // _BATCH)
    for _ in range(_EPOCHS):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), _BATCH):
            t += 1
            batch = order[lo:lo + _BATCH]
            top = np.empty((len(batch), FILTERS), np.float32)
            won = np.empty((len(batch), FILTERS, WIDTH), np.uint8)
            for k, d in enumerate(batch):
                r = m.responses(data[d])
                at = r.argmax(axis=0)
                top[k] = r[at, np.arange(FILTERS)]
                won[k] = data[d][at[:, None] + np.arange(WIDTH)]
            # Forward from the pooled responses, then back.
            a = np.maximum(top + m.bias, 0)
            h = np.maximum(a @ m.hidden + m.hidden_bias, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -60, 60)))
            d_out = (p - y[batch]) / len(batch)
            d_h = d_out[:, None] * m.out * (h > 0)
            d_a = d_h @ m.hidden.T * (a > 0)
            x = m.bytes_[won]                                   # batch, filter, width, depth
            d_filters = np.einsum("bf,bfwd->wdf", d_a, x).reshape(WIDTH * DEPTH, FILTERS)
            d_x = d_a[:, :, None, None] * m.filters.reshape(WIDTH, DEPTH, FILTERS).transpose(2, 0, 1)[None]
            d_bytes = np.zeros_like(m.bytes_)
            np.add.at(d_bytes, won.reshape(-1), d_x.reshape(-1, DEPTH))
            grads = [d_bytes, d_filters, d_a.sum(axis=0), a.T @ d_h, d_h.sum(axis=0), h.T @ d_out, d_out.sum(keepdims=True)]
            rate = _STEP * (1 - 0.9 * t / steps)
            for q, g, u, v in zip(params, grads, m1, m2):
                g = g + _DECAY * q
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                q -= (rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return m


def score_documents(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row and its score; a kept column of that name is replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A few texts at a time, so that memory follows the longest text only.
            scores, some, size = [], [], 0
            for t in b.column(0):
                some.append(t.as_py())
                size += len(some[-1] or "")
                if size > CHUNK:
                    scores.append(model.scores(some))
                    some, size = [], 0
            scores.append(model.scores(some))
            yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(np.concatenate(scores))], out.fieldNames())

    kept = documents.select([c for c in keep if c != "score"])
    out = T.StructType(kept.schema.fields + [T.StructField("score", T.DoubleType())])
    return documents.select(F.col(text).alias("_text"), *kept.columns).mapInArrow(run, out)
