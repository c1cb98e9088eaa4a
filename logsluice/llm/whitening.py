"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Entries become whole numbers ``floor(scale * c)``. The fit list holds each distinct whole-number vector once.

1. Sums. Tasks add up the fit list's vectors exactly; count and sums give the mean.
2. Scatter. Tasks centre the vectors at the whole number next to the mean and add up their products,
   exactly too; what the rounded centre leaves is taken off afterwards, in whole numbers. Each task sends one row
   per entry of the matrix and 40 bits, so that no sum can overflow, and sums don't depend on the order of tasks.
3. Factor, on the driver, of a matrix of dimension x dimension: Cholesky with the largest remaining diagonal
   as the next pivot stops at the rank. One-sided Jacobi rotates the columns of the triangular factor
   until they are orthogonal: their squared norms are the eigenvalues, the normalised columns the components. The
   covariance itself is never diagonalised, which keeps small eigenvalues accurate.
4. Projection of every row, and a pass over the fit list that measures how white it became.

Rows whose vector is null or holds null or non-finite entries are dropped. So are vectors that are empty or not of the
commonest length (of equally common ones the longest), as they share no covariance with the rest. Components end at the rank: a table
with fewer distinct vectors than components gives fewer rows, and none for a single distinct vector. Entries outside the
64-bit range are taken to its ends. ``deviation`` is null where it exceeds 64 bits. Repeated rows and rows sharing an id are
rows of their own; a null id stays. Equal eigenvalues take any basis of their space. Extra columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop_shared, write_shared

SCALE, COMPONENTS = 256, 4
#: Vectors multiplied at a time.
_ROWS = 4096
#: Bits of a part of an exact sum; a part of a task's sum stays far from 64 bits when tasks are added up.
_PART = 40
_LIMIT = 1 << 63
_EPS = np.finfo(np.float64).eps


@dataclass
class Whitening:
    """What a fit learns; ``components`` has one column per component, by falling eigenvalue."""

    n: int
    sums: list[int]
    #: The mean as whole numbers and what they leave of it, which keeps digits far from the origin.
    centre: list[int]
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return (_less(x, self.centre).astype(np.float64) - self.rest) @ self.components / np.sqrt(self.eigenvalues)


def _less(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """``x`` less whole numbers, in 64 bits where these suffice."""
    high = float(np.abs(x.astype(np.float64)).max(initial=0.0)) + max(map(abs, centre))
    return x - np.array(centre, np.int64) if high < 2.0**62 else x.astype(object) - np.array(centre, dtype=object)


def whole(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * c)`` of finite numbers as 64-bit ones."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * flat.astype(np.float64))
    out = np.clip(y, -float(_LIMIT), float(_LIMIT - 1024)).astype(np.int64)
    out[y >= _LIMIT] = _LIMIT - 1
    return out


def _finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the lists without null or non-finite entries, the lengths of all (0 for null), and the entries of these lists."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    start, end = (column.offsets[0].as_py(), column.offsets[-1].as_py()) if len(column) else (0, 0)
    flat = column.values.slice(start, end - start).to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    row = np.repeat(np.arange(len(column)), sizes)
    bad = np.bincount(row[~np.isfinite(flat)], minlength=len(column)) > 0
    good = ~(bad | column.is_null().to_numpy(zero_copy_only=False) | (sizes == 0))
    return np.flatnonzero(good), np.where(good, sizes, 0), flat[good[row]]


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest whole numbers that hold it: equal rows are equal bytes of one length."""
    size = np.abs(x.astype(np.float64)).max(axis=1)
    out: list[bytes] = [b""] * len(x)
    kinds = [(np.int8, 120.0), (np.int16, 32000.0), (np.int32, 2e9), (np.int64, np.inf)]
    done = np.zeros(len(x), bool)
    for kind, most in kinds:
        some = np.flatnonzero(~done & (size <= most))
        done[some] = True
        raw, width = x[some].astype(kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
        for k, r in enumerate(some.tolist()):
            out[r] = raw[k * width:(k + 1) * width]
    return out


def _unpack(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.int64)
    width = np.array([len(r) // dim for r in rows])
    for w, kind in ((1, np.int8), (2, np.int16), (4, np.int32), (8, np.int64)):
        at = np.flatnonzero(width == w)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[k] for k in at.tolist()), kind).reshape(-1, dim)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for b in batches:
        column = b.column(0)
        for lo in range(0, len(column), _ROWS):
            yield _unpack(column.slice(lo, _ROWS).to_pylist(), dim)


def _exact(values: np.ndarray, top: float) -> np.ndarray:
    """``values`` in a type that holds sums of ``top`` exactly: doubles, 64-bit or Python's own whole numbers."""
    return values.astype(np.float64) if top < 2.0**53 else values if top < 2.0**62 else values.astype(object)


def _add(total: np.ndarray, part: np.ndarray) -> None:
    total += np.asarray(part, dtype=object) if part.dtype == object else part.astype(np.int64).astype(object)


def _parts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(k, part, v): entry k of a task's sums, cut in parts; zeros are left out."""
    rows = []
    for k, v in enumerate(total.ravel().tolist()):
        sign, v, part = (-1 if v < 0 else 1), abs(int(v)), 0
        while v:
            rows.append((k, part, sign * (v & ((1 << _PART) - 1))))
            v, part = v >> _PART, part + 1
    k, part, v = zip(*rows) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(part, pa.int32()), pa.array(v, pa.int64())], ["k", "part", "v"])


def _total(tasks: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks, as whole numbers of any size; one row per entry and part comes to the driver."""
    out = np.zeros(shape, dtype=object)
    flat = out.reshape(-1)
    for r in tasks.groupBy("k", "part").agg(F.sum("v").alias("v")).collect():
        flat[r.k] += int(r.v) << (_PART * r.part)
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G of full column rank with G G' = a, for a positive semidefinite matrix; rows stand in their own order.

    Up to a permutation of its rows G is lower triangular.
    """
    left, diagonal = [], a.diagonal().copy()
    floor = len(a) * _EPS * max(diagonal.max(initial=0.0), 0.0)
    free = np.ones(len(a), bool)
    while free.any():
        p = int(np.argmax(np.where(free, diagonal, -1.0)))
        if diagonal[p] <= floor:
            break
        g = np.array(left)
        column = (a[:, p] - (g.T @ g[:, p] if left else 0.0)) / np.sqrt(diagonal[p])
        column[~free] = 0.0  # earlier pivots are met exactly
        column[p] = np.sqrt(diagonal[p])
        free[p] = False
        diagonal = diagonal - column**2
        left.append(column)
    return np.array(left).T if left else np.zeros((len(a), 0))


def one_sided_jacobi(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``g`` with its columns rotated until all are orthogonal; disjoint pairs of columns are rotated at once."""
    g, n = g.copy(), g.shape[1]
    if n < 2:
        return g
    m = n + n % 2
    seats = np.arange(m)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(m - 1):
            p, q = seats[:m // 2], seats[m // 2:][::-1]
            real = (p < n) & (q < n)
            p, q = p[real], q[real]
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(a * b)
            off = np.abs(c) / np.where(scale > 0, scale, 1.0)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > _EPS
            zeta = (b - a) / np.where(turn, 2.0 * c, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            cos = 1.0 / np.hypot(1.0, t)
            g[:, p], g[:, q] = cos * (x - t * y), cos * (t * x + y)
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])  # a round of all pairs takes m - 1 turns
        if worst <= 4 * _EPS:
            break
    return g


def principal(scatter: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` components as columns and their eigenvalues (of scatter / n), fewer if the rank is less.

    The largest entry of a component (of equal ones the first) is positive.
    """
    g = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = (g * g).sum(axis=0)
    order = np.argsort(-norms, kind="stable")[:count]
    order = order[norms[order] > 0]
    components = g[:, order] / np.sqrt(norms[order])
    sign = np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(order))]) if len(order) else 1.0
    return components * sign, norms[order] / n


def _numbered(embeddings: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))


def fit_list(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """(x): every distinct vector once, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, sizes, flat = _finite(b.column(0))
            at = np.repeat(sizes, sizes) == dim
            x = whole(flat[at], scale).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array(_pack(x) if len(x) else [], pa.binary())], ["x"])

    return rows.select("v").mapInArrow(run, "x binary").distinct()


def _sums(fit: DataFrame, dim: int) -> np.ndarray:
    """The count and the sums of the fit list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, dtype=object)
        for x in _blocks(batches, dim):
            top = float(np.abs(x.astype(np.float64)).max()) * len(x)
            _add(total, np.concatenate([[len(x)], _exact(x, top).sum(axis=0)]))
        yield from _parts(total)

    return _total(fit.mapInArrow(run, "k int, part int, v long"), (dim + 1,))


def _scatter(fit: DataFrame, centre: list[int]) -> np.ndarray:
    """The sum over the fit list of (y, 1) (y, 1)' with y the vector less ``centre``."""
    dim = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1), dtype=object)
        for x in _blocks(batches, dim):
            y = _less(x, centre)
            top = max(float(np.abs(y).max()), 1.0)
            y = np.concatenate([y, np.ones((len(y), 1), y.dtype)], axis=1)
            y = _exact(y, top * top * len(y))
            _add(total, y.T @ y)
        yield from _parts(np.triu(total))

    half = _total(fit.mapInArrow(run, "k int, part int, v long"), (dim + 1, dim + 1))
    return half + np.triu(half, 1).T


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened fit list differs from the identity."""
    dim, count = model.components.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(count), np.zeros((count, count))
        for x in _blocks(batches, dim):
            w = model.project(x)
            first += w.sum(axis=0)
            second += w.T @ w
        v = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], ["k", "v"])

    # Whitened vectors are centred already; their own mean, a rounding error, is taken off as well.
    sums = np.zeros(count * (count + 1))
    for r in fit.mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[r.k] = r.v
    mean, second = sums[:count] / model.n, sums[count:].reshape(count, count) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(count)).max(initial=0.0))


def _dimension(rows: DataFrame) -> int:
    """The commonest length of the vectors without null or non-finite entries; 0 if there is none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, many = np.unique(_finite(b.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(many, pa.int64())], ["dim", "many"])

    counts = rows.select("v").mapInArrow(run, "dim long, many long").where("dim > 0").groupBy("dim").agg(F.sum("many").alias("many"))
    most = counts.orderBy(F.desc("many"), F.desc("dim")).first()
    return most.dim if most else 0


def fit(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> Whitening | None:
    """A whitening of the distinct vectors; None if there is no vector at all."""
    rows = _numbered(embeddings, vec_id, embedding)
    dim = _dimension(rows)
    if not dim:
        return None
    listed = write_shared(fit_list(rows, dim, scale), "fit-list")
    n, *sums = _sums(listed, dim).tolist()
    centre = [(2 * s + n) // (2 * n) for s in sums]
    second = _scatter(listed, centre)
    rest = second[:dim, dim]  # the sums of what the rounded centre leaves, at most n / 2 each
    exact = second[:dim, :dim] * n - np.outer(rest, rest)  # n times the centred scatter
    scatter = np.array([[v / n for v in row] for row in exact.tolist()])  # whole numbers divide with one rounding
    columns, eigenvalues = principal(scatter, n, components)
    trace = sum(exact.diagonal().tolist()) / (n * n)
    model = Whitening(n, sums, centre, np.array([(s - n * c) / n for s, c in zip(sums, centre)]), columns, eigenvalues, trace)
    model.identity_error = _identity_error(listed, model)
    drop_shared(listed)
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the sum of (n * x - S) ** 2, exactly."""
    top = max(float(np.abs(x.astype(np.float64)).max(initial=0.0)) * n, *[abs(float(s)) for s in sums]) * 2
    if top * top * len(sums) < 2.0**62:
        return ((n * x - np.array(sums, np.int64))**2).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(sums, dtype=object)
    return [v if v < _LIMIT else None for v in (y * y).sum(axis=1).tolist()]


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per remaining row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _numbered(embeddings, vec_id, embedding)
    model = fit(embeddings, components, scale, vec_id, embedding)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim, count = model.components.shape
    explained = model.eigenvalues / model.trace if count else model.eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, _ROWS):
                b = whole_batch.slice(lo, _ROWS)
                at, sizes, flat = _finite(b.column(1))
                fits = sizes[at] == dim
                x = whole(flat[np.repeat(fits, sizes[at])], scale).reshape(-1, dim)
                at = np.repeat(at[fits], count)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(at), model.n), pa.int64()),
                    pa.array([d for d in deviations(x, model.n, model.sums) for _ in range(count)], pa.int64()),
                    pa.array(model.project(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), model.identity_error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
