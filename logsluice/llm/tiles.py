"""Compare the rows of a tile with each other and with its visitors, a batch at a time.

A tile's own rows ("home") are few by construction and are held; visitors, of which there may be
many, stream past them in batches. Both arrive sorted by tile with the home rows first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of a comparison matrix held at a time.
CELLS = 1 << 21


def compare_in_tiles(rows: DataFrame, keys: list[str], compare: Callable, schema: str) -> DataFrame:
    """``rows`` has ``keys``, ``role`` (0 home, 1 visitor) and data columns.

    ``compare(key, home, visitors)`` gets dictionaries of arrays; ``visitors`` is None once for the home
    rows among themselves. It yields record batches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, home = None, [], None

        def closed():
            nonlocal home, parts
            home, parts = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, []
            yield from compare(key, home, None)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: _array(batch.column(c)) for c in batch.schema.names}
            tags = np.stack([cols.pop(k) for k in keys] + [cols.pop("role")], axis=1)
            cuts = np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(tags)]):
                here, role = tuple(tags[lo, :-1]), tags[lo, -1]
                part = {c: v[lo:hi] for c, v in cols.items()}
                if here != key:
                    if parts:
                        yield from closed()
                    key, parts, home = here, [], None
                if role == 0:
                    parts.append(part)
                    continue
                if parts:
                    yield from closed()
                if home is not None:
                    yield from compare(key, home, part)
        if parts:
            yield from closed()

    ready = rows.repartition(*keys).sortWithinPartitions(*keys, "role")
    return ready.mapInArrow(run, schema)


def _array(column: pa.Array) -> np.ndarray:
    """Numbers as they are; lists of equal length as an array of objects per row."""
    if pa.types.is_list(column.type):
        out = np.empty(len(column), dtype=object)
        flat, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        for i in range(len(column)):
            out[i] = flat[off[i]:off[i + 1]]
        return out
    return column.to_numpy(zero_copy_only=False)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, label) that connect what the pairs (i, j) of 0..n-1 connect; fewer than n."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]
