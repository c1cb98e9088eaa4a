"""A trigger's rows of one key in order, however many there are.

Spark hands them over in frames without an order, row by row through Python: ``packed`` makes one row of many before that. Frames are put together up to a bound on rows and bytes; what that holds is sorted where it is. More
than that become sorted runs in the state store, cut into chunks, and are merged chunk by chunk, so many at a time: with more runs some are first
merged into longer ones. Each row is then written and read as often as there are levels; nothing is left in the store when the trigger ends.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming import StatefulProcessorHandle

#: Rows of a chunk at most, and about how many bytes; a merge holds one chunk of each run.
CHUNK, CHUNK_BYTES = 2048, 1 << 19
#: Rows and bytes that are sorted at once.
RUN_ROWS, RUN_BYTES = 1 << 16, 1 << 25
#: Bytes of one packed row, about.
PACKED_BYTES = 1 << 20
#: Runs that are merged at once.
FAN_IN = 64


def _pack(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _table(frame: pd.DataFrame | pa.Table) -> pa.Table:
    if isinstance(frame, pa.Table):
        return frame
    return pa.Table.from_pandas(frame, preserve_index=False, nthreads=1).replace_schema_metadata(None)


def _joined(tables: list[pa.Table]) -> pa.Table:
    """The tables one after the other; a column without a value in one of them has the type that it has in others."""
    return pa.concat_tables(tables, promote_options="permissive") if len(tables) > 1 else tables[0]


def _sorted(table: pa.Table, order: list[str]) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order]))


def packed(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows (key, ``rows``), each with many rows of its key, which ``unpacked`` gives back."""
    def pack(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = _sorted(pa.Table.from_batches(some), [key])
        keys, lines = table[key].to_numpy(), table.drop_columns([key])
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            step = max(1, PACKED_BYTES * (b - a) // max(1, lines.slice(a, b - a).nbytes))
            parts += [(keys[lo], _pack(lines.slice(lo, min(step, b - lo)))) for lo in range(a, b, step)]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in parts], table.schema.field(key).type), pa.array([p for _, p in parts], pa.binary())], [key, "rows"])

    def run(batches):
        some, n, size = [], 0, 0
        for b in batches:
            if some and (n + len(b) > RUN_ROWS or size + b.nbytes > RUN_BYTES):
                yield pack(some)
                some, n, size = [], 0, 0
            if len(b):
                some.append(b)
                n, size = n + len(b), size + b.nbytes
        if some:
            yield pack(some)

    return run


def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pa.Table]:
    return (_unpack(bytes(data)) for f in frames for data in f["rows"])


class SortedRuns:
    def __init__(self, handle: StatefulProcessorHandle, chunk: int = CHUNK, run_rows: int = RUN_ROWS, fan_in: int = FAN_IN):
        self.map = handle.getMapState("runs", "run int, chunk int", "rows binary")
        self.chunk, self.run_rows, self.fan_in = chunk, run_rows, fan_in

    def in_order(self, rows: Iterator[pd.DataFrame | pa.Table], order: Sequence[str]) -> Iterator[pd.DataFrame]:
        """Frames that follow each other in ``order``; rows that tie keep the order in which they came."""
        order = list(order)
        held = self._held(f for f in rows if len(f))
        ahead = [f for _, f in zip(range(2), held)]
        if len(ahead) < 2:
            for f in ahead:
                if isinstance(f, pa.Table):
                    yield _sorted(f, order).to_pandas(use_threads=False)
                else:
                    yield f if len(f) == 1 else f.sort_values(order, kind="stable")
            return
        # Runs as (number, chunks), in the order in which their rows came.
        runs = [(n, self._store(n, [_sorted(f, order)])) for n, f in enumerate(chain(ahead, held))]
        del ahead
        free = len(runs)
        while len(runs) > self.fan_in:
            longer = []
            for lo in range(0, len(runs), self.fan_in):
                some = runs[lo:lo + self.fan_in]
                longer.append((free, self._store(free, self._merged(some, order))) if len(some) > 1 else some[0])
                free += 1
            runs = longer
        for table in self._merged(runs, order):
            yield table.to_pandas(use_threads=False)

    def _held(self, frames: Iterator[pd.DataFrame | pa.Table]) -> Iterator[pd.DataFrame | pa.Table]:
        """Frames put together up to the bounds as tables; a single frame as it is."""
        ahead = [f for _, f in zip(range(2), frames)]
        if len(ahead) < 2:
            yield from ahead
            return
        some, n, size = [], 0, 0
        for f in chain(ahead, frames):
            more = _table(f)
            if some and (n + len(f) > self.run_rows or size + more.nbytes > RUN_BYTES):
                yield _joined(some)
                some, n, size = [], 0, 0
            some.append(more)
            n, size = n + len(f), size + more.nbytes
        yield _joined(some)

    def _store(self, run: int, tables: Iterator[pa.Table]) -> int:
        """The number of chunks that the tables of a run were cut into."""
        k = 0
        for table in tables:
            step = max(1, min(self.chunk, CHUNK_BYTES * len(table) // max(1, table.nbytes)))
            for lo in range(0, len(table), step):
                self.map.updateValue((run, k), (_pack(table.slice(lo, step)),))
                k += 1
        return k

    def _merged(self, runs: list[tuple[int, int]], order: list[str]) -> Iterator[pa.Table]:
        taken, heads, keys = [0] * len(runs), [None] * len(runs), [[] for _ in runs]
        while True:
            for at, (run, n) in enumerate(runs):
                if not keys[at] and taken[at] < n:
                    key = (run, taken[at])
                    heads[at] = _unpack(self.map.getValue(key)[0])
                    self.map.removeKey(key)
                    keys[at] = list(heads[at].select(order).to_pandas(use_threads=False).itertuples(index=False, name=None))
                    taken[at] += 1
            # Rows up to the least last key of the runs that go on are complete.
            ends = [keys[at][-1] for at, (_, n) in enumerate(runs) if taken[at] < n]
            end = min(ends) if ends else None
            parts = []
            for at, own in enumerate(keys):
                cut = bisect_right(own, end) if ends else len(own)
                if cut:
                    parts.append(heads[at].slice(0, cut))
                    heads[at], keys[at] = heads[at].slice(cut), own[cut:]
            if parts:
                yield _sorted(_joined(parts), order)
            if not ends:
                return
