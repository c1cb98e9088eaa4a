"""Suffix order and common prefixes by external induced sorting, for one shard.

A text is a string of whole numbers above zero in segments, each ended by a zero; ends are smaller than all else and differ, so no
match crosses them. A suffix is of type S if it is less than the next one, else L; an S behind an L is a
sample, and so is every end.

1. Every suffix has a tail: its symbols up to and with the next sample, each with its type. No tail begins another.
   A queue takes the tails, a few symbols packed in each key, and gives them back sorted; ties go round
   again with their next symbols until they end. The samples' tails get names.
2. If names repeat, the samples' order comes from the same procedure on the string of names, which is less than half as long.
3. The order of samples induces that of all suffixes: the queue takes (tail, rank of the sample behind it, place) and gives
   them back in suffix order.

Common prefixes travel along, in symbols of the text at every level and up to a cap: suffixes of one tail share it and
what their samples share, the least value between two ranks; suffixes of different tails part within these, and are compared.

A queue holds so many entries in memory; beyond that it writes sorted runs and merges them block by block. Arrays of
the shard's length are mapped to files beyond the same size. The files have no name and lie where Spark spills on the machine that runs the
task; nothing else reads them, they vanish with the task, and a lost executor only means that the task runs anew.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries that a queue holds, and an array has, before files take over.
MEMORY = 1 << 22
#: Entries read or computed at a time.
STEP = 1 << 18


def _folder() -> str | None:
    """Where Spark lets tasks spill."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


def array(n: int, kind, memory: int) -> np.ndarray:
    """Zeros, in a file beyond ``memory`` entries."""
    if n <= memory:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile(dir=_folder()) as f:
        f.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(f, kind, "r+", shape=(n,))


def spans(n: int, step: int = STEP) -> Iterator[tuple[int, int]]:
    return ((lo, min(n, lo + step)) for lo in range(0, n, step))


class Queue:
    """A priority queue that is filled first and then emptied in order of its keys, a block at a time."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.parts, self.runs = memory, 0, [], []

    def push(self, key: np.ndarray, value: np.ndarray) -> None:
        self.parts.append((np.asarray(key, np.uint64), np.asarray(value, np.int64)))
        self.held += len(key)
        if self.held > self.memory:
            self._spill()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        key, value = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.held = [], 0
        order = np.argsort(key)
        return key[order], value[order]

    def _spill(self) -> None:
        key, value = self._sorted()
        f = tempfile.TemporaryFile(dir=_folder())
        np.stack([key, value.view(np.uint64)], axis=1).tofile(f)
        self.runs.append((f, len(key)))

    def pop(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (keys, values) in order; entries of one key come in any order."""
        if not self.runs:
            yield self._sorted()
            return
        if self.parts:
            self._spill()
        step = max(1024, self.memory // (2 * len(self.runs)))
        files, left, heads = [f for f, _ in self.runs], [n for _, n in self.runs], []
        for f in files:
            f.seek(0)
            heads.append(np.zeros((0, 2), np.uint64))
        while True:
            for k, f in enumerate(files):
                if not len(heads[k]) and left[k]:
                    heads[k] = np.fromfile(f, np.uint64, 2 * min(step, left[k])).reshape(-1, 2)
                    left[k] -= len(heads[k])
            # Up to the least of the last keys that are at hand, nothing can come from a file any more.
            open_ = [h[-1, 0] for k, h in enumerate(heads) if len(h) and left[k]]
            if not open_:
                rest = np.concatenate(heads)
                order = np.argsort(rest[:, 0])
                yield rest[order, 0], rest[order, 1].view(np.int64)
                break
            bound, taken = min(open_), []
            for k, h in enumerate(heads):
                cut = int(np.searchsorted(h[:, 0], bound, "right"))
                taken.append(h[:cut])
                heads[k] = h[cut:]
            some = np.concatenate(taken)
            order = np.argsort(some[:, 0])
            yield some[order, 0], some[order, 1].view(np.int64)
        for f in files:
            f.close()
        self.runs = []


def _bits(n: int) -> int:
    """Bits that hold the numbers below ``n``."""
    return max(1, int(n - 1).bit_length())


class Induction:
    """One level: ``symbols`` in segments; ``at`` are their places in ``text`` (None: the text itself)."""

    def __init__(self, symbols: np.ndarray, at: np.ndarray | None, text: np.ndarray, cap: int, memory: int = MEMORY):
        self.t, self.at, self.text, self.cap, self.memory, self.n = symbols, at, text, cap, memory, len(symbols)
        if not self.n or symbols[-1]:
            raise ValueError("a segment has no end")
        self._types()

    def _types(self) -> None:
        """``s``: the type S; ``sample``; ``after``: the next sample behind a place."""
        n, t = self.n, self.t
        self.s, self.sample = array(n, bool, self.memory), array(n, bool, self.memory)
        later = True  # the type at the end of the block behind
        for lo, hi in reversed(list(spans(n))):
            here = np.asarray(t[lo:hi], np.int64)
            following = np.append(here[1:], t[hi] if hi < n else 0)
            less, end = here < following, here == 0
            fixed = (here != following) | end
            at = np.where(fixed, np.arange(hi - lo), hi - lo)
            at = np.minimum.accumulate(at[::-1])[::-1]  # the next place whose type is known
            known = np.append(less | end, later)
            block = known[at]
            self.s[lo:hi] = block
            later = bool(block[0])
        for lo, hi in spans(n):
            here, before = self.s[lo:hi], np.empty(hi - lo, bool)
            before[1:], before[0] = self.s[lo:hi - 1], self.s[lo - 1] if lo else True
            self.sample[lo:hi] = (here & ~before) | (np.asarray(t[lo:hi]) == 0)
        self.after = array(n, np.int64, self.memory)
        behind = n - 1
        for lo, hi in reversed(list(spans(n))):
            at = np.where(self.sample[lo:hi], np.arange(lo, hi), n)
            at = np.minimum.accumulate(at[::-1])[::-1]
            at = np.where(at < n, at, behind)
            self.after[lo:hi] = np.append(at[1:], behind)
            behind = int(at[0])

    def _keys(self, lo: int, hi: int, width: int, bits: int) -> np.ndarray:
        """The first ``width`` typed symbols of the tails that begin in lo..hi, zeros behind their ends."""
        end = min(self.n, hi + width)
        symbols = np.zeros(hi - lo + width, np.uint64)
        symbols[:end - lo] = 2 * self.t[lo:end].astype(np.uint64) + self.s[lo:end]
        last = np.ones(hi - lo + width, bool)
        last[:end - lo] = self.sample[lo:end]
        key, alive, m = symbols[:hi - lo].copy(), np.ones(hi - lo, bool), hi - lo
        for k in range(1, width):
            key <<= np.uint64(bits)
            key |= symbols[k:k + m] * alive
            alive &= ~last[k:k + m]
        return key

    def _tails(self, wanted: np.ndarray) -> np.ndarray:
        """For each of the ``wanted`` places the number of its tail, ascending with the tails; 0 elsewhere."""
        bits = _bits(2 * (int(self.t.max()) + 1) + 2)
        width = max(1, 63 // bits)
        queue, total = Queue(self.memory), 0
        for lo, hi in spans(self.n):
            some = wanted[lo:hi]
            queue.push(self._keys(lo, hi, width, bits)[some], np.flatnonzero(some) + lo)
            total += int(some.sum())
        number = array(self.n, np.int64, self.memory)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # (number, place) of ties that go on, in order
        done, last, since = 0, None, 0
        for key, place in queue.pop():
            if not len(key):
                continue
            new = np.empty(len(key), bool)
            new[1:], new[0] = key[1:] != key[:-1], last is None or key[0] != last
            first = np.where(new, np.arange(done, done + len(key)), 0)
            first[0] = done if new[0] else since
            first = np.maximum.accumulate(first)
            number[place] = first + 1
            more = self.after[place] - place + 1 > width
            held.append((first[more] + 1, place[more]))
            done, last, since = done + len(key), key[-1], int(first[-1])
        self._again(number, held, width, bits)
        return number

    def _again(self, number: np.ndarray, held: list, depth: int, bits: int) -> None:
        """Parts the tails that agree in ``depth`` symbols by their next ones."""
        group, place = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
        while True:
            # All members of a group agree so far, so all of them go on; a group of one is settled.
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, np.int64)
            size = np.diff(edge)
            keep = np.repeat(size > 1, size)
            group, place = group[keep], place[keep]
            if not len(group):
                return
            rank = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
            room = 64 - _bits(int(rank[-1]) + 1)
            width = max(1, room // bits)
            if room < bits:
                raise ValueError("a shard has too many symbols")
            key = rank.astype(np.uint64)
            end = self.after[place]
            for k in range(depth, depth + width):
                at = np.minimum(place + k, end)
                symbol = np.where(place + k <= end, 2 * self.t[at].astype(np.int64) + self.s[at], 0)
                key = (key << np.uint64(bits)) | symbol.astype(np.uint64)
            order = np.argsort(key)
            key, place, base = key[order], place[order], group  # groups stand in order already
            new = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.searchsorted(base, base, "left")  # where a group begins
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            group = base + first - start
            number[place] = group
            depth += width
            more = self.after[place] - place + 1 > depth
            group, place = group[more], place[more]

    def _shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Symbols of the text that the suffixes at places p and q of this level share, up to the cap."""
        if self.at is not None:
            p, q = self.at[p], self.at[q]
        out, go = np.zeros(len(p), np.min_scalar_type(self.cap)), np.arange(len(p))
        for k in range(self.cap):
            go = go[(self.text[p[go] + k] == self.text[q[go] + k]) & (self.text[p[go] + k] != 0)]
            if not len(go):
                break
            out[go] = k + 1
        return out

    def _distance(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return q - p if self.at is None else self.at[q] - self.at[p]

    def order(self, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (place, shared) in suffix order for the ``wanted`` places (all but ends if not given);
        ``shared`` is what a suffix has in common with the wanted one before it, up to the cap.
        """
        ends = np.asarray(self.t) == 0
        wanted = ~ends if wanted is None else wanted
        number = self._tails((wanted | self.sample) & ~ends)
        rank, least = self._samples(number, ends)
        bits = _bits(int(rank.max()) + 1)
        if bits + _bits(int(number.max()) + 1) > 64:
            raise ValueError("a shard has too many symbols")
        queue = Queue(self.memory)
        for lo, hi in spans(self.n):
            place = np.flatnonzero(wanted[lo:hi]) + lo
            queue.push((number[place].astype(np.uint64) << np.uint64(bits)) | rank[self.after[place]].astype(np.uint64), place)
        last = None
        for key, place in queue.pop():
            if not len(key):
                continue
            tail, behind = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            before = np.concatenate([[last[0] if last else 0], tail[:-1]]), np.concatenate([[last[1] if last else 0], behind[:-1]])
            other = np.concatenate([[last[2] if last else place[0]], place[:-1]])
            same = before[0] == tail
            shared = np.zeros(len(place), np.min_scalar_type(self.cap))
            k = np.flatnonzero(same)
            far = self._distance(place[k], self.after[place[k]]) + least(before[1][k] + 1, behind[k])
            shared[k] = np.minimum(far, self.cap)
            k = np.flatnonzero(~same)
            shared[k] = self._shared(other[k], place[k])
            if last is None:
                shared[0] = 0
            last = (tail[-1], behind[-1], place[-1])
            yield place, shared

    def _samples(self, number: np.ndarray, ends: np.ndarray):
        """The rank of each sample by its place, and a function that gives what samples of two ranks share."""
        sample = np.flatnonzero(self.sample)
        own = ends[sample]
        used = array(int(number.max()) + 2, bool, self.memory)
        used[number[sample[~own]]] = True
        name = np.cumsum(used)[number[sample]]  # ascending from 1
        name[own] = 0
        n_ends = int(own.sum())
        rank = array(self.n, np.int64, self.memory)
        rank[sample[own]] = np.arange(n_ends)
        low = np.zeros(len(sample), np.min_scalar_type(self.cap))
        if name.max(initial=0) == len(sample) - n_ends:
            inside = np.flatnonzero(~own)
            order = inside[np.argsort(name[inside])]
            place = sample[order]
            rank[place] = n_ends + np.arange(len(place))
            low[n_ends + 1:] = self._shared(place[:-1], place[1:])
        else:
            at = sample if self.at is None else self.at[sample]
            done = n_ends
            for place, shared in Induction(name, at, self.text, self.cap, self.memory).order():
                rank[sample[place]] = np.arange(done, done + len(place))
                low[done:done + len(place)] = shared
                done += len(place)
            low[n_ends:n_ends + 1] = 0
        return rank, _least(low)


def _least(values: np.ndarray):
    """The least of values[a..b], for arrays of first and last places."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(table[k][a[i]], table[k][b[i] + 1 - (1 << int(k))])
        return out

    return least
