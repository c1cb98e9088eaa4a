import numpy as np
import pytest

from logsluice.llm import induced as I


def plain(text, cap, wanted):
    """(place, shared) by sorting suffixes as lists; ends are unique, in order."""
    def suffix(p):
        out = []
        while text[p]:
            out.append((1, int(text[p])))
            p += 1
        return out + [(0, p)]

    places = sorted(np.flatnonzero(wanted).tolist(), key=suffix)
    out = []
    for k, p in enumerate(places):
        n = 0
        if k:
            a, b = suffix(places[k - 1]), suffix(p)
            while n < cap and a[n] == b[n]:
                n += 1
        out.append((p, n))
    return out


def texts():
    rng = np.random.default_rng(3)
    for symbols in (1, 2, 3, 250):
        for size in (1, 2, 7, 60, 400):
            t = rng.integers(0, symbols + 1, size)
            yield np.append(t, 0)
    part = rng.integers(1, 4, 40)
    yield np.concatenate([np.append(part, 0)] * 9 + [np.append(part[5:], 0)] * 3)  # copies
    yield np.concatenate([np.ones(300, int), [0], np.ones(200, int), [2, 0], np.tile([1, 2, 3], 60), [0]])  # runs and periods
    yield np.concatenate([np.tile([2, 1], 90), [0], np.tile([2, 1], 91), [3, 0, 0, 0]])


@pytest.mark.parametrize("memory,step", ((1 << 22, 1 << 18), (64, 16), (5, 3)))
def test_order_and_common_prefixes(monkeypatch, memory, step):
    monkeypatch.setattr(I, "spans", lambda n, step=step: ((lo, min(n, lo + step)) for lo in range(0, n, step)))
    for cap in (4, 200):
        for t in texts():
            t = t.astype(np.uint16)
            for wanted in (None, (t > 0) & (np.arange(len(t)) % 3 > 0)):
                got = [(p, s) for place, shared in I.Induction(t, None, t, cap, memory).order(wanted) for p, s in zip(place.tolist(), shared.tolist())]
                assert got == plain(t, cap, t > 0 if wanted is None else wanted)


def test_queue_in_memory_and_on_disk():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5000):
        key = rng.integers(0, 1 << 63, n, dtype=np.uint64) if n != 5000 else rng.integers(0, 900, n).astype(np.uint64)
        for memory in (1 << 20, 700, 1):
            if memory == 1 and n > 10:
                continue
            q = I.Queue(memory)
            for lo in range(0, n, 170):
                q.push(key[lo:lo + 170], np.arange(lo, min(n, lo + 170)))
            blocks = list(q.pop())
            keys, values = (np.concatenate(x) for x in zip(*blocks))
            assert (keys == np.sort(key)).all() and sorted(values.tolist()) == list(range(n)) and (key[values] == keys).all()


def test_an_end_is_needed():
    with pytest.raises(ValueError):
        I.Induction(np.array([1, 2]), None, np.array([1, 2]), 5)
