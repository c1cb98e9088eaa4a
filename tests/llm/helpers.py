"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def union_find(n, pairs):
    """The least number that each of 0..n-1 is connected to."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def removed_words(rows, window=20):
    """(id, words, flags of the removed ones) of (id, text) rows, in the order of the ids."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ws = words(t)
        flags = [False] * len(ws)
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s:s + window])
            if key in seen:
                flags[s:s + window] = [True] * window
            seen.add(key)
        out.append((i, ws, flags))
    return out


def substring_rows(rows, window=20):
    out = []
    for i, ws, flags in removed_words(rows, window):
        kept = " ".join(w for w, f in zip(ws, flags) if not f)
        out.append((i, len(ws), sum(flags), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def simhash(text, width=3):
    import xxhash

    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[k:k + width]) for k in range(max(1, len(ws) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints, radius=3):
    f = np.array(prints, np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius, 1))
    return union_find(len(f), zip(i.tolist(), j.tolist()))


def similar_texts(texts):
    """Components of the texts that share four fifths of their five-word shingles."""
    sets = []
    for t in texts:
        ws = tuple(words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))
        sets.append({ws[k:k + 5] for k in range(max(1, len(ws) - 4))} if ws else set())
    pairs = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
        if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)
    ]
    return union_find(len(sets), pairs)


def rows_of(df):
    """Rows as sorted tuples; nulls sort like text."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
