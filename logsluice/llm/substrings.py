"""Exact substring deduplication with prefix-partitioned suffix trees.

A passage repeats where its window of ``WINDOW`` words occurs more than once. Every occurrence but
the first, in the order of documents and places, is removed. Windows are suffixes of the corpus cut
at ``WINDOW`` words; equal windows pass through the same inner node of the suffix tree at that
depth. The tree is built in parts that fit in memory:

1. Packs. Neighbouring documents are packed, compressed and written once, bucketed by pack, so that
   later steps join small tables to them and never move a text.
2. Anchors. A window names the least hashed of its runs of ``ANCHOR`` words. Equal windows name equal
   anchors, and about one word in eight is an anchor. Packs send each of their anchors once; those that
   two packs hold come back. Only windows with such an anchor can occur in two packs.
3. Groups. A suffix goes to a group by its prefix, the hash of its first half. A histogram fixes the
   groups: neighbouring prefixes share one while it fits in memory, and a prefix that is too large alone is
   made longer by the hash of the second half. A pack sends equal windows once, with the first place.
4. Subtrees. A group sorts its suffixes by both halves; runs of equal ones are its deep inner nodes. The
   places of all but the first of a run go back to their packs.
5. A pack adds its own repeats and removes the words that all these windows cover.

A passage that a third of all documents hold is sent once per pack, so no group gets more of it than
there are packs. Halves are 64-bit hashes of words, so two different windows would have to agree in 128
bits to be taken for each other.

Null ids come first (the least long is taken for null), others by value; rows sharing an id follow
each other as they are stored, so of repeated rows one keeps its words. Null and empty texts have
no words, and texts shorter than a window are kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import scratch, write_shared

WINDOW, ANCHOR = 20, 6
#: Bytes of text in a pack. A longer document is a pack of its own.
PACK_BYTES = 2 << 20
#: Suffixes and anchors that a group holds in memory at a time, about.
GROUP_ROWS = 1 << 21
#: Leading bits of the first half's hash that the histogram of prefixes tells apart.
PREFIX_BITS = 10

_SPAN = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Odd, so that it has an inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end] from one running sum."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:len(values)], dtype=np.uint64)])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(text: bytes, up: np.ndarray | None = None, down: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash for each word, a span of text at a time; powers for a span may be given."""
    if up is None or down is None:
        n = min(len(text), _SPAN) + 1
        up, down = _powers(_BASE, n), _powers(_INVERSE, n)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + _SPAN)
        if end < len(text):  # back to the last separator; a longer word is hashed on its own
            cut = max(text.rfind(bytes([c]), at, end) for c in (9, 10, 11, 12, 13, 32))
            if cut <= at:
                found = re.compile(rb"[\x20\x09-\x0D]").search(text, end)
                end = found.start() if found else len(text)
                word = text[at:end].strip(b" \t\n\r\v\f")
                out += [np.array([xxhash.xxh3_64_intdigest(word)], np.uint64)] if word else []
                at = end
                continue
            end = cut
        b = np.frombuffer(text, np.uint8, end - at, at)
        word = np.concatenate([[False], ~_SEPARATOR[b], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        s, e = edge[::2], edge[1::2]
        out.append(_mix(_runs(_BYTE[b], s, e, up, down) ^ _mix((e - s).astype(np.uint64))))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sliding(h: np.ndarray, n: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash for each run of ``n`` values."""
    s = np.arange(max(len(h) - n + 1, 0))
    return _mix(_runs(h, s, s + n, up, down))


class Windows:
    """All windows of a pack in order: their document, first word, halves and, if asked for, anchor."""

    def __init__(self, texts: list[bytes], window: int, anchor: int | None):
        span = min(max(map(len, texts), default=0), _SPAN) + 1
        up, down = _powers(_BASE, span), _powers(_INVERSE, span)
        hashes = [word_hashes(t, up, down) for t in texts]
        self.n_words = np.array([len(h) for h in hashes], np.int64)
        self.first_word = np.concatenate([[0], np.cumsum(self.n_words)])
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        up, down = _powers(_BASE, len(h) + 1), _powers(_INVERSE, len(h) + 1)
        per_doc = np.maximum(self.n_words - window + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), per_doc)
        inside = np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        #: Word of the pack that a window starts at.
        self.at = self.first_word[self.doc] + inside
        half = window // 2
        first, second = _sliding(h, half, up, down), _sliding(h, window - half, up, down)
        self.a, self.b = first[self.at], second[self.at + half]
        if anchor is None:
            return
        grams = _sliding(h, anchor, up, down)
        width = window - anchor + 1
        least = grams[:max(len(grams) - width + 1, 0)].copy()
        for k in range(1, width):
            np.minimum(least, grams[k:k + len(least)], out=least)
        self.anchor = least[self.at]


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def _unsqueeze(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


_NULL_ID = -(1 << 63)


def _write_packs(documents: DataFrame, keep: list[str], doc_id: str, text: str, pack_bytes: int, window: int, anchor: int) -> DataFrame:
    """(pack, docs, body, kept, anchors, n_anchors, prefixes), a row per pack; a table bucketed by pack.

    Inside a pack documents stand in the order of their ids. ``kept`` holds the columns ``keep``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def pack() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            texts = [r[1] for r in rows]
            w = Windows([t or b"" for t in texts], window, anchor)
            anchors = np.unique(w.anchor)
            prefixes = np.bincount((w.a >> np.uint64(64 - PREFIX_BITS)).astype(np.int64), minlength=1 << PREFIX_BITS)
            docs = _squeeze(np.array([r[0] for r in rows], np.int64), np.array([-1 if t is None else len(t) for t in texts], np.int64))
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(t for t in texts if t))
            kept = _to_bytes(pa.Table.from_batches([r[2] for r in rows]).combine_chunks()) if keep else b""
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([docs]), pa.array([body]), pa.array([kept]), pa.array([anchors.tobytes()]),
                pa.array([len(anchors)]), pa.array([prefixes], pa.list_(pa.int64())),
            ], ["pack", "docs", "body", "kept", "anchors", "n_anchors", "prefixes"])

        for b in batches:
            others = pa.RecordBatch.from_arrays(b.columns[2:], b.schema.names[2:]) if keep else None
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                t = t.as_py()
                t = t if t is None else t.encode()
                if rows and size + len(t or b"") > pack_bytes:
                    yield pack()
                    number, rows, size = number + 1, [], 0
                rows.append((_NULL_ID if i is None else i, t, others and others.slice(k, 1)))
                size += len(t or b"")
        if rows:
            yield pack()

    spark = documents.sparkSession
    narrow = documents.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), *keep)
    packs = narrow.mapInArrow(
        run, "pack long, docs binary, body binary, kept binary, anchors binary, n_anchors long, prefixes array<long>"
    )
    path = scratch(spark, "packs")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    # As many buckets as a shuffle has partitions, or joins would shuffle the packs.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs.write.bucketBy(buckets, "pack").option("path", path).saveAsTable(name)
    return spark.table(name)


def _to_bytes(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(table)
    return out.getvalue()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows one at a time, as a batch of packs is large."""
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in batch.columns)


def _open(docs: bytes, body: bytes) -> tuple[np.ndarray, list[bytes | None]]:
    ids, lengths = _unsqueeze(docs, "<i8", "<i8")
    raw, at, texts = zstandard.ZstdDecompressor().decompress(body), 0, []
    for n in lengths.tolist():
        texts.append(None if n < 0 else raw[at:at + n])
        at += max(n, 0)
    return ids, texts


def _first_of_equal(w: Windows) -> np.ndarray:
    """True for the windows that are the first of their kind in the pack."""
    order = np.lexsort((w.b, w.a))  # stable, so equal ones stay in their order
    new = np.ones(len(order), bool)
    new[1:] = (w.a[order][1:] != w.a[order][:-1]) | (w.b[order][1:] != w.b[order][:-1])
    out = np.empty(len(order), bool)
    out[order] = new
    return out


def _part_of(hashes: np.ndarray, parts) -> np.ndarray:
    """Which of ``parts`` equal ranges a hash lies in."""
    return ((hashes >> np.uint64(32)) * np.asarray(parts, np.uint64) >> np.uint64(32)).astype(np.int64)


def _rows_by_key(keys: np.ndarray, pack: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """(key, pack, data): the values that go to each key, in their order."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = [*starts[1:], len(keys)]
    data = [_squeeze(*[_delta(c[a:b]) if c.dtype == np.int64 else c[a:b] for c in columns]) for a, b in zip(starts, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[starts]), pa.array([pack] * len(data), pa.int64()), pa.array(data, pa.binary())], ["key", "pack", "data"]
    )


def _delta(x: np.ndarray) -> np.ndarray:
    """Differences, which compress well where values ascend; ``cumsum`` undoes them, wrapping as they do."""
    return np.diff(x, prepend=np.int64(0))


def _back(packs: np.ndarray, of: np.ndarray, values: np.ndarray) -> pa.Table:
    """(pack, data): ``values`` to the packs that their rows ``of`` came from."""
    order = np.argsort(of, kind="stable")
    of, values = of[order], values[order]
    names, starts = np.unique(of, return_index=True)
    ends = [*starts[1:], len(of)]
    data = [_squeeze(_delta(values[a:b])) for a, b in zip(starts, ends)]
    return pa.table({"pack": pa.array(packs[names], pa.int64()), "data": pa.array(data, pa.binary())})


def _shared_anchors(packs: DataFrame, groups: int) -> DataFrame:
    """(pack, shared): for each pack those of its anchors that other packs hold too."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, anchors in zip(b.column(0).to_pylist(), b.column(1)):
                hashes = np.frombuffer(anchors.as_py(), "<u8")
                yield _rows_by_key(_part_of(hashes, groups), pack, [hashes])

    def merge(table: pa.Table) -> pa.Table:
        found = [_unsqueeze(d.as_py(), "<u8")[0] for d in table.column("data")]
        h, of = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return _back(table.column("pack").to_numpy(), of[twice], h[twice].view(np.int64))

    sent = packs.select("pack", "anchors").mapInArrow(send, "key long, pack long, data binary")
    back = sent.groupBy("key").applyInArrow(merge, "pack long, data binary")
    return back.groupBy("pack").agg(F.collect_list("data").alias("shared"))  # at most the pack's own anchors


def _route(histogram: np.ndarray, group_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each prefix its (first) group, and the number of groups that it alone is spread over."""
    first, parts = np.zeros(len(histogram), np.int64), np.ones(len(histogram), np.int64)
    group, room = -1, 0
    for k, n in enumerate(histogram.tolist()):
        if n > group_rows:
            parts[k] = -(-n // group_rows)
            first[k], group, room = group + 1, group + int(parts[k]), 0
        elif n > room or group < 0:
            group, room = group + 1, group_rows - n
            first[k] = group
        else:
            first[k], room = group, room - n
    return first, parts


def _repeats(packs: DataFrame, shared: DataFrame, route: tuple[np.ndarray, np.ndarray], window: int, anchor: int) -> DataFrame:
    """(pack, repeats): for each pack the numbers of its windows that occur earlier in another pack."""
    first, parts = route

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, docs, body, anchors in _rows(b):
                ids, texts = _open(docs, body)
                w = Windows([t or b"" for t in texts], window, anchor)
                known = np.sort(np.concatenate([np.cumsum(_unsqueeze(d, "<i8")[0]).view(np.uint64) for d in anchors]))
                at = np.minimum(np.searchsorted(known, w.anchor), len(known) - 1)
                some = np.flatnonzero((known[at] == w.anchor) & _first_of_equal(w))
                a, c = w.a[some], w.b[some]
                prefix = (a >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)
                yield _rows_by_key(first[prefix] + _part_of(c, parts[prefix]), pack, [a, c, ids[w.doc[some]], some])

    def merge(table: pa.Table) -> pa.Table:
        packs_ = table.column("pack").to_numpy()
        found = [_unsqueeze(d.as_py(), "<u8", "<u8", "<i8", "<i8") for d in table.column("data")]
        of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        a, c = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        ids, number = (np.concatenate([np.cumsum(f[k]) for f in found]) for k in (2, 3))
        del found
        # A pack's rows stand in order; between packs the id decides, then the pack.
        order = np.lexsort((number, packs_[of], ids, c, a))
        again = (a[order][1:] == a[order][:-1]) & (c[order][1:] == c[order][:-1])
        later = np.sort(order[1:][again])
        return _back(packs_, of[later], number[later])

    sent = packs.select("pack", "docs", "body").join(shared, "pack").mapInArrow(send, "key long, pack long, data binary")
    back = sent.groupBy("key").applyInArrow(merge, "pack long, data binary")
    return back.groupBy("pack").agg(F.collect_list("data").alias("repeats"))  # at most the pack's own windows


def remove_repeats(
    documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, pack_bytes: int = PACK_BYTES,
    group_rows: int = GROUP_ROWS, with_text: bool = False, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``documents``.

    ``with_text`` adds ``kept_text``, as it was where nothing is removed and else the kept words with
    one space between, and ``spans``, the removed stretches of words as (first, end). The columns ``keep`` of
    the input follow, unless they have the name of one of these.
    """
    if not 0 < anchor <= window // 2:
        raise ValueError("an anchor is at most half a window")
    schema = T._parse_datatype_string(
        "doc_id long, n_words long, n_removed long, kept_sha256 string"
        + ", kept_text string, spans array<struct<first:long,end:long>>" * with_text
    )
    own = len(schema)
    for f in documents.schema.fields:
        if f.name in keep and f.name not in schema.fieldNames():
            schema.add(f)
    keep = schema.fieldNames()[own:]
    packs = _write_packs(documents, keep, doc_id, text, pack_bytes, window, anchor)
    total = packs.agg(F.sum("n_anchors")).first()[0] or 0
    histogram = np.zeros(1 << PREFIX_BITS, np.int64)
    counts = packs.select(F.posexplode("prefixes").alias("prefix", "n")).groupBy("prefix").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # 2 ** PREFIX_BITS numbers
        histogram[r.prefix] = r.n
    shared = write_shared(_shared_anchors(packs, max(1, -(-total // group_rows))), "shared-anchors")
    repeats = write_shared(_repeats(packs, shared, _route(histogram, group_rows), window, anchor), "repeats")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, body, kept, numbers in _rows(b):
                ids, texts = _open(docs, body)
                w = Windows([t or b"" for t in texts], window, None)
                gone = ~_first_of_equal(w)
                for d in numbers or ():
                    gone[np.cumsum(_unsqueeze(d, "<i8")[0])] = True
                edge = np.zeros(w.first_word[-1] + 1, np.int64)
                np.add.at(edge, w.at[gone], 1)
                np.add.at(edge, w.at[gone] + window, -1)
                removed = np.cumsum(edge[:-1]) > 0
                columns = _kept(ids, texts, w, removed, with_text)
                if keep:
                    columns += pa.ipc.open_stream(kept).read_all().combine_chunks().columns
                yield from pa.Table.from_arrays(columns, schema.fieldNames()).to_batches(max_chunksize=1024)

    return packs.select("pack", "docs", "body", "kept").join(repeats, "pack", "left").select(
        "docs", "body", "kept", "repeats"
    ).mapInArrow(remove, schema)


def _kept(ids: np.ndarray, texts: list[bytes | None], w: Windows, removed: np.ndarray, with_text: bool) -> list[pa.Array]:
    rows = []
    for k, (i, t) in enumerate(zip(ids.tolist(), texts)):
        cut = removed[w.first_word[k]:w.first_word[k + 1]]
        words, n = (t or b"").split(), int(cut.sum())
        kept = b" ".join(x for x, c in zip(words, cut.tolist()) if not c) if n else b" ".join(words)
        row = (None if i == _NULL_ID else i, len(words), n, hashlib.sha256(kept).hexdigest())
        if with_text:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]])))
            spans = [{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
            row += (kept.decode() if n else None if t is None else t.decode(), spans)
        rows.append(row)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
    return [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
