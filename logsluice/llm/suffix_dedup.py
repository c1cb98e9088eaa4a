"""Removal of every byte that a repeated string of ``WINDOW`` bytes covers, by externally induced suffix order.

A window is ``WINDOW`` consecutive bytes of one document in UTF-8. All its occurrences go, the first as well.

1. Packs. Documents are packed, compressed and written once. A window names the least hashed of its runs of ``ANCHOR`` bytes, the leftmost of
   equal ones, so equal windows name equal anchors. Neighbouring windows that name the same place are one segment, a hundred bytes and
   more. Windows that name an anchor at two places of the corpus may repeat; packs send their anchors once, and those found twice come back.
2. Shards. Segments with such an anchor go to the shard of its range of hashes, one copy per pack. Equal windows meet in one
   shard, and nothing else must meet there. The number of shards grows with the bytes sent.
3. Order. A shard's suffixes are sorted by external induced sorting (``induced``), with the prefixes that neighbours share: from ``WINDOW``
   bytes on they repeat. Shards larger than memory, as of an anchor that all packs hold, are sorted through files.
4. Packs get the places of repeated windows, add segments that they hold twice themselves, and remove what the windows cover.

Hashes only select and route; windows are compared by their bytes. Null texts count as empty, and texts shorter than a window stay. Null ids,
repeated rows and rows sharing an id are documents of their own. Extra columns are ignored, whatever their names. An empty table gives
an empty result. A document must fit in a task's memory a few times; longer than a pack it is a pack of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import write_shared
from .induced import MEMORY, Induction, array
from .substrings import _BASE, _BYTE, _INVERSE, _delta, _mix, _part_of, _powers, _rows, _rows_by_key, _squeeze, _unsqueeze

WINDOW, ANCHOR = 200, 64
#: Bytes of text in a pack.
PACK_BYTES = 2 << 20
#: Bytes of segments in a shard, and anchors in a group, about.
SHARD_BYTES, GROUP_ROWS = 2 << 20, 1 << 21
#: Window starts hashed at a time; their arrays stay in a core's cache.
_SPAN = 1 << 16
_HIGH = np.uint64(0xFFFFFFFF00000000)


def segments(body: bytes, lengths: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor) of each segment of documents that lie end to end in ``body``."""
    ends = np.cumsum(lengths)
    last = np.zeros(len(body) + 1, np.int32)  # +1 where a document's windows begin, -1 behind them
    long = lengths >= window
    np.add.at(last, (ends - lengths)[long], 1)
    np.add.at(last, (ends - window + 1)[long], -1)
    fits = np.cumsum(last[:-1], dtype=np.int32) > 0
    raw, width = np.frombuffer(body, np.uint8), window - anchor + 1
    up, down = _powers(_BASE, _SPAN + window), _powers(_INVERSE, _SPAN + window)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, max(len(body) - window + 1, 0), _SPAN):
        hi = min(lo + _SPAN, len(body) - window + 1)
        if not fits[lo:hi].any():
            continue
        b = _BYTE[raw[lo:hi + window - 1]]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * up[:len(b)], out=total[1:])
        hashes = (total[anchor:] - total[:-anchor]) * down[:len(b) - anchor + 1]
        key = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        least, span = (key & _HIGH) | np.arange(len(key), dtype=np.uint64), 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:hi - lo], least[width - span:width - span + hi - lo])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(fits[lo:hi])
        named = place[start]
        new = np.concatenate([[True], (named[1:] != named[:-1]) | (start[1:] != start[:-1] + 1)])
        first = np.flatnonzero(new)
        out.append((lo + start[first], np.diff(np.append(first, len(start))), _mix(hashes[named[first]])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _write_packs(documents: DataFrame, doc_id: str, text: str, pack_bytes: int, window: int, anchor: int) -> DataFrame:
    """(pack, docs, body, segments, anchors, n_anchors), a row per pack."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def pack() -> pa.RecordBatch:
            body = b"".join(t for _, t in rows)
            lengths = np.array([len(t) for _, t in rows], np.int64)
            first, many, named = segments(body, lengths, window, anchor)
            anchors, of, seen = np.unique(named, return_inverse=True, return_counts=True)
            docs = _squeeze(np.array([i or 0 for i, _ in rows], np.int64), np.array([i is None for i, _ in rows], np.int64), lengths)
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([docs]), pa.array([zstandard.ZstdCompressor(level=3).compress(body)]),
                pa.array([_squeeze(_delta(first), many, of.astype(np.int64), seen[of])]), pa.array([anchors.tobytes()]), pa.array([len(anchors)]),
            ], ["pack", "docs", "body", "segments", "anchors", "n_anchors"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = (t.as_py() or "").encode()
                if rows and size + len(t) > pack_bytes:
                    yield pack()
                    number, rows, size = number + 1, [], 0
                rows.append((i, t))
                size += len(t)
        if rows:
            yield pack()

    narrow = documents.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    schema = "pack long, docs binary, body binary, segments binary, anchors binary, n_anchors long"
    return write_shared(narrow.mapInArrow(run, schema), "suffix-packs")


def _segments_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, number of the anchor, how many segments of the pack name it)."""
    first, many, of, seen = _unsqueeze(blob, "<i8", "<i8", "<i8", "<i8")
    return np.cumsum(first), many, of, seen


def _by_pack(packs: np.ndarray, of: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """(pack, data, n): the values that go back to each pack, in their order."""
    order = np.argsort(of, kind="stable")
    of, columns = of[order], [c[order] for c in columns]
    names, starts = np.unique(of, return_index=True)
    ends = np.append(starts[1:], len(of))
    data = [_squeeze(_delta(columns[0][a:b]), *[c[a:b] for c in columns[1:]]) for a, b in zip(starts, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(packs[names], pa.int64()), pa.array(data, pa.binary()), pa.array(ends - starts, pa.int64())], ["pack", "data", "n"]
    )


def _anchors_elsewhere(packs: DataFrame, groups: int) -> DataFrame:
    """(pack, data, n): for each pack those of its anchors that other packs hold too, in some rows."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, anchors in _rows(b):
                hashes = np.frombuffer(anchors, "<u8")
                yield _rows_by_key(_part_of(hashes, groups), pack, [hashes])

    def merge(table: pa.Table) -> pa.Table:
        found = [_unsqueeze(d.as_py(), "<u8")[0] for d in table.column("data")]
        h, of = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        some = np.flatnonzero(twice)
        return pa.Table.from_batches([_by_pack(table.column("pack").to_numpy(), of[some], h[some].view(np.int64))])

    sent = packs.select("pack", "anchors").mapInArrow(send, "key long, pack long, data binary")
    return sent.groupBy("key").applyInArrow(merge, "pack long, data binary, n long")


def _to_shards(packs: DataFrame, shards: int, window: int) -> DataFrame:
    """(key, pack, places, body): a pack's segments of repeated anchors for each shard, equal ones once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, body, blob, anchors, shared in _rows(b):
                body = zstandard.ZstdDecompressor().decompress(body)
                first, many, of, seen = _segments_of(blob)
                anchors = np.frombuffer(anchors, "<u8")
                known = np.zeros(len(anchors), bool)
                for d in shared or ():
                    known[np.searchsorted(anchors, np.cumsum(_unsqueeze(d, "<i8")[0]).view(np.uint64))] = True
                some = np.flatnonzero(known[of] | (seen > 1))
                each = {}
                for k, a, n in zip(some.tolist(), first[some].tolist(), many[some].tolist()):
                    each.setdefault(body[a:a + n + window - 1], k)
                some = np.array(list(each.values()), np.int64)
                key = _part_of(anchors[of[some]], shards)
                order = np.argsort(key, kind="stable")
                texts = list(each)
                cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
                rows = []
                for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
                    at = order[lo:hi]
                    text = b"".join(texts[k] for k in at.tolist())
                    rows.append((int(key[at[0]]), pack, _squeeze(first[some[at]], many[some[at]]), zstandard.ZstdCompressor(level=1).compress(text)))
                if rows:
                    k, p, places, text = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k, pa.int64()), pa.array(p, pa.int64()), pa.array(places), pa.array(text)], ["key", "pack", "places", "body"]
                    )

    return packs.mapInArrow(run, "key long, pack long, places binary, body binary")


def _repeated(rows: list[tuple], window: int, memory: int) -> pa.RecordBatch | None:
    """For each pack of a shard (pack, places, body) its repeated windows, as (first, how many)."""
    places = [_unsqueeze(p, "<i8", "<i8") for _, p, _ in rows]
    first, many = (np.concatenate(x) for x in zip(*places))
    of = np.repeat(np.arange(len(rows)), [len(p[0]) for p in places])
    size = many + window  # the bytes of a segment and its end
    start = np.cumsum(size) - size
    text = array(int(size.sum()), np.uint16, memory)
    wanted = array(len(text), bool, memory)
    segment = 0
    for (_, _, body), (f, m) in zip(rows, places):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        n = m + window - 1
        base = np.arange(len(raw)) + np.repeat(start[segment:segment + len(f)] - (np.cumsum(n) - n), n)
        text[base] = raw.astype(np.uint16) + 1
        inside = np.arange(m.sum()) + np.repeat(start[segment:segment + len(f)] - (np.cumsum(m) - m), m)
        wanted[inside] = True
        segment += len(f)
    twice = array(len(text) + 1, bool, memory)
    before = 0
    for place, shared in Induction(text, None, text, window, memory).order(wanted):
        if len(place):
            hit = shared >= window
            twice[place[hit]] = True
            twice[np.append(before, place[:-1])[hit]] = True
            before = place[-1]
    # A segment's last bytes are no window's start, so no stretch goes on into the next segment.
    edge = np.flatnonzero(np.diff(np.concatenate([[False], twice])))
    a, b = edge[::2], edge[1::2]
    if not len(a):
        return None
    at = np.searchsorted(start, a, "right") - 1
    packs = np.array([p for p, _, _ in rows], np.int64)
    back = first[at] + a - start[at]
    order = np.lexsort((back, of[at]))
    return _by_pack(packs, of[at][order], back[order], (b - a)[order])


def _sort_shards(sent: DataFrame, shards: int, window: int, memory: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []  # a shard's rows are held compressed
        for b in batches:
            for k, *row in _rows(b):
                if k != key and rows:
                    found = _repeated(rows, window, memory)
                    if found:
                        yield found
                    rows = []
                key = k
                rows.append(tuple(row))
        if rows:
            found = _repeated(rows, window, memory)
            if found:
                yield found

    ready = sent.repartition(shards, "key").sortWithinPartitions("key")
    return ready.mapInArrow(run, "pack long, data binary, n long")


def remove_repeated_bytes(
    documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, pack_bytes: int = PACK_BYTES, shard_bytes: int = SHARD_BYTES,
    group_rows: int = GROUP_ROWS, memory: int = MEMORY, with_bytes: bool = False, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``documents``.

    ``with_bytes`` adds ``kept``, the bytes that remain, which may not be whole characters, and ``spans``, the removed
    stretches of bytes as (first, end). ``memory`` is the number of entries from which sorting goes through files.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor is at most a window")
    packs = _write_packs(documents, doc_id, text, pack_bytes, window, anchor)
    total = packs.agg(F.sum("n_anchors")).first()[0] or 0
    shared = write_shared(_anchors_elsewhere(packs, max(1, -(-total // group_rows))), "suffix-anchors")
    # A segment has half as many windows as an anchor has places in one, on average.
    each = window + (window - anchor) // 2
    shards = max(1, -(-(shared.agg(F.sum("n")).first()[0] or 0) * each // shard_bytes))
    own = shared.groupBy("pack").agg(F.collect_list("data").alias("shared"))  # at most the pack's own anchors
    sent = _to_shards(packs.join(own, "pack", "left").select("pack", "body", "segments", "anchors", "shared"), shards, window)
    found = write_shared(_sort_shards(sent, shards, window, memory), "suffix-repeats")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary, spans array<struct<first:long,end:long>>" * with_bytes

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, body, blob, repeats in _rows(b):
                ids, null, lengths = _unsqueeze(docs, "<i8", "<i8", "<i8")
                body = zstandard.ZstdDecompressor().decompress(body)
                yield from _kept(ids, null, lengths, body, _covered(body, blob, repeats, window), with_bytes)

    back = found.groupBy("pack").agg(F.collect_list("data").alias("repeats"))  # at most the pack's own windows
    return packs.join(back, "pack", "left").select("docs", "body", "segments", "repeats").mapInArrow(remove, schema)


def _covered(body: bytes, blob: bytes, repeats: list[bytes] | None, window: int) -> np.ndarray:
    """Which bytes of a pack a repeated window covers."""
    edge = np.zeros(len(body) + 1, np.int32)
    first, many, _, seen = _segments_of(blob)
    each: dict[bytes, int] = {}
    stretches = [(np.cumsum(f), n) for f, n in (_unsqueeze(d, "<i8", "<i8") for d in repeats or ())]
    twice = []
    for k in np.flatnonzero(seen > 1).tolist():  # equal segments name the same anchor
        other = each.setdefault(body[first[k]:first[k] + many[k] + window - 1], k)
        if other != k:
            twice += [other, k]
    stretches.append((first[twice], many[twice]))
    for f, n in stretches:
        np.add.at(edge, f, 1)
        np.add.at(edge, f + n + window - 1, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _kept(ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, body: bytes, gone: np.ndarray, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    rows, at, size = [], 0, 0
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][:7 if with_bytes else 5]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for i, none, n in zip(ids.tolist(), null.tolist(), lengths.tolist()):
        cut = np.flatnonzero(np.diff(np.concatenate([[False], gone[at:at + n], [False]]))).tolist()
        spans = list(zip(cut[::2], cut[1::2]))
        edges = [0, *cut, n]
        kept = b"".join(body[at + a:at + b] for a, b in zip(edges[::2], edges[1::2]))
        row = (None if none else i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        rows.append(row + (kept, [{"first": a, "end": b} for a, b in spans]) if with_bytes else row)
        at, size = at + n, size + len(kept)
        if len(rows) == 1024 or with_bytes and size > 1 << 22:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()
