"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Class ``k`` holds the pieces that fill one ``k``-th of a sequence, and its bins take exactly
``k`` pieces each, so a worker packs by counting: no bin is searched for and workers need nothing of
each other. A document is cut into pieces that fit a class exactly or leave at most
``slack`` of it free: as many whole sequences as it has, then the largest class that what is
left reaches, and so on. Classes are 1 to ``whole_classes`` and the powers of two above; classes
that are powers of two fill their bins to the last token.

What remains of a worker's last bins is cut into sequences of powers of two, which need no padding.

Ids come from the tokenizer applied to the words of a text with the white space before them, each
distinct one once (the cuts are those of its own first step, so ids are those of the whole text),
plus one end id per document. A null text is empty and gives the end id alone. Repeated rows and rows
sharing an id are packed one by one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

CAPACITY, END_ID = 2048, 1
WHOLE_CLASSES, SLACK = 8, 1 / 128
#: Distinct words whose ids a worker remembers, and the longest that it does.
_REMEMBERED, _LONGEST = 1 << 19, 48
#: Characters of text that are cut and tokenized at a time.
_SPAN = 1 << 20

# White space as the tokenizer's pattern understands it. A word takes one space before it; a run
# of white space before a word leaves it its last space, and is a word of its own otherwise.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Fixed value: the public pattern by which byte-level vocabularies of this kind cut texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNITS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


class _Known(dict):
    """Ids of words, as bytes; a new word is encoded when it is asked for."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self._encode(word)).tobytes()
        if len(word) <= _LONGEST:
            self[word] = ids
        return ids


class Encoder:
    """Text to the ids that the tokenizer in a file gives it, by way of remembered words.

    The file's own library takes the texts that contain a special token's string, as it cuts them
    there first. Words go through a second engine that is built from the same vocabulary.
    """

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        added = {t.content for t in self._tokenizer.get_added_tokens_decoder().values()}
        # Letters that stand for bytes in the file: printable ones for themselves, others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        # In a vocabulary of this kind ids follow the order of the merges.
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        engine = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._special, self._known = sorted(added), _Known(engine.encode_ordinary)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self._special):
            return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        out, known, at = [], self._known, 0
        while at < len(text):
            units = _UNITS.findall(text, at, at + _SPAN)
            if at + _SPAN < len(text):  # the end of the span may have cut the last ones short
                units = units[:-2] if len(units) > 2 else _UNITS.findall(text, at)
            at += sum(map(len, units))
            if len(known) > _REMEMBERED:
                known.clear()
            out.append(b"".join(map(known.__getitem__, units)))
        return np.frombuffer(b"".join(out), "<u4")


def piece_sizes(capacity: int, whole_classes: int) -> list[tuple[int, int]]:
    """(class, size of its pieces), largest first. The smallest class holds single tokens."""
    classes = set(range(1, min(whole_classes, capacity) + 1)) | {1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity}
    return sorted(((k, capacity // k) for k in classes | {capacity}), key=lambda c: c[0])


def cut(length: int, sizes: list[tuple[int, int]], slack: float) -> Iterator[tuple[int, int]]:
    """(class, tokens) of the pieces of a document, in order."""
    capacity = sizes[0][1]
    yield from ((1, capacity) for _ in range(length // capacity))
    left = length % capacity
    while left:
        for k, size in sizes:
            if left <= size and left >= size * (1 - slack):
                yield k, left
                return
            if left > size:
                yield k, size
                left -= size
                break


def powers(length: int) -> Iterator[int]:
    """The powers of two that add up to ``length``, largest first."""
    while length:
        top = 1 << (length.bit_length() - 1)
        yield top
        length -= top


class Packer:
    """The bins of one worker. Pieces are (row, start, length, ids)."""

    def __init__(self, worker: int, capacity: int, whole_classes: int, slack: float, with_ids: bool = False):
        if capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.sizes, self.slack, self.with_ids = piece_sizes(capacity, whole_classes), slack, with_ids
        self.open: dict[int, list] = {k: [] for k, _ in self.sizes}
        self._next = worker << 33  # a worker's sequences are far fewer than 2 ** 33
        self.out: list[tuple] = []

    def add(self, row, ids: np.ndarray) -> None:
        at = 0
        for k, n in cut(len(ids), self.sizes, self.slack):
            self.open[k].append((row, at, ids[at:at + n], len(ids)))
            at += n
            if len(self.open[k]) == k:
                self._close(self.open[k])
                self.open[k] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for row, start, ids, total in pieces:
            found = (row, start, len(ids), zlib.crc32(ids.tobytes()), total, self._next, at)
            self.out.append(found + (ids,) * self.with_ids)
            at += len(ids)
        self._next += 1

    def finish(self) -> None:
        """Cut what the open bins hold into sequences of powers of two."""
        rest = [p for k, _ in self.sizes for p in self.open[k]]
        waiting = sum(len(p[2]) for p in rest)
        sequences = [self.sizes[0][1]] * (waiting // self.sizes[0][1]) + list(powers(waiting % self.sizes[0][1]))
        rest.reverse()
        for room in sequences:
            here = []
            while room:
                row, start, ids, total = rest.pop()
                here.append((row, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((row, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._close(here)


def pack_documents(
    documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    whole_classes: int = WHOLE_CLASSES, slack: float = SLACK, with_ids: bool = False, doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer_path`` must be readable on every executor. ``with_ids`` adds the ids themselves.
    A worker's open bins hold fewer pieces than the sum of the classes, so its memory is bounded.
    """
    fields = [
        pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()), pa.field("length", pa.int64()),
        pa.field("ids_crc32", pa.int64()), pa.field("doc_tokens", pa.int64()), pa.field("sequence_id", pa.int64()),
        pa.field("offset", pa.int64()),
    ] + [pa.field("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId(), capacity, whole_classes, slack, with_ids)
        end = np.array([end_id], "<u4")

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.out)) or [()] * len(schema)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(key, np.concatenate([encoder.ids(t.as_py() or ""), end]))
                if len(packer.out) >= 8192:
                    yield flush()
        packer.finish()
        yield flush()

    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return narrow.mapInArrow(run, ddl + ", ids array<int>" * with_ids)
