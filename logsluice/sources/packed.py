"""Gzip log files read once: a task per file inflates it piece by piece and says how it ended.

Spark's own reader delivers the packed bytes, so any file system it reaches will do. For that read Hadoop's passthrough codec takes
the place of the one for gzip: the bytes come as they are, cut at line feeds, and are put together again. Files are never split, so the
pieces of a file reach one task in order and a file may have any length. An error of the file system fails the read; broken
content never does.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import in_session

#: Bytes inflated at a time, and packed bytes after which a broken file can be taken up again.
STEP, SLICE = 1 << 20, 1 << 14
#: Bytes of a line that are kept; framing cuts far below that.
LINE_BYTES = 1 << 26
#: Lines handed on at a time.
_ROWS = 8192

GZIP_INVALID, INCOMPLETE = "gzip_invalid", "input_incomplete"
_SCHEMA = "path string, line_no bigint, raw binary, partial boolean, status string"
_BAD_HEADER = re.compile("header|compression method")


class Inflater:
    """Unpacks one file's members. ``status`` tells, after ``end``, how it ended; None is a whole file.

    Zero bytes may pad the end. Anything else behind a member must be another one.
    """

    def __init__(self):
        self.member, self.members, self.seen, self.status = zlib.decompressobj(wbits=31), 0, 0, None

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.seen += len(data)
        for lo in range(0, len(data), SLICE):
            if self.status:
                return
            yield from self._feed(data[lo:lo + SLICE])

    def _feed(self, data: bytes) -> Iterator[bytes]:
        while data and not self.status:
            if self.member is None:
                data = data.lstrip(b"\0")
                if not data:
                    return
                self.member = zlib.decompressobj(wbits=31)
            before = self.member.copy()
            try:
                out = self.member.decompress(data, STEP)
                while len(out) == STEP:  # there may be more, with or without further bytes
                    yield out
                    data = self.member.unconsumed_tail
                    before = self.member.copy()
                    out = self.member.decompress(data, STEP)
            except zlib.error as e:
                yield from self._salvage(before, data, e)
                return
            if out:
                yield out
            data = b""
            if self.member.eof:
                data, self.member, self.members = self.member.unused_data, None, self.members + 1

    def _salvage(self, member, data: bytes, error: zlib.error) -> Iterator[bytes]:
        """What can still be unpacked before the byte that is wrong."""
        self.status = GZIP_INVALID if not self.members and _BAD_HEADER.search(str(error)) else INCOMPLETE
        for k in range(len(data)):
            try:
                out = member.decompress(data[k:k + 1])
            except zlib.error:
                return
            if out:
                yield out

    def end(self) -> None:
        if self.status is None and self.member is not None:
            # A header has ten bytes at least.
            self.status = GZIP_INVALID if not self.members and self.seen < 10 else INCOMPLETE


class _File:
    """The lines of one file; rows are (path, line_no, raw, partial, status)."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.inflater, self.rest, self.held, self.n, self.pieces = Inflater(), [], 0, 0, 0

    def feed(self, pieces: list[bytes]) -> Iterator[tuple]:
        data = b"\n".join(pieces)
        if self.pieces:
            data = b"\n" + data
        self.pieces += len(pieces)
        yield from self._lines(data)

    def _lines(self, data: bytes) -> Iterator[tuple]:
        for out in self.inflater.feed(data):
            first, *others = out.split(b"\n")
            self._keep(first)
            for line in others:
                yield self._line(False)
                self._keep(line)

    def _keep(self, part: bytes) -> None:
        part = part[:LINE_BYTES - self.held]
        if part:
            self.rest.append(part)
            self.held += len(part)

    def _line(self, partial: bool) -> tuple:
        self.n += 1
        raw, self.rest, self.held = b"".join(self.rest), [], 0
        return self.path, self.n, raw, partial, None

    def end(self) -> Iterator[tuple]:
        if self.inflater.seen < self.size:  # the reader takes a line feed at the end away
            yield from self._lines(b"\n")
        self.inflater.end()
        status = self.inflater.status
        if self.rest:
            yield self._line(status is not None)
        if status:
            yield self.path, None, None, False, status


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "line_no", "raw", "partial", "status"])


def _inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        file = None
        for b in batches:
            paths, sizes, values = b.column(0).to_pylist(), b.column(1), b.column(2)
            cuts = [k for k in range(len(paths)) if k == 0 or paths[k] != paths[k - 1]] + [len(paths)]
            for lo, hi in zip(cuts, cuts[1:]):
                if file is None or paths[lo] != file.path:
                    if file is not None:
                        yield from file.end()
                    file = _File(paths[lo], sizes[lo].as_py())
                yield from file.feed(values.slice(lo, hi - lo).to_pylist())
        if file is not None:
            yield from file.end()

    held, size = [], 0
    for r in rows():
        held.append(r)
        size += len(r[2] or b"")
        if len(held) == _ROWS or size > STEP:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def packed_records(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(path, line_no, raw, partial, status): the lines of gzip files and a row with a ``status`` for each that is broken.

    Lines are numbered from 1. The last line of a broken file is ``partial`` if it has no line feed. A line longer than
    ``LINE_BYTES`` is cut there. Files without a byte give no row.
    """
    # A task per file, whatever its size; the setting concerns this read alone, so it is made on a session of its own.
    own = spark.newSession()
    for name, value in (("maxPartitionBytes", 1 << 62), ("openCostInBytes", 1 << 46), ("minPartitionNum", max(1, len(files)))):
        own.conf.set(f"spark.sql.files.{name}", str(value))
    codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec  # its option has another name in Hadoop's shaded jars
    as_is = {"io.compression.codecs": codec.CLASSNAME, codec.OPT_EXTENSION: ".gz"}
    raw = own.read.options(lineSep="\n", **as_is).text(list(files)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("piece")
    )
    out = in_session(raw, spark).mapInArrow(_inflate, _SCHEMA)
    return out.select("path", "line_no", F.col("raw").cast("string").alias("raw"), "partial", "status")
