"""SimHash near-duplicates by tiled exact comparison.

``fingerprints`` gives each whole text 64 bits. Equal fingerprints are one class, and only classes
are compared. A class's tile is the population count of each 16-bit quarter of its fingerprint:
the counts of two fingerprints within a radius differ by at most that radius in sum, so a tile
meets only the tiles whose counts lie that close, and the others are skipped as a whole. Inside a
pair of tiles numpy compares all with all by exclusive-or and bit counts. Large tiles are split,
visitors go to each part, and a part streams them in batches.

What a comparison finds is reduced to a spanning forest on the spot, so a group of thousands of
near copies gives about as many edges as rows.

Null and blank texts have the fingerprint zero, which links like any other. Repeated rows and rows
sharing an id are rows of their own with one fingerprint's component. Null ids get a component as
well; they never name one unless all ids of it are null. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import write_shared
from .components import connected_components
from .tiles import CELLS, compare_in_tiles, forest

#: Words in a shingle and seed of its hash.
SHINGLE, SEED = 3, 42
#: Differing bits that still link.
RADIUS = 3
#: Fingerprints of a tile held at a time.
TILE_ROWS = 8192
#: Shingles hashed at a time, which bounds the memory a very long text takes.
_CHUNK = 1 << 16
#: Packing of four counts, with room for a difference on either side.
_BASE, _SHIFT = 32, 4


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is set if it is set in over half the hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes.lower knows A-Z only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(b" ".join(words), seed)
    total, n = np.zeros(64, np.int64), len(words) - width + 1
    for lo in range(0, n, _CHUNK):
        part = words[lo:min(n, lo + _CHUNK) + width - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(width)]))
        h = np.fromiter((hashed(s, seed) for s in shingles), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _tile(fp: Column) -> Column:
    """Packed population counts of the four quarters."""
    out = F.lit(0)
    for q in range(4):
        count = F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))) + _SHIFT
        out = out + count * _BASE ** q
    return out.cast("int")


def _ahead(radius: int) -> list[int]:
    """Differences of packed counts within the radius, of each opposite pair the positive one."""
    steps = itertools.product(range(-radius, radius + 1), repeat=4)
    packed = [sum(d * _BASE ** q for q, d in enumerate(s)) for s in steps if sum(map(abs, s)) <= radius]
    return sorted(p for p in packed if p > 0)


def near_edges(classes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) that connect the distinct ``fp`` of ``classes`` within ``radius`` differing bits."""
    if radius > _SHIFT:
        raise ValueError("the packing of counts allows a radius of 4 at most")
    tiles = classes.select("fp", _tile(F.col("fp")).alias("tile"))
    # One row per occupied tile, 17 ** 4 at most, whatever the number of documents.
    parts = tiles.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("parts"))
    own = tiles.join(F.broadcast(parts), "tile").withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    )
    home = own.select("tile", "part", F.lit(0).alias("role"), "fp")
    # A row visits the later parts of its own tile and every part of the tiles ahead.
    beside = own.where("part + 1 < parts").select(
        "tile", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "fp"
    )
    steps = F.array(*[F.lit(s) for s in _ahead(radius)])
    ahead = tiles.select("fp", F.explode(F.transform(steps, lambda s: F.col("tile") + s)).alias("tile")).join(
        F.broadcast(parts), "tile"
    ).select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "fp")

    def compare(key: tuple, home: dict, visitors: dict | None) -> Iterator[pa.RecordBatch]:
        h = home["fp"].view(np.uint64)
        v = h if visitors is None else visitors["fp"].view(np.uint64)
        step = max(1, CELLS // len(h))
        for lo in range(0, len(v), step):
            some = v[lo:lo + step]
            i, j = np.nonzero(np.bitwise_count(h[:, None] ^ some[None, :]) <= radius)
            if visitors is None:
                keep = i < j + lo
                i, j = i[keep], j[keep]
            if len(i):
                both = np.concatenate([h, some]).view(np.int64)
                a, b = forest(i, j + len(h), len(both))
                differ = both[a] != both[b]
                yield pa.RecordBatch.from_arrays([pa.array(both[a][differ]), pa.array(both[b][differ])], ["a", "b"])

    rows = home.unionByName(beside).unionByName(ahead)
    return compare_in_tiles(rows, ["tile", "part"], compare, "a long, b long")


def _with_component(prints: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """(fp, component, first): each distinct fingerprint with the least one reachable and its least id."""
    classes = write_shared(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-classes")
    groups = connected_components(near_edges(classes.select("fp"), radius, tile_rows))
    return classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "first"
    )


def simhash_components(
    documents: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, doc_id: str = "doc_id",
    text: str = "text", width: int = SHINGLE,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: 16 hex digits, and the least id reachable."""
    prints = write_shared(fingerprints(documents, doc_id, text, width), "fingerprints")
    named = _with_component(prints, radius, tile_rows)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    documents: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, doc_id: str = "doc_id", text: str = "text",
    width: int = SHINGLE,
) -> DataFrame:
    """The rows of ``documents`` that stand for their component: one each, of the least id (null only if
    there is no other)."""
    prints = write_shared(fingerprints(documents, doc_id, text, width), "fingerprints")
    named = _with_component(prints, radius, tile_rows)
    best = named.groupBy("component").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("_b")).select(
        F.col("_b.first").alias("_id"), F.col("_b.fp").alias("_fp")
    )
    rows = _with_fingerprint(documents, text, width)
    found = rows.join(best, rows[doc_id].cast("long").eqNullSafe(best["_id"]) & (rows["_own"] == best["_fp"]))
    # Rows that repeat the chosen one: any of them will do, so the first by their texts.
    place = F.row_number().over(Window.partitionBy("_id", "_fp").orderBy(text))
    return found.withColumn("_n", place).where("_n = 1").select(documents.columns)


def _with_fingerprint(documents: DataFrame, text: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(at)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], [*b.schema.names, "_own"])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("_own", T.LongType())]))
