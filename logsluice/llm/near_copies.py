"""Near copies by the Jaccard similarity of five-word shingles, found by SimHash and then checked.

Texts with equal sets of shingles are one class, and only classes are compared:

1. Candidates. A class has a 64-bit SimHash of its set, the size of the set and a count of its shingles
   per bucket of their hashes. Sizes of similar sets differ by a quarter at most, so a tile is a band of
   sizes that meets itself and the next band. Inside a pair of tiles numpy compares all with all by
   exclusive-or and bit counts. Pairs within ``RADIUS`` bits stay if their counts allow the similarity, a
   bound that no similar pair fails.
2. Check. The candidates' components are few and small beside the table. Inside each of them all
   sets are compared exactly, by an index of the shingles, and only pairs that are similar link.

The radius is the only condition that a similar pair can fail. On sf0.1 all 48 similar pairs of classes (compared
without a radius) lie within 17 bits; on larger tables pairs beyond 22 are not ruled out. Shingles are 64-bit hashes.

Texts are moved twice, by id: to the candidates and to the choice. Scratch tables go when the choice is made.

Texts of five words or less are one shingle. Null and blank texts have none and are one class. Texts may be of any length that a task holds.
Repeated rows and rows sharing an id are rows of their own; of rows with the chosen id and set the least text stays. Extra columns stay as
they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import drop_shared, write_shared
from .components import connected_components
from .tiles import compare_in_tiles, forest

#: Words in a shingle, and the least similarity that links as a fraction.
WIDTH, SIMILAR = 5, (4, 5)
#: Differing bits of a candidate.
RADIUS = 22
#: Buckets of a set's counts at least, and shingles for one bucket in larger sets: with too few, chance alone makes the counts of two large
#: sets agree. A count above 255 is kept as 255, which only weakens the bound.
BUCKETS, PER_BUCKET = 256, 4
#: Classes of a tile at least and at most; between them a band has ``PARTS`` tiles, so that its rows visit few.
TILE_ROWS, PARTS = (2048, 1 << 17), 2
#: Shingles of a component that are indexed at a time, about.
INDEXED = 1 << 21
#: Cells of a comparison that stay in a core's cache, and pairs whose counts are compared at a time.
_CELLS, _PAIRS = 1 << 17, 1 << 13
_CHUNK = 1 << 16
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()  # bytes.lower knows A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * _ODD + h[k:k + n]
        out ^= out >> np.uint64(32)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(33)))


def class_of(some: np.ndarray) -> bytes:
    """A 128-bit hash of a set."""
    return xxhash.xxh3_128_digest(some.tobytes())


def fingerprint(some: np.ndarray) -> int:
    """64 signed bits; a bit is set if it is set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(some), _CHUNK):
        bits = np.unpackbits(some[lo:lo + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(some), bitorder="little").view(np.int64)[0])


def counts(some: np.ndarray) -> bytes:
    """How many shingles have each value of their leading bits; a power of two of buckets that grows with the set."""
    bits = max(BUCKETS.bit_length() - 1, (len(some) // PER_BUCKET).bit_length())
    each = np.bincount((some >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(each, 255).astype(np.uint8).tobytes()


def _similar(shared, a, b):
    """Whether sets of a and b shingles that share so many are similar, in whole numbers."""
    num, den = SIMILAR
    return shared * (num + den) >= num * (a + b)


def _marks(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                s = shingles(t.as_py())
                rows.append((class_of(s), len(s), fingerprint(s), counts(s)))
            digest, n, fp, vec = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(vec, pa.binary()),
            ], ["doc_id", "digest", "n", "fp", "vec"])

    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, digest binary, n long, fp long, vec binary")


def classes_of(marks: DataFrame) -> DataFrame:
    """(digest, first, n, fp, vec, cls): a row per set of shingles, with its least id; ``cls`` numbers the sets."""
    rows = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "vec")])
    return write_shared(rows.withColumn("cls", F.monotonically_increasing_id()), "near-classes")


def _buckets(rows: dict) -> int:
    return min(map(len, rows["vec"]))


def _matrix(rows: dict, size: int) -> np.ndarray:
    """The counts of some classes in ``size`` buckets; finer ones are added up."""
    if rows.get("_size") != size:
        rows["_size"], rows["_m"] = size, np.empty((len(rows["vec"]), size), np.uint8)
        for k, v in enumerate(rows["vec"]):
            each = np.frombuffer(v, np.uint8)
            rows["_m"][k] = each if len(each) == size else np.minimum(each.reshape(size, -1).sum(axis=1, dtype=np.int64), 255)
    return rows["_m"]


class _Links:
    """Pairs of 0..size-1, reduced to a forest now and then."""

    def __init__(self, size: int):
        self.label, self.pairs, self.held = np.arange(size), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.pairs.append((i, j))
        self.held += len(i)
        if self.held > len(self.label):
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*self.pairs)) if self.pairs else (np.zeros(0, np.int64),) * 2
        node, root = forest(i, j, len(self.label))
        self.label = np.arange(len(self.label))
        self.label[node] = root
        self.pairs, self.held = [(node, root)], 0
        return node, root

    def edges(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = self.reduce()
        a, b = names[a], names[b]
        differ = a != b
        if differ.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[differ]), pa.array(b[differ])], ["a", "b"])


def _in_parts(rows: DataFrame, key: str, data: list[str]) -> DataFrame:
    """``rows`` (key, parts, cls, ...) at home in a part of their key, and as visitors of its later parts."""
    own = rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    beside = own.where("part + 1 < parts").select(
        key, F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), *data
    )
    return own.select(key, "part", F.lit(0).alias("role"), *data).unionByName(beside)


def candidates(classes: DataFrame, radius: int = RADIUS, tile_rows: tuple[int, int] = TILE_ROWS) -> DataFrame:
    """Edges (a, b) that connect the classes (cls, n, fp, vec) that may be similar."""
    num, den = SIMILAR
    # A little wider than the ratio, so that no rounding takes a similar pair two bands apart.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num + 1e-4))).cast("int")
    rows = classes.where("n > 0").select("cls", "n", "fp", "vec", band.alias("band"))
    size = F.count(F.lit(1))
    least, most = tile_rows
    each = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(size / PARTS)))
    # One row per band, a hundred at most.
    bands = write_shared(rows.groupBy("band").agg(F.ceil(size / each).cast("int").alias("parts")), "bands")
    tiled = _in_parts_of_bands(rows, bands)

    def compare(key: tuple, home: dict, visitors: dict | None) -> Iterator[pa.RecordBatch]:
        other = home if visitors is None else visitors
        h, v, offset = home["fp"].view(np.uint64), other["fp"].view(np.uint64), 0 if visitors is None else len(home["fp"])
        size = min(_buckets(home), _buckets(other))
        hm, vm, hn, vn = _matrix(home, size), _matrix(other, size), home["n"], other["n"]
        links = _Links(len(h) + (len(v) if offset else 0))
        step = max(1, _CELLS // len(h))
        for lo in range(0, len(v), step):
            i, j = np.nonzero(np.bitwise_count(h[:, None] ^ v[None, lo:lo + step]) <= radius)
            j = j + lo
            keep = _similar(np.minimum(hn[i], vn[j]), hn[i], vn[j]) & (links.label[i] != links.label[j + offset])
            if not offset:
                keep &= i < j
            i, j = i[keep], j[keep]
            for k in range(0, len(i), _PAIRS):
                p, q = i[k:k + _PAIRS], j[k:k + _PAIRS]
                x, y = hm[p], vm[q]
                own = (x - np.minimum(x, y)).sum(axis=1, dtype=np.int32)
                fits = _similar(hn[p] - own, hn[p], vn[q])
                if fits.any():
                    links.add(p[fits], q[fits] + offset)
        yield from links.edges(np.concatenate([home["cls"], other["cls"]]) if offset else home["cls"])

    return compare_in_tiles(tiled, ["band", "part"], compare, "a long, b long")


def _in_parts_of_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Classes at home in a part of their band, and visiting its later parts and all parts of the next band."""
    data = ["cls", "n", "fp", "vec"]
    ahead = rows.withColumn("band", F.col("band") + 1).join(F.broadcast(bands), "band").select(
        "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), *data
    )
    return _in_parts(rows.join(F.broadcast(bands), "band"), "band", data).unionByName(ahead)


def similar_edges(documents: DataFrame, members: DataFrame, indexed: int = INDEXED) -> DataFrame:
    """Edges (a, b) that connect the similar ones among ``members`` (component, cls, digest, n, first) of each component.

    ``documents`` has doc_id and text; ``first`` is an id of a document of the class.
    """
    load = F.sum("n")
    parts = members.groupBy("component").agg(F.ceil(load / indexed).cast("int").alias("parts"))
    wanted = members.join(parts, "component").select("component", "parts", "cls", "digest", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a class is sent once by a task, however often its row is repeated
        for b in batches:
            kept, sets = [], []
            for k, (t, c) in enumerate(zip(b.column("text"), b.column("digest").to_pylist())):
                if c in seen:
                    continue
                s = shingles(t.as_py())
                if class_of(s) == c:
                    seen.add(c)
                    kept.append(k)
                    sets.append(s.tobytes())
            some = b.select(["component", "parts", "cls"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sets, pa.binary())], ["component", "parts", "cls", "body"])

    # One plan at every size: texts meet what is wanted by id.
    texts = documents.join(wanted.hint("shuffle_hash"), documents["doc_id"].eqNullSafe(wanted["first"])).select("component", "parts", "cls", "digest", "text")
    sets = texts.mapInArrow(read, "component long, parts int, cls long, body binary")
    sets = write_shared(sets, "shingle-sets")

    def index(home: dict) -> tuple:
        if "_i" not in home:
            each = [np.frombuffer(s, np.uint64) for s in home["body"]]
            n = np.array([len(s) for s in each])
            flat, of = np.concatenate(each), np.repeat(np.arange(len(each)), n)
            order = np.argsort(flat, kind="stable")
            home["_i"] = flat[order], of[order], n, each
        return home["_i"]

    def compare(key: tuple, home: dict, visitors: dict | None) -> Iterator[pa.RecordBatch]:
        keys, of, n, own = index(home)
        some = own if visitors is None else [np.frombuffer(s, np.uint64) for s in visitors["body"]]
        offset = 0 if visitors is None else len(n)
        links = _Links(len(n) + (len(some) if offset else 0))
        for j, s in enumerate(some):
            lo, hi = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
            found = hi - lo
            at = np.repeat(lo - np.cumsum(found) + found, found) + np.arange(found.sum())
            shared = np.bincount(of[at], minlength=len(n))
            i = np.flatnonzero(_similar(shared, n, len(s)))
            links.add(i, np.full(len(i), j + offset))
        yield from links.edges(np.concatenate([home["cls"], visitors["cls"]]) if offset else home["cls"])

    return compare_in_tiles(_in_parts(sets, "component", ["cls", "body"]), ["component", "part"], compare, "a long, b long")


def _best(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """(first, digest, many) of the class that stands for each component; ``many`` rows of the table have the id ``first``."""
    classes = classes_of(marks)
    near = connected_components(candidates(classes))
    members = write_shared(
        near.withColumnRenamed("node", "cls").join(classes.select("cls", "digest", "n", "first"), "cls"), "near-members"
    )
    groups = connected_components(similar_edges(documents, members))
    named = classes.select("cls", "digest", "first").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    least = named.groupBy(F.coalesce("component", "cls").alias("_c")).agg(F.min(F.struct(F.col("first").isNull(), "first", "digest")).alias("_b"))
    ids = marks.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("many"))
    best = least.select("_b.first", "_b.digest")
    out = write_shared(best.join(ids, best["first"].eqNullSafe(ids["_id"])).drop("_id"), "near-best")
    for table in (classes, near, members, groups):
        drop_shared(table)
    return out


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` that stand for their component: one each, of the least id (null only if
    there is no other)."""
    marks = write_shared(_marks(documents, doc_id, text), "near-marks")
    rows = documents.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    best = _best(rows.select("doc_id", "text"), marks)
    drop_shared(marks)
    alone, others = best.where("many = 1").select("first"), best.where("many > 1")
    # An id of one row names that row.
    kept = rows.join(alone.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(alone["first"]), "left_semi").select("row")
    if others.limit(1).count():
        kept = kept.unionByName(_of_shared_ids(rows, others))
    return kept.select([F.col("row").getField(c).alias(c) for c in documents.columns])


def _of_shared_ids(rows: DataFrame, best: DataFrame) -> DataFrame:
    """One row each for chosen classes whose id other rows have too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [class_of(shingles(t.as_py())) for t in b.column(b.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.binary())], [*b.schema.names, "own"])

    ids = best.select("first").distinct()
    some = rows.join(ids, rows["doc_id"].eqNullSafe(ids["first"]), "left_semi")
    some = some.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("own", T.BinaryType())]))
    found = some.join(best, some["doc_id"].eqNullSafe(best["first"]) & (some["own"] == best["digest"]))
    # Rows that repeat the chosen one: any of them will do, so the first by their texts; Spark keeps one per task before it shuffles.
    place = F.row_number().over(Window.partitionBy("first", "digest").orderBy("text"))
    return found.withColumn("place", place).where("place = 1").select("row")
