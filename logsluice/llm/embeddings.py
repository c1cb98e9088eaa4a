"""Exact near-duplicate vectors by a metric range join.

Vectors are compared by angle, which is a metric, so the triangle inequality holds exactly. Equal
vectors are one class; a class belongs to its nearest pivot. Each pivot has two cells: a core, whose
vectors lie within half the join radius of the pivot, and the rest. A vector visits the
later cells that could hold a partner. Three bounds must let it in: the cell's largest and
smallest angle from the pivot, and the distance from the plane that separates the two pivots.
Cells are then joined independently of each other.

All vectors of a core link with each other by the triangle inequality; their pairs are counted and
never compared. Pivots are chosen densest first from a bounded sample, so a group of near copies
that holds a third of all rows becomes a core and costs time in proportion to its size. The sample
serves speed alone: every vector is placed, and any choice of pivots gives the same result.

Pruning depends on the data. Vectors that scatter evenly in many dimensions lie about 90 degrees
from every pivot, no bound excludes them, and the join compares nearly all pairs of classes, in
cells that stay bounded.

Null or zero vectors and those with a null or non-finite component link with nothing, and vectors
of different lengths never link. Repeated rows and rows sharing an id are vectors of their own. A
null id names no component, unless all ids of it are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import write_shared
from .components import connected_components
from .tiles import CELLS, compare_in_tiles, forest

THRESHOLD = 0.9
#: Classes that a cell holds at a time; larger cells are split.
CELL_ROWS = 4096
#: Pivots are chosen among so many classes, and are so many at most.
SAMPLE, PIVOTS = 2048, 1024
#: Slack of the bounds, far above rounding errors; it lets a vector visit in vain, never stay away.
_SLACK = 1e-6


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _digest(v: list | None) -> str | None:
    """Names a vector; null where it can't link."""
    if not v or None in v:
        return None
    x = np.asarray(v, np.float64) + 0.0  # makes -0 and 0 one
    return hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() if np.isfinite(x).all() and x.any() else None


def _with_digest(rows: DataFrame) -> DataFrame:
    """(vec_id, class, v): the digest beside the vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named = pa.array(map(_digest, b.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), named, b.column(1)], ["vec_id", "class", "v"])

    return rows.mapInArrow(run, "vec_id long, class string, v array<double>")


def choose_pivots(sample: list[np.ndarray], count: int, radius: float) -> np.ndarray:
    """Densest first: the vector with most others within ``radius`` that no chosen one covers."""
    x = _unit(sample)
    near = _angle(x @ x.T) <= radius
    free, out = np.ones(len(x), bool), []
    for _ in range(min(count, len(x))):
        weight = np.where(free, (near & free[None, :]).sum(axis=1), -1)
        best = int(weight.argmax())
        if weight[best] < 0:
            break
        out.append(best)
        free &= ~near[best]
    return x[out]


def link_components(
    embeddings: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, sample: int = SAMPLE,
    pivots: int = PIVOTS, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    ``n_links`` counts the other vectors at a cosine of ``threshold`` (above 0) or more; ``kept``
    tells whether the row's id names its component.
    """
    radius = float(np.arccos(threshold))
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    named = write_shared(_with_digest(rows), "vec-digests")
    digests = named.select("vec_id", "class")
    # The rows of a class have one vector; which row brings it doesn't matter.
    classes = write_shared(
        named.where("class IS NOT NULL").groupBy("class")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("many"), F.first("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vec-classes",
    )
    placed, stats, chosen = _place(classes, radius, cell_rows, sample, pivots)
    if not stats:
        return digests.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    found = write_shared(_join_cells(placed, stats, chosen, threshold, radius), "vec-links")
    inside = placed.where("core").join(
        F.broadcast(placed.where("core").groupBy("cell").agg(F.sum("many").alias("_all"), F.min("node").alias("_hub"))), "cell"
    )  # two rows per pivot at most
    links = (
        found.where("other IS NULL").select("node", "links")
        .unionByName(inside.select("node", (F.col("_all") - F.col("many")).alias("links")))
        .groupBy("node").agg(F.sum("links").alias("links"))
    )
    edges = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(
        inside.select(F.col("node").alias("a"), F.col("_hub").alias("b"))
    )
    groups = connected_components(edges)
    per_node = classes.select("class", "node", "first", "many").join(groups, "node", "left").join(links, "node", "left").select(
        "class", "first", F.coalesce("component", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
    )
    least = per_node.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = per_node.join(least, "component").select("class", "n_links", "component_id")
    out = digests.join(per_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _place(classes: DataFrame, radius: float, cell_rows: int, sample: int, pivots: int):
    """Classes with their cell, and per cell (cell, core, number, smallest and largest angle)."""
    number = classes.count()
    some = classes.orderBy("class").select("v").limit(sample).collect()  # the digest is as good as chance
    lengths: dict[int, list] = {}
    for r in some:
        lengths.setdefault(len(r.v), []).append(r.v)
    wanted = max(1, min(pivots, -(-number // cell_rows)))
    # At least one pivot per length of vector that the sample has.
    chosen, at = {}, 0
    for n, vs in sorted(lengths.items()):
        p = choose_pivots(vs, max(1, round(wanted * len(vs) / max(1, len(some)))), radius / 2)
        chosen[n], at = (at, p), at + len(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column(2).to_pylist()
            cell, core, angle = np.zeros(len(vs), np.int64), np.zeros(len(vs), bool), np.zeros(len(vs))
            size = np.array([len(v) for v in vs])
            for n in np.unique(size):
                here = np.flatnonzero(size == n)
                if n not in chosen:  # a length without pivots is a cell of its own
                    cell[here] = -n
                    continue
                first, p = chosen[n]
                x = _unit([vs[i] for i in here])
                d = _angle(x @ p.T)
                best = d.argmin(axis=1)
                angle[here] = d[np.arange(len(here)), best]
                core[here] = angle[here] <= radius / 2 - _SLACK
                cell[here] = 2 * (first + best) + ~core[here]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(core), pa.array(angle)],
                ["node", "many", "v", "cell", "core", "angle"],
            )

    placed = write_shared(classes.select("node", "many", "v").mapInArrow(
        run, "node long, many long, v array<double>, cell long, core boolean, angle double"
    ), "vec-placed")
    stats = placed.groupBy("cell").agg(
        F.max("core").alias("core"), F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"),
        F.max(F.size("v")).alias("length"),
    ).collect()  # two rows per pivot, one per length without pivots
    return placed, {r.cell: (r.core, -(-r.n // cell_rows), r.near, r.far, r.length) for r in stats}, chosen


def _join_cells(placed: DataFrame, stats: dict, chosen: dict, threshold: float, radius: float) -> DataFrame:
    """(node, other, links): link counts where ``other`` is null, else edges of spanning forests."""
    # Visitors go from wider cells to narrower ones, as a narrow cell's bounds turn more away.
    cells = {n: sorted((c for c, s in stats.items() if s[4] == n), key=lambda c: (-stats[c][3], c)) for n in {s[4] for s in stats.values()}}
    cells = {n: np.array(cs, np.int64) for n, cs in cells.items()}
    rank = {c: k for cs in cells.values() for k, c in enumerate(cs.tolist())}
    bounds = {n: np.array([[stats[c][2], stats[c][3]] for c in cs.tolist()]) for n, cs in cells.items()}

    def targets(n: int, vectors: list, own: np.ndarray, nodes: np.ndarray) -> Iterator[list]:
        """Per vector of length ``n``: (cell, part, role) of its home and of all it visits."""
        cs = cells[n]
        may = np.zeros((len(vectors), len(cs)), bool)
        if n in chosen:
            first, p = chosen[n]
            which, home = cs // 2 - first, own // 2 - first
            cosine = _unit(vectors) @ p.T
            d = _angle(cosine)[:, which]
            # The angle from x to the plane between pivots p and q has the sine (cos px - cos qx) / |p - q|.
            apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[home][:, which]
            lead = cosine[np.arange(len(own)), home][:, None] - cosine[:, which]
            same = home[:, None] == which[None, :]
            plane = same | (lead <= (np.sin(radius) + _SLACK) * apart + _SLACK)
            near, far = bounds[n][:, 0], bounds[n][:, 1]
            own_rank = np.array([rank[c] for c in own.tolist()])
            may = plane & (d <= far + radius + _SLACK) & (d >= near - radius - _SLACK)
            may &= np.arange(len(cs))[None, :] > own_rank[:, None]
        for k, c in enumerate(own.tolist()):
            core, parts = stats[c][:2]
            part = int(nodes[k] % parts)
            out = [(c, part, 0)]
            if not core:  # the pairs of a core are known
                out += [(c, q, 1) for q in range(part + 1, parts)]
            yield out + [(o, q, 1) for o in cs[may[k]].tolist() for q in range(stats[o][1])]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("cell", pa.int64()), ("part", pa.int32()), ("role", pa.int32())]))
        for b in batches:
            vs, own, nodes = b.column(2).to_pylist(), b.column(3).to_numpy(), b.column(0).to_numpy()
            size, out = np.array([len(v) for v in vs]), [None] * len(vs)
            for n in np.unique(size).tolist():
                here = np.flatnonzero(size == n)
                for i, t in zip(here, targets(n, [vs[i] for i in here], own[here], nodes[here])):
                    out[i] = [dict(zip(("cell", "part", "role"), x)) for x in t]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, kind)], ["node", "many", "v", "t"])

    rows = placed.select("node", "many", "v", "cell").mapInArrow(
        send, "node long, many long, v array<double>, t array<struct<cell:long,part:int,role:int>>"
    ).select("node", "many", "v", F.explode("t").alias("t")).select("t.*", "node", "many", "v")
    cores = {c for c, s in stats.items() if s[0]}

    def compare(key: tuple, home: dict, visitors: dict | None) -> Iterator[pa.RecordBatch]:
        if visitors is None and key[0] in cores:
            return
        if "x" not in home:
            home["x"] = _unit(list(home["v"]))
        other = home if visitors is None else visitors | {"x": _unit(list(visitors["v"]))}
        step = max(1, CELLS // len(home["x"]))
        for lo in range(0, len(other["x"]), step):
            i, j = np.nonzero(home["x"] @ other["x"][lo:lo + step].T >= threshold)
            j = j + lo
            if visitors is None:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            n = len(home["x"])
            nodes = np.concatenate([home["node"], other["node"]])
            count = np.zeros(len(nodes), np.int64)
            np.add.at(count, i, other["many"][j])
            np.add.at(count, j + n, home["many"][i])
            seen = np.flatnonzero(count)
            yield _links(nodes[seen], None, count[seen])
            a, b = forest(i, j + n, len(nodes))
            yield _links(nodes[a], nodes[b], None)

    return compare_in_tiles(rows, ["cell", "part"], compare, "node long, other long, links long")


def _links(node: np.ndarray, other: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
    empty = pa.nulls(len(node), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(node), empty if other is None else pa.array(other), empty if links is None else pa.array(links)],
        ["node", "other", "links"],
    )
