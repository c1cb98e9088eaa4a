"""Repair of conversations by a lightest derivation.

A repaired conversation's roles read ``(s?(ua)+)?`` by their initials. Edits per row are Keep, Rerole, Delete and, anywhere, Insert
of an empty turn. An item says: the rows from k on can be repaired if the roles before them ended in this state of the
pattern's automaton. Its weight is (cost, audit), the audit being the initials of the edits. Deductions put one edit before an
item, or a block of rows before what follows it:

* Items wait in an agenda ordered by (cost, rows covered, audit) and the lightest is final when it is popped. A deduction adds
  to cost or rows and puts the same letters before an audit, so it is monotone and its result is heavier than its antecedent, as Knuth's
  generalisation of shortest paths asks. Rows covered stand between cost and audit because Keep costs nothing; items that
  compete for one place cover the same rows, so among them (cost, audit) decides.
* Of two audits of equal cost for the same rows none begins with the other, since one of them would hold more inserts. So a lightest derivation
  is made of lightest derivations of its blocks, and blocks need only their lightest audit between each two states.

Rows are sorted by ranges of (conversation, turn), so a conversation that holds a third of all rows is spread over
many tasks and blocks; one row per block and pair of states goes on to the fold, which chains blocks without copying audits. Texts
are not moved for that. Equal rows are counted before they are shuffled. A conversation's text passes one task once, a
batch at a time, where its turns are written or hashed: a SHA-256 can't be taken in parts.

Rows of a conversation are ordered by turn, null turns first, and rows of one turn by the SHA-256 of role and text. Null roles and texts
count as one space, null conversation ids are a conversation. Turns may be negative; a gap beyond 64 bits is the largest number.
Roles are judged by their first character, so an empty one is illegal. Extra columns are ignored, whatever their names. An empty table gives
an empty result. A conversation's audit and any single text must fit in a task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import write_shared

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: Rows of a block.
BLOCK = 512
_BLANKS = " \t\n\x0b\x0c\r"
#: Initials of roles; codes hold a row's initial, whether it must go, and whether it is cut short.
_S, _U, _A, _OTHER = range(4)
_FORCED, _SHORT = 4, 8
#: States: nothing yet, after s, after u, after a. The first and the last may end a conversation.
_STATES, _ENDS = range(4), (0, 3)
_BEFORE = {(_S, 1): (0,), (_U, 2): (0, 1, 3), (_A, 3): (2,)}
#: An audit's letter for a Delete that is required; never compared with that of another, as no row allows both.
_MUST = "C"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by ``crc32(conv_id:turn) % 20``: 0 drops the row, 1 empties its text, 2 takes its
    full stops and marks away, 3 repeats it, 4 makes it the user's. Nulls read as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, code): the digest names role and text."""
    ends = F.rtrim(F.col("text"), F.lit(_BLANKS))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", _S).when(first == "u", _U).when(first == "a", _A).otherwise(_OTHER)
    short = F.when((ends != "") & ~F.right(ends, F.lit(1)).isin(".", "!", "?"), _SHORT).otherwise(0)
    named = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    return plain.select(
        "*", F.substring(F.unhex(named), 1, 16).alias("digest"),
        (initial + short + F.when(ends == "", _FORCED).otherwise(0)).cast("int").alias("code"),
    )


def lightest(codes: Iterable[int], ends: Iterable[int], starts: Iterable[int]) -> dict[int, tuple[int, str]]:
    """For each state of ``starts`` the lightest (cost, audit) that leads over all rows to one of ``ends``."""
    codes, wanted, out = tuple(codes), set(starts), {}
    agenda = [(0, 0, "", len(codes), s) for s in ends]
    heapq.heapify(agenda)
    done = set()
    push = heapq.heappush
    while agenda:
        cost, rows, audit, k, s = heapq.heappop(agenda)
        if (k, s) in done:
            continue
        done.add((k, s))
        if k == 0 and s in wanted:
            out[s] = (cost, audit)
            wanted.discard(s)
            if not wanted:
                break
        for initial in (_U, _A):
            for p in _BEFORE.get((initial, s), ()):
                if (k, p) not in done:
                    push(agenda, (cost + INSERT, rows, "I" + audit, k, p))
        if not k:
            continue
        code = codes[k - 1]
        if code & _FORCED:
            push(agenda, (cost + DELETE, rows + 1, _MUST + audit, k - 1, s))
            continue
        push(agenda, (cost + DELETE, rows + 1, "D" + audit, k - 1, s))
        more = cost + (CUT_SHORT if code & _SHORT else 0)
        for initial in (_S, _U, _A):
            if initial == code & 3:
                letter, price = "K", KEEP
            elif initial != _S:
                letter, price = "R", REROLE
            else:
                continue
            for p in _BEFORE.get((initial, s), ()):
                if (k - 1, p) not in done:
                    push(agenda, (more + price, rows + 1, letter + audit, k - 1, p))
    return out


@lru_cache(1 << 14)
def _goal(codes: bytes) -> tuple[int, str]:
    return lightest(codes, _ENDS, (0,))[0]


def _between(codes: bytes) -> tuple[list[int], list[str]]:
    """Costs and audits of a block from each state to each; a cost of -1 where there is no way."""
    each = [lightest(codes, (t,), _STATES) for t in _STATES]
    ways = [each[t].get(s, (-1, "")) for s in _STATES for t in _STATES]
    return [c for c, _ in ways], [a for _, a in ways]


_COUNTS = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]
_EDGES = ["first", "last", "first_turn", "last_turn"]
_LEGAL = {(_S, _U), (_U, _A), (_A, _U)}
_PIECE = (
    "conv_id long, seq long, whole boolean, " + ", ".join(f"{c} long" for c in _COUNTS + _EDGES)
    + ", cost long, audit string, costs array<long>, audits array<string>"
)


class _Piece:
    """A block of a conversation's rows while they are read; counts don't include what lies between blocks."""

    def __init__(self):
        self.codes = bytearray()
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, code: int) -> None:
        self.codes.append(code & (3 | _FORCED | _SHORT))
        self.n += 1
        initial = code & 3
        if self.first is None:
            self.first = initial
        elif (self.last, initial) not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self, conv: int | None, seq: int, whole: bool) -> tuple:
        some = tuple(getattr(self, c) for c in _COUNTS + _EDGES)
        codes = bytes(self.codes)
        result = (*_goal(codes), None, None) if whole else (None, None, *_between(codes))
        return (conv, seq, whole, *some, *result)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_PIECE_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS + _EDGES],
     ("cost", pa.int64()), ("audit", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def _pieces(ordered: DataFrame, block: int) -> DataFrame:
    """Blocks of the sorted rows (conv_id, turn, code, again, m); ``whole`` ones need no other block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, rows, piece, conv, opened, begun = TaskContext.get().partitionId() << 32, [], None, None, 0, False

        def close(whole: bool) -> None:
            nonlocal seq, opened
            rows.append(piece.row(conv, seq, whole))
            seq, opened = seq + 1, opened + 1

        for b in batches:
            for c, turn, code, again, m in zip(*[x.to_pylist() for x in b.columns]):
                if piece is None or c != conv:
                    if piece is not None:
                        # The task's first and last conversations may go on in its neighbours.
                        close(begun and not opened)
                        begun = True
                    piece, conv, opened = _Piece(), c, 0
                for k in range(m):
                    if piece.n == block:
                        close(False)
                        piece = _Piece()
                        if len(rows) >= 64:
                            yield _batch(rows, _PIECE_ARROW)
                            rows.clear()
                    if code & _FORCED:
                        piece.blank += 1
                        piece.add(turn, code)
                    elif again or k:
                        piece.duplicate += 1
                        piece.add(turn, code | _FORCED)
                    else:
                        piece.truncated += bool(code & _SHORT)
                        piece.add(turn, code)
            if len(rows) >= 1024:
                yield _batch(rows, _PIECE_ARROW)
                rows.clear()
        if piece is not None:
            close(False)
        if rows:
            yield _batch(rows, _PIECE_ARROW)

    return ordered.mapInArrow(run, _PIECE)


def _letters(chain: tuple | None) -> Iterator[str]:
    while chain:
        yield chain[0]
        chain = chain[1]


def _lighter(a: tuple[int, tuple | None], b: tuple[int, tuple | None]) -> bool:
    """Whether (cost, chain of audits) ``a`` is lighter; what both share is not read."""
    if a[0] != b[0]:
        return a[0] < b[0]
    x, y, p, q = a[1], b[1], "", ""
    while True:
        while not p and x:
            p, x = x
        while not q and y:
            q, y = y
        if not p or not q:
            return not p and bool(q)
        n = min(len(p), len(q))
        if p[:n] != q[:n]:
            return p[:n] < q[:n]
        p, q = p[n:], q[n:]
        if x is y and not p and not q:
            return False


class _Fold:
    """The blocks of one conversation, taken from the last to the first."""

    def __init__(self):
        self.best: list[tuple[int, tuple | None] | None] = [(0, None) if s in _ENDS else None for s in _STATES]
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.edges = dict.fromkeys(_EDGES)

    def before(self, r: dict) -> None:
        new: list = [None] * 4
        for s in _STATES:
            for t in _STATES:
                cost, rest = r["costs"][4 * s + t], self.best[t]
                if cost >= 0 and rest is not None:
                    way = (cost + rest[0], (r["audits"][4 * s + t], rest[1]))
                    if new[s] is None or _lighter(way, new[s]):
                        new[s] = way
        self.best = new
        for c in _COUNTS:
            self.counts[c] += r[c]
        e = self.edges
        if r["last"] is not None and e["first"] is not None:
            self.counts["illegal"] += (r["last"], e["first"]) not in _LEGAL
        if r["last_turn"] is not None and r["last_turn"] == e["first_turn"]:
            self.counts["turns"] -= 1
        for first, last in (("first", "last"), ("first_turn", "last_turn")):
            if r[first] is not None:
                e[first] = r[first]
                e[last] = r[last] if e[last] is None else e[last]

    def row(self, conv: int | None) -> tuple:
        cost, chain = self.best[0]
        return (conv, *[self.counts[c] for c in _COUNTS[1:]], self.edges["first_turn"], self.edges["last_turn"], cost, "".join(_letters(chain)))


_PLAN = ["conv_id", *_COUNTS[1:], "first_turn", "last_turn", "cost", "audit"]


def _folded(pieces: DataFrame) -> DataFrame:
    """One row per conversation of several blocks."""
    schema = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in _PLAN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, conv = None, None
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in b.schema.names}
                if fold is None or r["conv_id"] != conv:
                    if fold is not None:
                        yield _batch([fold.row(conv)], schema)
                    fold, conv = _Fold(), r["conv_id"]
                fold.before(r)
        if fold is not None:
            yield _batch([fold.row(conv)], schema)

    some = pieces.select("conv_id", "seq", *_COUNTS, *_EDGES, "costs", "audits")
    ready = some.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.desc("seq"))
    return ready.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in _PLAN))


def plan_repairs(rows: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit, edits), a row per conversation of ``rows``
    (conv_id, turn, role, text) and of ``ids`` (conv_id).

    A row's first fault counts: blank, duplicate (of an earlier role and text), truncated. ``edits`` is the audit with
    required deletes told apart; ``repaired_turns`` needs it.
    """
    marked = _marked(rows)
    slim = marked.groupBy("conv_id", "turn", "digest", "code").agg(F.count(F.lit(1)).alias("m"))
    # Null turns come first, also inside a struct.
    firsts = slim.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(F.struct("turn")).alias("_first"))
    met = slim["conv_id"].eqNullSafe(firsts["_conv"]) & (slim["digest"] == firsts["_digest"])
    told = slim.join(firsts, met).select("conv_id", "turn", "digest", "code", (~F.col("_first.turn").eqNullSafe(F.col("turn"))).alias("again"), "m")
    if ids is not None:
        none = F.lit(None)
        told = told.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
            "conv_id", none.cast("long").alias("turn"), none.cast("binary").alias("digest"), F.lit(0).alias("code"),
            F.lit(False).alias("again"), F.lit(0).cast("long").alias("m"),
        ))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest")]
    ordered = told.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "code", "again", "m")
    pieces = write_shared(_pieces(ordered, block), "conversation-pieces")
    plans = pieces.where("whole").select(*_PLAN).unionByName(_folded(pieces.where("NOT whole")))
    most = F.lit(2.0**63)
    gaps = F.when(
        F.col("last_turn").cast("double") - F.col("first_turn").cast("double") >= most, F.lit((1 << 63) - 1)
    ).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"))
    return plans.select(
        "conv_id", "blank", "duplicate", "truncated", "illegal", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), "cost",
        F.translate("audit", _MUST, "D").alias("audit"), F.col("audit").alias("edits"),
    )


class _Turns:
    """Applies a conversation's edits to its rows in order."""

    def __init__(self, edits: str):
        self.edits, self.at, self.user = edits, 0, True

    def _next(self, role: str | None, text: str, initial: str) -> tuple[str, str]:
        if role is None:
            role = "user" if self.user else "assistant"
            initial = role[0]
        if initial != "s":
            self.user = not self.user
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.edits[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._next(None, "", "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            yield self._next(role, text, role[0])
        elif edit == "R":
            yield self._next(None, text, "")


def _lead(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Edits and, behind them, the rows of each conversation, sorted."""
    own = _marked(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    none = F.lit(None)
    edits = plans.select(
        "conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("binary").alias("digest"),
        F.lit("").alias("role"), F.col("edits").alias("text"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "digest")]
    return edits.unionByName(own).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """Each conversation with its repaired turns, which must be read before the next one."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), (t.as_py() for t in b.column(3))))
    ahead = next(rows, None)

    def turns(edits: str) -> Iterator[tuple[str, str]]:
        nonlocal ahead
        state = _Turns(edits)
        while (ahead := next(rows, None)) is not None and ahead[1]:
            yield from state.row(ahead[2], ahead[3])
        yield from state.inserted()

    while ahead is not None:
        yield ahead[0], turns(ahead[3])


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, their turns numbered from 0."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, turns in _repaired(batches):
            for place, (role, text) in enumerate(turns):
                out.append((conv, place, role, text))
                size += len(text)
                if len(out) == 1024 or size > 1 << 20:
                    yield _batch(out, schema)
                    out, size = [], 0
        if out:
            yield _batch(out, schema)

    return _lead(rows, plans).mapInArrow(run, "conv_id long, place long, role string, text string")


def repaired_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired turns as ``role:text``, joined by line feeds."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, turns in _repaired(batches):
            h, between = hashlib.sha256(), b""
            for role, text in turns:
                h.update(between + f"{role}:{text}".encode())
                between = b"\n"
            out.append((conv, h.hexdigest()))
            if len(out) == 1024:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return _lead(rows, plans).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``plan_repairs`` and the digest of each repaired conversation."""
    plans = write_shared(plan_repairs(rows, ids, block), "conversation-plans")
    digests = repaired_digests(rows, plans).withColumnRenamed("conv_id", "_conv")
    return plans.drop("edits").join(digests, plans["conv_id"].eqNullSafe(digests["_conv"])).drop("_conv")
