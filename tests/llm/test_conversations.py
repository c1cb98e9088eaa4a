import hashlib
import itertools
import random
import re
import zlib

import pytest

from logsluice.llm import conversations as C
from logsluice.llm.queries import QUERIES

GOOD = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def ordered(rows):
    def key(r):
        name = hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        return (r[1] is not None, r[1] or 0, name)
    return sorted(rows, key=key)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        if not text.strip(BLANK):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(BLANK)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(rows):
    """The contract for one conversation, by a table of all prefixes and the roles they end in."""
    rows = ordered(rows)
    bad = faults(rows)
    # Keyed by the role initials so far, cut to what the pattern still needs to know.
    def state(initials):
        return ("" if not initials else initials[-1]) if len(initials) < 2 else initials[-1]

    def step(s, x):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((s, x))

    def insertions(best):
        for _ in range(3):
            for s, (cost, audit, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    t = step(s, role[0])
                    if t is not None:
                        way = (cost + 5, audit + "I", turns + [f"{role}:"])
                        best[t] = min(best.get(t, way), way)
        return best

    best = insertions({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, bad):
        new = {}
        for s, (cost, audit, turns) in best.items():
            ways = [(s, (cost + 2, audit + "D", turns))]
            if fault not in ("blank", "duplicate"):
                more = cost + (5 if fault else 0)
                ways.append((step(s, role[:1]), (more, audit + "K", turns + [f"{role}:{text}"])))
                ways += [(step(s, x[0]), (more + 1, audit + "R", turns + [f"{x}:{text}"])) for x in ("user", "assistant")]
            for t, way in ways:
                if t is not None:
                    new[t] = min(new.get(t, way), way)
        best = insertions(new)
    cost, audit, turns = min(best[s] for s in ("", "a") if s in best)
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = lambda f: sum(x == f for x in bad)
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(turns).encode()).hexdigest())


def everything(rows, ids=()):
    by = {i: [] for i in ids}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return {i: plain(rs) for i, rs in by.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def noise(seed, conversations=120):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randrange(9)):
            number = rng.choice((turn, turn, turn, turn + 2, None, -turn))
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "umpire"))
            text = rng.choice(("Yes.", "No!", "Why", "", " \n", None, "So?  ", "Off ", f"It is {turn}.", "é."))
            rows += [(conv, number, role, text)] * rng.choice((1, 1, 1, 1, 2))
    return rows


@pytest.mark.parametrize("block", (1, 3, C.BLOCK))
def test_against_a_table_of_all_prefixes(spark, block):
    rows = noise(block)
    null = [(i, t, " " if r is None else r, " " if x is None else x) for i, t, r, x in rows]
    assert got(C.repair(frame(spark, rows), block=block)) == everything(null)


def test_agenda_against_all_audits():
    """Every string of edits of small inputs, by brute force over what they make of the rows."""
    rng = random.Random(1)
    for _ in range(60):
        codes = [rng.randrange(4) | rng.choice((0, 0, 0, 4, 8)) for _ in range(rng.randrange(4))]
        found = []
        for inserts in itertools.product(range(3), repeat=len(codes) + 1):
            for edits in itertools.product("KRD", repeat=len(codes)):
                for roles in itertools.product("ua", repeat=edits.count("R") + sum(inserts)):
                    new, cost, audit, it = "", 5 * sum(inserts), "", iter(roles)
                    for k, n in enumerate(inserts):
                        new += "".join(next(it) for _ in range(n))
                        audit += "I" * n
                        if k == len(codes):
                            continue
                        code, edit = codes[k], edits[k]
                        audit += edit
                        if code & 4 and edit != "D":
                            cost += 1000
                        cost += {"K": 0, "R": 1, "D": 2}[edit] + (5 if code & 8 and edit != "D" else 0)
                        new += {"K": "suax"[code & 3], "D": ""}.get(edit) if edit != "R" else next(it)
                    if GOOD.fullmatch(new):
                        found.append((cost, audit))
        cost, audit = C.lightest(codes, (0, 3), (0,))[0]
        assert (cost, audit.replace("C", "D")) == min(found)


def test_ties_take_the_least_audit():
    # Deleting the first of two users costs what deleting the second does.
    assert C.lightest([1, 1, 2], (0, 3), (0,))[0] == (2, "DKK")
    assert C.lightest([], (0, 3), (0,))[0] == (0, "")
    assert C.lightest([0], (0, 3), (0,))[0] == (2, "D")


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [(7, k // 3, rng.choice(("user", "assistant", "system")), f"{rng.randrange(900)}{rng.choice('.!x')}") for k in range(3000)]
    rows += [(7, 20, "user", "Hm.")] * 700 + [(7, 30, "user", "")] * 700 + [(k, 0, "user", "a.") for k in range(20) if k != 7]
    assert got(C.repair(frame(spark, rows), block=64)) == everything(rows)


def test_damage_and_empty_conversations(spark):
    rows = [r for r in noise(2) if r[1] is not None]
    rows += [(i, t, "user", "Gone.") for i in range(1000, 1400) for t in (0,)]
    df = frame(spark, rows)
    out = got(C.repair(C.damage(df), df.select("conv_id")))
    want = everything(damaged(rows), {r[0] for r in rows})
    assert out == want and any(v[5:7] == (0, "") and i and i >= 1000 for i, v in out.items())


def test_extremes(spark):
    lo, hi = -(1 << 63), (1 << 63) - 1
    rows = [(1, lo, "user", "a."), (1, hi, "assistant", "b."), (2, None, "user", "a."), (3, lo, "user", "x" * 300_000), (3, lo + 5, "assistant", "y.")]
    out = got(C.repair(frame(spark, rows)))
    want = everything(rows)
    want[1] = (hi, *want[1][1:])
    assert out == want
    assert C.repair(frame(spark, [])).collect() == []


def test_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "tool", "Hi."), (1, 2, "assistant", "Yo."), (2, 0, "assistant", "Hi.")]
    df = frame(spark, rows).selectExpr("*", "1 AS kind", "'x' AS digest", "2 AS place")
    plans = C.plan_repairs(df)
    turns = sorted(tuple(r) for r in C.repaired_turns(df, plans).collect())
    assert turns == [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yo.")]
    assert {r.conv_id: r.audit for r in plans.collect()} == {1: "KRK", 2: "D"}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_conversations"](spark, sf)) == everything(damaged(rows), {r[0] for r in rows})
