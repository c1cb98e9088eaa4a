"""Streams over several triggers, restarts and lost rounds."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsluice import schema as S, tables as T
from logsluice.operators import framing as W, incidents as I, search as Z
from logsluice.streaming import delivery as DL, framing as SF, lane as LN, live as L, ordered as OR


class _Map:
    """A map state without a store."""

    def __init__(self):
        self.held = {}

    def updateValue(self, key, value):
        self.held[key] = value

    def getValue(self, key):
        return self.held[key]

    def removeKey(self, key):
        del self.held[key]


class _Handle:
    def getMapState(self, *_):
        return _Map()


@pytest.mark.parametrize("frames,size,chunk", ((0, 0, 4), (1, 9, 4), (2, 1, 4), (7, 40, 3), (5, 300, 64)))
def test_frames_come_in_order(frames, size, chunk):
    rng = random.Random(size)
    parts = [pd.DataFrame({"ts_s": [rng.randrange(20) for _ in range(size)], "arrival": [rng.randrange(1000) for _ in range(size)], "v": [f"{k}-{n}" for n in range(size)]})
             for k in range(frames)]
    runs = OR.SortedRuns(_Handle(), chunk)
    got = [r for f in runs.in_order(iter(parts), ["ts_s", "arrival"]) for r in f.itertuples(index=False, name=None)]
    want = [r for f in parts for r in f.itertuples(index=False, name=None)]
    assert [r[:2] for r in got] == sorted(r[:2] for r in want) and sorted(got) == sorted(want)
    assert not runs.map.held


def test_many_frames_are_few_runs_merged_so_many_at_a_time():
    """A merge that looked at every frame for every chunk took time with the square of the rows."""
    class Counted(_Map):
        open = set()
        most = reads = 0

        def getValue(self, key):
            Counted.open.add(key[0])
            Counted.most, Counted.reads = max(Counted.most, len(Counted.open)), Counted.reads + 1
            return super().getValue(key)

        def removeKey(self, key):
            super().removeKey(key)
            if not any(run == key[0] for run, _ in self.held):
                Counted.open.discard(key[0])

    class Handle:
        def getMapState(self, *_):
            return Counted()

    rng = random.Random(5)
    order = list(range(6000))
    rng.shuffle(order)
    parts = [pd.DataFrame({"ts_s": 0, "arrival": order[lo:lo + 10]}) for lo in range(0, 6000, 10)]
    runs = OR.SortedRuns(Handle(), 25, run_rows=100, fan_in=8)
    got = [a for f in runs.in_order(iter(parts), ["ts_s", "arrival"]) for a in f["arrival"]]
    assert got == sorted(order) and not runs.map.held
    # Sixty runs in two levels: each row is read twice, eight runs at a time.
    assert Counted.most <= 8 and Counted.reads <= 2 * (6000 // 25 + 60)


class _Kept(_Map):
    def containsKey(self, key):
        return key in self.held

    def exists(self):
        return bool(self.held)


def _odd_lines(rng, n, base):
    """Lines of three sources as the stateful step gets them: out of order, with keys, ends, cut texts and clocks that go back."""
    rows = []
    for at in range(base, base + n):
        s, letter, body = rng.choice(["a", "a", "a", "b", "c"]), rng.choice("hhHpPccccCgGrRsb"), rng.random() < 0.95
        rows.append({
            "group": 1, "source_id": s, "source": s.upper(), "line_no": at, "ts_raw": f"t{at}" if rng.random() < 0.5 else None,
            "safe": rng.choice("éx") * rng.choice([0, 1, 30, 2000, 9000]) if body else "", "has_body": body,
            "mark": rng.choice(["BEGIN", "END"]) if rng.random() < 0.02 else None, "letter": letter,
            "alt": "c" if letter in "hsgbr" and rng.random() < 0.3 else letter, "py": rng.random() < 0.2, "trunc": rng.random() < 0.01,
            "changed": rng.random() < 0.05, "ambiguous": rng.random() < 0.01, "doubt": rng.random() < 0.02, "source_changed": False,
            "eof": rng.random() < 0.004, "partial": rng.random() < 0.5, "ts_us": rng.randrange(10 ** 15) if rng.random() < 0.6 else None,
        })
    rng.shuffle(rows)
    return pa.Table.from_pandas(pd.DataFrame(rows), preserve_index=False)


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_lines_as_arrays(seed, monkeypatch):
    """Many lines are one row before the stateful step, and its arrays give what following line by line gives, over three triggers."""
    class Handle:
        def getMapState(self, *_):
            return _Kept()

    rng = random.Random(seed)
    triggers = [_odd_lines(rng, 1500, 10_000 * k) for k in range(3)]
    got = []
    for many in (1, 10 ** 9):
        monkeypatch.setattr(SF, "MANY", many)
        step = SF.FrameLines(preview=seed % 2 == 0)
        step.init(Handle())
        out = []
        for lines in triggers:
            frames = [b.to_pandas() for b in OR.packed("group")(iter(lines.to_batches(max_chunksize=100)))]
            assert sum(map(len, frames)) <= 2 + lines.nbytes // OR.PACKED_BYTES
            done = [f.astype(object).where(f.notna(), None) for f in step.handleInputRows((1,), iter(frames), None)]
            out.append([r for f in done for r in f.itertuples(index=False, name=None)])
        got.append((out, step.state.held))
    assert got[0] == got[1] and len(got[0][0][0]) > 200


def source(path):
    return F.struct(*[(F.lit("file") if f.name == "type" else path if f.name == "path" else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.SOURCE.fields])


def test_framing_over_triggers_leaves_no_state(spark):
    """Batches of forty rows make runs of the hot source; every source ends, and nothing is kept."""
    texts = ["ERROR failed", "    at a.b(C.java:1)", "Caused by: x", "INFO fine", "panic: x", "main.f(0x1)", "\t/a.go:1 +0x1"]
    rng = random.Random(2)
    rows = [("hot", n, rng.choice(texts), False) for n in range(1, 900)] + [(f"s{k}", n, rng.choice(texts), False) for k in range(4) for n in range(1, 30)]
    ends = [(p, 10 ** 6, "", True) for p in ("hot", "s0", "s1", "s2", "s3")]
    df = spark.createDataFrame(rows, "path string, line_no long, raw string, eof boolean")
    all_ = df.unionByName(spark.createDataFrame(ends, df.schema)).select(source(F.col("path")).alias("source"), "line_no", "raw", "eof")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/frames-{rng.random()}"
    cuts = [(0, 250), (250, 251), (251, 700), (700, 10 ** 7)]
    parts = [all_.where((F.col("line_no") >= a) & (F.col("line_no") < b)) for a, b in cuts]
    make = lambda d: SF.frame_stream(d, with_json=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        queries = L.drain_parts(parts, make, L.table_sink(folder), state_partitions=2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    pick = ["id", "text", "line_start", "line_end", "line_count", "truncated", "parse_uncertain"]
    got = sorted(map(tuple, spark.read.parquet(folder).select(pick).collect()))
    want = sorted(map(tuple, W.frame_events(all_.where("NOT eof").drop("eof"), with_json=False).select(pick).collect()))
    assert got == want and len(got) > 200
    assert sum(o["numRowsTotal"] for o in queries[-1].lastProgress["stateOperators"]) == 0


def test_a_lane_batch_that_is_run_again(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/lane-{random.random()}"
    sink = LN.stamp_sink(folder)
    batches = [[(1, 100), (2, 90), (3, None)], [(4, 95), (5, 101)], [(6, None), (7, 100)]]
    frames = [spark.createDataFrame(b, "arrival long, ts_s long") for b in batches]
    for n in (0, 1, 1, 0, 2, 2):
        sink(frames[n], n)
    rows = spark.read.parquet(f"{folder}/rows").orderBy("arrival").select("arrival", "clock_rollback", "lane_s").collect()
    assert [tuple(r) for r in rows] == [(1, False, 100), (2, True, 100), (3, False, 100), (4, True, 100), (5, False, 101), (6, False, 101), (7, True, 101)]


def test_runs_of_seen_ids_stay_few(spark):
    """Fifty batches: a batch never reads more runs than the levels hold, and no id is lost by merging."""
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/seen-{random.random()}"
    seen = L._Seen(spark, folder, "day")
    most = 0
    for n in range(50):
        seen.merge(n)
        most = max(most, len(seen.runs(n)))
        seen.add((0, n, n), spark.createDataFrame([(f"id{n}", n % 2)], "occurrence_id string, d int").selectExpr(
            "occurrence_id", "date_add(DATE'2024-01-01', d) AS day"))
    assert most <= 2 * L.FAN and len(T.children(spark, folder)) <= 2 * L.FAN
    assert sorted(r.occurrence_id for r in seen.ids(seen.runs(50)).collect()) == sorted(f"id{n}" for n in range(50))
    assert seen.ids(seen.runs(10)).count() <= 50  # a batch that is run again looks at earlier ones alone
    days = [r[0] for r in spark.sql("SELECT DATE'2024-01-02'").collect()]
    assert seen.ids(seen.runs(50), days).count() == 25


def test_occurrences_across_merges_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN", 2)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/once-{random.random()}"
    sink, rng = L.once_sink(folder), random.Random(5)
    first = {}
    for n in range(7):
        rows = [(f"o{rng.randrange(60)}", rng.randrange(60) % 3) for _ in range(25)]
        rows = [(o, int(o[1:]) % 3) for o, _ in rows]
        df = spark.createDataFrame(rows, "occurrence_id string, d int").selectExpr("occurrence_id", "date_add(DATE'2024-01-01', d) AS day")
        for o, _ in rows:
            first.setdefault(o, n)
        for _ in range(2 if n in (3, 6) else 1):  # run again after its results were written
            sink(df, n)
    got = L.applied(spark, folder).collect()
    assert {r.occurrence_id: r.batch for r in got} == first and len(got) == len(first)


def test_outbox_goes_on_from_its_last_complete_version(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/box-{random.random()}"
    rows = spark.createDataFrame([(f"{k:x}", "i", "{}", "pending", 0, 10, 10) for k in range(4)], DL.BOX)
    box = DL.Outbox(spark, folder)
    box.add(rows)
    box.add(rows)  # nothing new
    assert box.pending().count() == 4
    refused = lambda key, payload: (_ for _ in ()).throw(OSError()) if key == "0" else None
    box.lease(100)
    # A run that died while it wrote the next version: settled rows without pending ones don't count.
    rows.limit(1).withColumn("status", F.lit("dead")).write.parquet(f"{folder}/settled/{box.version() + 1:08d}")
    again = DL.Outbox(spark, folder)
    assert again.settled().count() == 0 and again.leased(100).count() == 4
    again.round(110, refused)
    assert {r.attempts for r in again.pending().collect()} == {1}  # still leased
    now = 130
    for _ in range(9):
        again.round(now, refused)
        now += 300
    assert {r.notification_id: (r.status, r.attempts) for r in again.settled().collect()} == {
        "0": ("dead", 8), "1": ("delivered", 2), "2": ("delivered", 2), "3": ("delivered", 2)}
    assert again.pending().count() == 0 and len(T.children(spark, f"{folder}/pending")) <= 3
    sent = spark.read.parquet(f"{folder}/results/*")
    assert sent.where("notification_id = '0'").count() == 7 and sent.where("notification_id <> '0'").count() == 3
    again.add(rows)
    assert again.pending().count() == 0  # settled ids stay known


def test_a_round_asks_for_new_groups_only(spark):
    asked = spark.sparkContext.accumulator(0)

    def judge(question, batch):
        asked.add(len(batch))
        return pd.DataFrame({"relevance": ["match"] * len(batch), "confidence": [0.9] * len(batch)})

    folder = f"{spark.conf.get('spark.checkpoint.dir')}/answers-{random.random()}"
    g = spark.range(20).select(
        F.col("id").cast("string").alias("search_group"), F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("error "), "id").alias("text"),
        source(F.lit("p")).alias("source"), F.col("id").alias("first_arrival"), F.lit(1).cast("long").alias("count"),
        F.lit("a").alias("first_seen"), F.lit("b").alias("last_seen"), F.lit(False).alias("truncated"), F.lit(False).alias("parse_uncertain"),
    )
    seen = []
    for some, now in ((g.where("first_arrival < 12"), 0), (g, 100), (g.withColumn("count", F.lit(2).cast("long")), 200), (g, 450)):
        r = Z.search_round(some, "error", judge, folder, now, capacity=30)
        seen.append((asked.value, r.where("cached").count(), r.where("examined").count()))
    # Twelve, the eight new ones, twenty with another count, and those of the first question that have expired or gone.
    assert seen[:3] == [(12, 0, 12), (20, 12, 20), (40, 0, 20)]
    assert seen[3][0] > 40 and seen[3][2] == 20 and len(T.children(spark, folder)) <= 3


def test_live_table_keeps_what_it_retains(spark, monkeypatch):
    """Nine batches cut down by threes: the newest ten events and the last preview of each source that is still open."""
    monkeypatch.setattr(L, "FAN", 3)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/live-{random.random()}"
    sink, events, previews = L.live_sink(folder, retain=10), [], {}
    for n in range(9):
        rows = [("event", f"s{k}", 10 * n + k, 10 * n + k) for k in range(4)] + [("pending", f"s{n % 3}", 10 * n + 7, 10 * n + 8)]
        events += [(n, *r[1:3]) for r in rows[:4]]
        previews[f"s{n % 3}"] = 10 * n + 7
        df = spark.createDataFrame(rows, "kind string, source_id string, line_start long, line_end long")
        for _ in range(2 if n in (3, 4) else 1):
            sink(df, n)
        assert len(T.children(spark, f"{folder}/events")) <= 4 and len(T.children(spark, f"{folder}/kept")) <= 1
    got = [(r.kind, r.source_id, r.line_start) for r in L.live_view(spark, folder, 10).collect()]
    both = [(b, at, "event", s) for b, s, at in events] + [(n, previews[f"s{n % 3}"], "pending", f"s{n % 3}") for n in (6, 7, 8)]
    assert sorted(got) == sorted((k, s, at) for b, at, k, s in sorted(both, reverse=True)[:10])
    assert [k for k, *_ in got].count("pending") >= 2
