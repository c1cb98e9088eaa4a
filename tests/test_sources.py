import gzip
import json

import pytest
from pyspark.sql import functions as F

from logsluice import schema as S
from logsluice.functions import classify as C, text as X
from logsluice.operators import framing as W, report as R
from logsluice.plans.adapters import source_struct
from logsluice.sources import lines as L, packed as PK, reports as RP, rulesets as RS, sinks as K
from logsluice.streaming import framing as SF, live as LV


def test_files_gzip_missing_and_splits(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\ntwo\rstill two\n\nfour")
    with gzip.open(tmp_path / "b.log.gz", "wb") as f:
        f.write(b"x\ny\n")
    (tmp_path / "bad.gz").write_bytes(b"not gzip")
    big = "".join(f"line {i}\n" for i in range(5000))
    (tmp_path / "big.log").write_text(big)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        paths = [str(tmp_path / n) for n in ("a.log", "b.log.gz", "big.log", "missing.log", "bad.gz")]
        lines, gaps = L.read_log_lines(spark, paths)
        rows = lines.collect()
        by = {}
        for r in rows:
            by.setdefault(r.source.path.rsplit("/", 1)[1], []).append((r.line_no, r.raw))
        assert sorted(by["a.log"]) == [(1, "one"), (2, "two\rstill two"), (3, ""), (4, "four")]
        assert sorted(by["b.log.gz"]) == [(1, "x"), (2, "y")]
        assert sorted(by["big.log"]) == [(i + 1, f"line {i}") for i in range(5000)]
        assert not any(r.partial for r in rows)
        assert sorted((g.status, g.source.path.rsplit("/", 1)[1]) for g in gaps.collect()) == [
            ("file_unavailable", "missing.log"), ("gzip_invalid", "bad.gz"),
        ]
        events = W.frame_events(lines.where(F.col("source.path").contains("b.log")))
        metrics = R.loss_counters(events, gaps)
        assert events.count() == 2 and not R.completeness(metrics).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_that_break_off(spark, tmp_path):
    texts = "".join(f"line {i} {hash(str(i))}\n" for i in range(50_000)).encode()
    whole = gzip.compress(texts)
    (tmp_path / "cut.gz").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "two.gz").write_bytes(gzip.compress(b"a\n") + gzip.compress(b"b\n"))
    (tmp_path / "flip.gz").write_bytes(whole[:5000] + b"\xff\xff\xff" + whole[5003:])
    (tmp_path / "empty.gz").write_bytes(b"")
    lines, gaps = L.read_log_lines(spark, [str(tmp_path / "*.gz")])
    by = {}
    for r in lines.collect():
        by.setdefault(r.source.path.rsplit("/", 1)[1], []).append((r.line_no, r.partial))
    assert sorted((g.status, g.source.path.rsplit("/", 1)[1]) for g in gaps.collect()) == [
        ("gzip_invalid", "empty.gz"), ("input_incomplete", "cut.gz"), ("input_incomplete", "flip.gz"),
    ]
    assert sorted(by["two.gz"]) == [(1, False), (2, False)]
    cut = sorted(by["cut.gz"])
    assert 1000 < len(cut) < 50_000 and [n for n, p in cut if p] == [len(cut)]
    events = W.frame_events(lines.where(F.col("source.path").endswith("cut.gz")))
    assert [e.truncated for e in events.orderBy(F.desc("line_start")).limit(2).collect()] == [True, False]


def test_folders_globs_and_capitals(spark, tmp_path):
    texts = "".join(f"line {i}\n" for i in range(3000)).encode()
    folder = tmp_path / "in"
    (folder / "deeper").mkdir(parents=True)
    (folder / "plain.log").write_bytes(b"one\ntwo\n")
    (folder / "CAPS.GZ").write_bytes(gzip.compress(texts))
    (folder / "half.gz").write_bytes(gzip.compress(texts)[:2000])
    (folder / "odd[1]{2}.gz").write_bytes(gzip.compress(b"odd"))
    (folder / "_hidden.gz").write_bytes(b"x")
    for paths in ([str(folder)], [str(folder / "*")], [str(folder), str(folder / "*.log"), str(folder / "half.gz")]):
        lines, gaps = L.read_log_lines(spark, paths)
        by = {}
        for r in lines.collect():
            by.setdefault(r.source.path.rsplit("/", 1)[1], []).append((r.line_no, r.raw, r.partial))
        assert sorted(by["plain.log"]) == [(1, "one", False), (2, "two", False)]
        assert sorted(by["CAPS.GZ"]) == [(i + 1, f"line {i}", False) for i in range(3000)]
        half = sorted(by["half.gz"])
        assert 100 < len(half) < 3000 and all(not p for _, _, p in half[:-1])
        assert [v for k, v in by.items() if k.startswith("odd")] == [[(1, "odd", False)]]
        told = {(g.status, g.source.path.rsplit("/", 1)[1]) for g in gaps.collect()}
        assert ("input_incomplete", "half.gz") in told and len(by) == 4


def unpacked(data, pieces=None):
    """Rows of one file as the reader gives them, its bytes delivered in batches of pieces."""
    import pyarrow as pa

    parts = data.split(b"\n")
    if data.endswith(b"\n"):
        parts.pop()
    step = pieces or len(parts)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(["f"] * len(p)), pa.array([len(data)] * len(p)), pa.array(p, pa.binary())], ["path", "size", "piece"])
        for p in (parts[k:k + step] for k in range(0, len(parts), step))
    ]
    rows = [r for b in PK._inflate(iter(batches)) for r in b.to_pylist()]
    return [(r["line_no"], r["raw"], r["partial"]) for r in rows if not r["status"]], [r["status"] for r in rows if r["status"]]


def test_unpacking_by_pieces():
    text = b"".join(b"%d %d\n" % (i, i * i) for i in range(4000)) + b"last"
    want = [(k + 1, x, False) for k, x in enumerate(text.split(b"\n"))]
    packed = gzip.compress(text)
    for data in (packed, packed + b"\0" * 700, gzip.compress(text[:9000]) + gzip.compress(text[9000:]) + b"\0\n"[:1]):
        for pieces in (1, 7, None):
            assert unpacked(data, pieces) == (want, [])
    # What lies before the break is kept, the unfinished line is marked.
    for at in (15, 200, len(packed) - 9, len(packed) - 1):
        rows, status = unpacked(packed[:at])
        assert status == ["input_incomplete"] and b"\n".join(r for _, r, _ in rows) in (text[:len(b"\n".join(r for _, r, _ in rows))], b"")
        assert all(not p for _, _, p in rows[:-1])
    assert len(unpacked(packed[:len(packed) - 9])[0]) > 3900
    bad = bytearray(packed)
    bad[-6] ^= 255  # the checksum
    assert unpacked(bytes(bad)) == (want[:-1] + [(len(want), b"last", True)], ["input_incomplete"])
    for data in (b"no gzip\nat all\n", b"\x1f\x8b\x08", b"\x1f\x8b\x07" + packed[3:]):
        assert unpacked(data) == ([], ["gzip_invalid"])
    assert unpacked(packed + b"tail")[1] == ["input_incomplete"] and unpacked(packed + b"tail")[0][:-1] == want[:-1]


def test_members_of_more_than_two_gib():
    line = b"x" * (1 << 20)
    member = gzip.compress((line + b"\n") * 64, 1)
    data, n, last = member * 33, 0, None
    file = PK._File("f", len(data))
    for lo in range(0, len(data), 1 << 16):
        for r in file._lines(data[lo:lo + (1 << 16)]):
            n, last = n + 1, r
    file.inflater.end()
    assert n == 64 * 33 and last[1] == n and last[2] == line and file.inflater.status is None and n << 20 > 2 << 30


def test_line_numbers_move_no_text(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n" * 1000)
    lines, _ = L.read_log_lines(spark, [str(tmp_path / "a.log")])
    plan = lines._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange" in x and "raw#" in x]
    assert "BroadcastHashJoin" in plan and not moved


def test_unstamped_and_partial_lines_are_kept(spark):
    rows = [(1, "s", None, "a", 1, False), (1, "s", None, "a", 2, False), (1, "s", 5, "a", 3, True), (1, None, 5, "b", 4, False),
            (2, "s", None, "a", 1, False), (2, "s", 5, "a", 3, True), (2, None, 5, "b", 4, False)]
    df = spark.createDataFrame(rows, "fetch long, source_id string, ts_us long, raw string, line_no long, partial boolean")
    assert L.dedupe_overlapping_fetches(df).count() == 6
    assert {r.status: r["count"] for r in L.unproven_gaps(df).groupBy("status").count().collect()} == {"cursor_untimestamped": 3, "cursor_truncated": 2}


def test_byte_limit(spark, lines_df):
    df = L.limit_bytes(lines_df({"a": ["hello world"], "b": ["1234567"], "c": ["1234567", "x"]}).withColumn(
        "source_id", X.source_id("source")), 8)
    got = {(r.source.path, r.line_no): (r.raw, r.partial) for r in df.collect()}
    assert got == {("a", 1): ("hello wo", True), ("b", 1): ("1234567", False), ("c", 1): ("1234567", True)}
    ev = W.frame_events(df.drop("source_id"))
    assert {e.source.path: e.truncated for e in ev.collect()} == {"a": True, "b": False, "c": True}


def test_refetch_multiset(spark):
    rows, n = [], 0
    for fetch, texts in ((1, "aab"), (2, "aaba"), (3, "aabac")):
        for t in texts:
            n += 1
            rows.append((fetch, "s", 5 if t != "c" else 6, t, n))
    df = spark.createDataFrame(rows, "fetch long, source_id string, ts_us long, raw string, line_no long")
    got = L.dedupe_overlapping_fetches(df).groupBy("fetch").count().collect()
    assert {r.fetch: r["count"] for r in got} == {1: 3, 2: 1, 3: 1}


def events(spark, n=6, retain_source="a"):
    text = F.when(F.col("id") % 2 == 0, "ERROR failed").otherwise(F.concat(F.lit("INFO ok "), F.col("id").cast("string")))
    d = spark.range(n).select(
        F.col("id").alias("arrival"), source_struct(type="file", path=retain_source).alias("source"),
        F.lit(None).cast("string").alias("ts_raw"), text.alias("text"), (F.col("id") + 1).alias("line_start"),
        (F.col("id") + 1).alias("line_end"), F.lit(1).cast("bigint").alias("line_count"),
        *[F.lit(False).alias(c) for c in ("truncated", "sensitive", "parse_uncertain")],
    )
    d = d.withColumn("source_id", X.source_id("source")).withColumn(
        "id", X.event_id("source", "ts_raw", "line_start", "text")).withColumn("group_id", X.group_id("source", "text"))
    d = d.withColumn("baseline", C.baseline("text"))
    return d.withColumn("judgment", C.offline_judgment("baseline.important"))


def no_gaps(spark):
    return spark.createDataFrame([], "source struct<type:string,path:string>, status string, arrival long")


def test_report_round_trip(spark, tmp_path):
    ev = events(spark, 6)
    doc = K.report_document(ev, no_gaps(spark), retain=4)
    folder = str(tmp_path / "r")
    K.write_document(doc, folder)
    back = RP.read_report(spark, folder)
    row = back.first()
    assert (row.summary.events, row.summary.retained_events, row.summary.evicted_events) == (6, 4, 2)
    assert not row.complete and row.metrics["evicted_events"] == 2
    assert [(g["count"], len(g.event_ids)) for g in row.important_groups] == [(2, 2)]
    assert RP.report_events(back).orderBy("arrival").select("text").first().text == "ERROR failed"
    whole = K.report_document(ev, no_gaps(spark), retain=10)
    K.write_document(whole, str(tmp_path / "w"))
    assert RP.read_report(spark, str(tmp_path / "w")).first().complete


def test_saved_report_checks(spark, tmp_path):
    good = {"schema_version": 1, "mode": "old", "summary": {"events": 1, "complete_within_window": True},
            "events": [{"id": "x", "text": "t", "source": {"type": "file", "path": "p"}}]}
    (tmp_path / "g.json").write_text(json.dumps(good, indent=1))
    row = RP.read_report(spark, str(tmp_path / "g.json"), {"old": "new"}).first()
    assert row.mode == "new" and row.summary.lines == 0 and not row.complete and row.coverage == []
    for change in ({"schema_version": 3}, {"events": [{"id": "", "text": "t", "source": {}}]}, {"summary": None}):
        (tmp_path / "b.json").write_text(json.dumps(good | change))
        with pytest.raises(Exception):
            RP.read_report(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "c.json").write_text("{not json")
    hist, gaps = L.report_history(spark, str(tmp_path))
    assert [r.id for r in hist.collect()] == ["g.json"]
    assert sorted((g.source.path.rsplit("/", 1)[1], g.status) for g in gaps.collect()) == [("b.json", "report_invalid"), ("c.json", "report_invalid")]


def test_six_hundred_gaps(spark):
    gaps = spark.range(600).select(F.lit("x").alias("status"), F.col("id").alias("arrival"))
    assert R.coverage_log(gaps, "arrival").count() == 500
    m = {r.metric: r.value for r in R.loss_counters(events(spark, 1), gaps).collect()}
    assert m["coverage_records_omitted"] == 100 and m["coverage_gaps"] == 600


def test_template_rule_file(spark, tmp_path):
    rule = {"id": "r", "version": 1, "expires_at": 2000000000, "source_scope": {"type": "file", "path": "-"},
            "shape": {"": "object", "/request_id": "string", "/status": "number"}, "required_literals": {},
            "normalize_paths": ["/request_id"], "protected_literals": {"/status": 200},
            "review": {"reviewer": "a", "review_id": "b", "compiler": "c", "reviewed_at": 1}, "prefix_identity": {"text": "", "clock_grammar": ""}}
    bad = rule | {"id": "bad", "normalize_paths": ["/status"]}
    p = tmp_path / "rules.json"
    p.write_text(json.dumps({"artifact_version": 2, "schema_version": 1, "rules": [rule, bad]}))
    rules = RS.read_template_rules(spark, str(p))
    assert rules.first().protected == {"/status": "200"} and rules.first().scope == {"type": '"file"', "path": '"-"'}
    assert [(v.id, v.reason) for v in RS.template_rule_violations(rules, F.lit(1700000000)).collect()] == [("bad", "unsafe_normalization")]


def test_delivery_and_prompt(spark):
    box = spark.createDataFrame([("a", "p", 1), ("b", "p", 1)], "notification_id string, payload string, attempts long")

    def send(key, payload):
        if key == "b":
            raise IOError

    assert {r.notification_id: r.ok for r in K.deliver(box, send).collect()} == {"a": True, "b": False}
    text = K.investigation_prompt(events(spark, 7)).first().prompt
    body = json.loads(text.split("EVIDENCE\n")[1].rsplit("\nEND", 1)[0])
    assert [m["instance_count"] for m in body] == [4, 1, 1, 1] and len(body[0]["instances"]) == 4
    with pytest.raises(ValueError):
        K.investigation_prompt(events(spark, 200))


def test_streamed_framing_equals_batch(spark, lines_df, tmp_path):
    stamp = "2026-01-02T03:04:05Z "
    sources = {
        "a": ["ERROR x", "  at y", "Caused by: z", "INFO ready", "-----BEGIN PRIVATE KEY-----", "k", "-----END PRIVATE KEY-----", "INFO end"],
        "b": [stamp + t for t in ("panic: p", "goroutine 1 [running]:", "main.f(0x1)", "INFO a", '  File "q.py", line 2, in g', "    go()")],
        "c": ["  at orphan", '{"password":"x"}', "", "last"],
    }
    df = lines_df(sources)
    want = {(e.source.path, e.line_start, e.line_count, e.text, e.sensitive, e.parse_uncertain) for e in W.frame_events(df).collect()}
    feed = str(tmp_path / "feed")
    for part in range(3):  # three triggers, cutting events apart
        df.where((F.col("line_no") - 1) / 3 >= part).where((F.col("line_no") - 1) / 3 < part + 1).select(
            "source", "line_no", "raw").coalesce(1).write.mode("append").json(feed)
    df.groupBy("source").agg((F.max("line_no") + 1).alias("line_no")).select(
        "source", "line_no", F.lit("").alias("raw")).coalesce(1).write.mode("append").json(feed + "-end")
    schema = S.LINE
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(feed)
    out = str(tmp_path / "out")
    query = LV.start(SF.frame_stream(src, preview=True), LV.live_sink(out), str(tmp_path / "cp"), trigger=None)
    query.awaitTermination()
    assert query.exception() is None
    got = {(e.source.path, e.line_start, e.line_count, e.text, e.sensitive, e.parse_uncertain) for e in spark.read.parquet(out + "/events").collect()}
    # Without an end marker the last event of every source is still pending.
    view = LV.live_view(spark, out)
    pending = {(e.source.path, e.line_start, e.line_count, e.text, e.sensitive, e.parse_uncertain) for e in view.where("kind = 'pending'").collect()}
    assert got < want and got | pending == want and len(pending) == 3
    assert LV.live_counters(view).first().awaiting_verdict == 3
