import json

import pytest
from pyspark.sql import functions as F

from logsluice.functions import classify as C, redact as R, templates as M, text as X
from logsluice.plans.adapters import source_struct, spread


def redact(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = R.with_redaction(df, "t").orderBy("i").collect()
    return [(r.safe, r.changed, r.ambiguous) for r in rows]


def test_secrets_disappear(spark):
    cases = [
        ("login password=hunter2 ok", 'login password="[REDACTED]" ok'),
        ("Authorization: Bearer abc.def", 'Authorization: "[REDACTED]" [REDACTED]'),
        ("dial https://user:pw@host/x", "dial https://[REDACTED]@host/x"),
        ("jwt eyJa.eyJb.c-d end", "jwt [REDACTED] end"),
        ("token: 'a b', next", 'token: "[REDACTED]", next'),
        ("basic dXNlcjpwdw== tail", "basic [REDACTED] tail"),
        ("nothing here", "nothing here"),
    ]
    got = redact(spark, *[c[0] for c in cases])
    assert [g[0] for g in got] == [c[1] for c in cases]
    assert [g[1] for g in got] == [True] * 6 + [False]


def test_json_documents(spark):
    doc = {"b": "x", "a": {"api_key": ["k"], "n": 1}, "msg": "token=abc"}
    (safe, changed, ambiguous), = redact(spark, json.dumps(doc))
    assert json.loads(safe) == {"a": {"api_key": "[REDACTED]", "n": 1}, "b": "x", "msg": 'token="[REDACTED]"'}
    assert changed and not ambiguous
    assert redact(spark, ' {"a": 1.50, "b": 1e3} ', " 12 ", '"x"') == [
        ('{"a":1.50,"b":1e3}', False, False), ("12", False, False), ('"x"', False, False)]


def test_repeated_members(spark):
    first = '{"z":1,"password":"a","z":2,"pass\\u0077ord":"b","q":{"t":3}}'
    (safe, changed, ambiguous), = redact(spark, first)
    assert safe == '{"z":1,"password":"[REDACTED]","z":2,"password":"[REDACTED]","q":{"t":3}}'
    assert changed and ambiguous
    assert redact(spark, safe)[0][0] == safe
    assert not redact(spark, '[{"a":1},{"a":2}]')[0][2]


def test_nesting_limit(spark):
    deep = "[" * 129 + "]" * 129
    fine = "[" * 128 + "1" + "]" * 128
    got = redact(spark, deep + "", "[" * 130 + "1" + "]" * 130, fine)
    assert got[1] == ("[REDACTED JSON: nesting limit]", True, True)
    assert got[2] == (fine, False, False)


def test_long_quoted_value_does_not_overflow(spark):
    text = 'password="' + "\\a" * 30000 + '" tail'
    assert redact(spark, text)[0][0] == 'password="[REDACTED]" tail'


def test_safe_source(spark):
    df = spark.range(2).select(source_struct(
        type="file", path=F.when(F.col("id") == 0, "a/token=abc").otherwise("plain")).alias("source"))
    paths = {r[0] for r in df.select(R.safe_source("source")["path"]).collect()}
    assert paths == {'a/token="[REDACTED]"', "plain"}
    extra = spark.sql("select map('api_key', 'x', 'node', 'password=1') m").select(R.safe_extra("m").alias("m")).first().m
    assert extra == {"api_key": "[REDACTED]", "node": 'password="[REDACTED]"'}


def test_baseline(spark):
    texts = ["INFO ready", "WARN queue", "status=503", "ERROR failure", "HTTP/1.1\" 502 x", "éerror", "terror", "out of memory"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(C.baseline_signals("t").alias("s"))
    assert [r.s for r in df.collect()] == [
        [], ["warning_level"], ["http_5xx"], ["error_or_failure_keyword"], ["http_5xx"],
        ["error_or_failure_keyword"], [], ["error_or_failure_keyword"]]


def test_offline_never_reusable(spark):
    df = spark.sql("select explode(array(true, false)) b").select(C.offline_judgment("b").alias("j"))
    assert df.where(C.reusable("j")).count() == 0


@pytest.mark.parametrize("value,band", [
    (0.0, "low"), (0.699, "low"), (0.7, "medium"), (0.899, "medium"), (0.9, "high"), (1.0, "high"),
    (None, "unscored"), (float("nan"), "unscored"), (-1.0, "unscored"), (1.1, "unscored"), (float("inf"), "unscored"),
])
def test_confidence_bands(spark, value, band):
    j = C.judgment("important", "impact", "dependency", F.lit(value), F.lit(0.9), F.lit(0.9))
    row = spark.range(1).select(C.confidence_band(C.confidence_value(j)).alias("b"), C.reusable(j).alias("r")).first()
    assert row.b == band and row.r == (band in ("medium", "high"))


def test_policy(spark):
    j = C.judgment("important", "impact", "dependency", F.lit(0.9), F.lit(0.9), F.lit(0.9))
    bare = C.judgment("important", "impact", "dependency")
    f = F.lit(False)
    row = spark.range(1).select(
        C.policy_decision(j, f, f, f).alias("a"), C.policy_decision(bare, f, f, f).alias("b"),
        C.policy_decision(bare, f, f, f, C.Policy(abstention="record")).alias("c"),
        C.policy_decision(j, F.lit(True), f, f).alias("d"),
    ).first()
    assert tuple(row) == ("notify", "review", "abstain", "review")
    with pytest.raises(ValueError):
        C.Policy(recurrence=1)


def templates(spark, masking, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.template for r in M.with_template(df, "text", masking).orderBy("i").collect()]


def test_strict_templates(spark):
    rid = "0123456789abcdef"
    assert templates(
        spark, "strict", f"GET  x request_id={rid}  n=1", f"request_id={rid}x", f"Trace-ID={rid}",
        f"my.request_id={rid}", f'{{"request_id":"{rid}","n":1,"status":{{"trace_id":"{rid}"}}}}',
    ) == [
        "GET x request_id=<id> n=1", f"request_id={rid}x", "Trace-ID=<id>", f"my.request_id={rid}",
        f'{{"n":1,"request_id":"<id>","status":{{"trace_id":"{rid}"}}}}',
    ]


def test_classic_keeps_what_decides(spark):
    pairs = [
        ("x status=200 n=1", "x status=500 n=2"), ("HTTP/1.1 200 in 3", "HTTP/1.1 500 in 3"),
        ("Completed 200 OK", "Completed 503 OK"), ('{"level":"info","n":1}', '{"level":"error","n":2}'),
    ]
    for a, b in pairs:
        x, y = templates(spark, "classic", a, b)
        assert x != y
    assert templates(spark, "classic", "took 12 ms from 10.0.0.1 at 12:30:01.5 code 7 got 404 x=-3.5") == [
        "took <value> ms from <value> at <value> code 7 got 404 x=<value>"]


def test_identity_classes(spark):
    s = source_struct(type="file", path="a")
    row = spark.range(1).select(
        X.event_id(s, F.lit(None), F.lit(1), F.lit("t")).alias("a"), X.event_id(s, F.lit("x"), F.lit(1), F.lit("t")).alias("b"),
        X.group_id(s, F.lit("t")).alias("c"),
    ).first()
    assert len({*row}) == 3 and all(len(v) == 20 for v in row)


def test_clip_bytes(spark):
    df = spark.createDataFrame([("aé€😀",)], "t string")
    for n in range(1, 11):
        want = "aé€😀".encode()[:n].decode("utf-8", "ignore")
        assert df.select(X.clip_bytes("t", n)).first()[0] == want


def test_classic_runs_and_protected_neighbours(spark):
    assert templates(
        spark, "classic", "1 2 3 4 5", "st-at.us 7 x=1 y=2 z=3", "=5 a==5 a=b=5 404 99 1000", "HTTP/2 7 HTTP/2 200",
        "retry-count=3 Re.Sult:9 12 done 12:00:00 10.1.2.3 +4", "Completed 7 then 8 status=200 500 9",
    ) == [
        "<value> <value> <value> <value> <value>", "st-at.us 7 x=<value> y=<value> z=<value>",
        "=<value> a==5 a=b=5 404 <value> <value>", "HTTP/2 7 HTTP/2 200",
        "retry-count=3 Re.Sult:9 12 done <value> <value> <value>", "Completed 7 then <value> status=200 500 <value>",
    ]


def test_a_source_is_scrubbed_once(spark):
    """Ten fields, one rewrite of four replacements: each field's own copy of it would do the work ten times over."""
    df = spark.range(3).select(source_struct(type="file", pod="svc token=t0ps3cret").alias("source"))
    safe = df.select(R.safe_source("source").alias("s"))
    assert safe._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 4
    assert {r.s.pod for r in safe.collect()} == {'svc token="[REDACTED]"'}


def test_spread_keeps_rows_that_come_twice(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)] * 50, "x long").coalesce(1)
    wide = spread(df)
    assert wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and spread(wide) is wide
    assert sorted(map(repr, wide.collect())) == sorted(map(repr, df.collect()))
