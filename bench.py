"""Time the headline queries; prints one JSON line.

The tables come as one file of one row group each, which a single task reads, however many cores there are.
They are first laid out in as many files as cores, as larger tables lie by themselves; the seconds of that
are the entry ``table_layout`` and part of the total. Each query then runs ``BENCH_RUNS`` times (default 1) and the
median counts; a few small queries warm the JVM up first. The noop sink makes Spark compute every row and column without bringing
anything to the driver.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "top_important_groups", "report_summary", "scrubbed_lines", "framed_traces", "classic_templates",
    "evidence_dossiers", "reused_verdicts", "audit_schedule", "admitted_calls", "notification_outbox",
    "review_overlay", "search_summary", "context_in_time", "nearest_context", "display_groups",
    "redacted_documents", "replayed_fetches", "byte_limited_lines",
)

#: Tables that the headline queries read.
TABLES = ("events", "orders", "lineitem", "documents", "conversations")


def main() -> None:
    from logsluice.plans import catalog
    from logsluice.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = sys.argv[1:]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-"), "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    for name in ("top_important_groups", "scrubbed_lines", "classic_templates"):
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    t = time.time()
    laid = tempfile.mkdtemp(prefix="run-")
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(int(cpus)).write.parquet(f"{laid}/{table}.parquet")
    times = {"table_layout": round(time.time() - t, 3)}
    for name in only or HEADLINE:
        fn = catalog.QUERIES[name]
        spent = []
        for _ in range(max(1, runs)):
            t = time.time()
            fn(spark, laid).write.format("noop").mode("overwrite").save()
            spent.append(time.time() - t)
        times[name] = round(statistics.median(spent), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
