"""Explicit schemas of the log-triage data model; nothing is inferred."""

from pyspark.sql import types as T

# The enumerations of the verdict contract.
IMPORTANCE = ("important", "routine", "uncertain")
SEVERITY = ("noise", "info", "degraded", "impact", "outage")
CATEGORY = (
    "deploy", "capacity", "dependency", "security", "fraud", "data", "config",
    "transient", "routine", "unknown",
)

# Byte limits of one physical line, one event and one evidence sample.
MAX_LINE_BYTES = 65536
MAX_EVENT_BYTES = 16000
MAX_SAMPLE_BYTES = 2048
MAX_SAMPLES = 8
MAX_TOKENS = 128

SOURCE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("cluster_id", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("namespace", T.StringType()),
    T.StructField("pod", T.StringType()),
    T.StructField("pod_uid", T.StringType()),
    T.StructField("container", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("previous", T.BooleanType()),
    T.StructField("restart_count", T.IntegerType()),
    T.StructField("container_id", T.StringType()),
])

JUDGMENT = T.StructType([
    T.StructField("importance", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("importance_confidence", T.DoubleType()),
    T.StructField("severity_confidence", T.DoubleType()),
    T.StructField("category_confidence", T.DoubleType()),
    T.StructField("analysis_error", T.StringType()),
])

BASELINE = T.StructType([
    T.StructField("important", T.BooleanType()),
    T.StructField("signals", T.ArrayType(T.StringType())),
])

LINE = T.StructType([
    T.StructField("source", SOURCE),
    T.StructField("line_no", T.LongType()),
    T.StructField("raw", T.StringType()),
])

# One saved report document (versions 1 and 2 share this reading schema).
REPORT_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", SOURCE),
    T.StructField("timestamp", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("line_start", T.LongType()),
    T.StructField("line_end", T.LongType()),
    T.StructField("line_count", T.LongType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("sensitive", T.BooleanType()),
    T.StructField("parse_uncertain", T.BooleanType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("importance", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("importance_confidence", T.DoubleType()),
    T.StructField("severity_confidence", T.DoubleType()),
    T.StructField("category_confidence", T.DoubleType()),
    T.StructField("analysis_error", T.StringType()),
    T.StructField("baseline", BASELINE),
    T.StructField("analysis_reused", T.BooleanType()),
    T.StructField("original_judgment", JUDGMENT),
    T.StructField("review", T.StructType([
        T.StructField("status", T.StringType()),
        T.StructField("rule_id", T.StringType()),
    ])),
])

# The summary counters every report carries; missing ones read as zero.
SUMMARY_COUNTERS = (
    "events", "lines", "important", "routine", "uncertain", "unknown", "streams",
    "coverage_gaps", "api_requests", "reused_events",
)

REPORT = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("summary", T.StructType(
        [T.StructField(c, T.LongType()) for c in SUMMARY_COUNTERS]
        + [T.StructField("complete_within_window", T.BooleanType()),
           T.StructField("retained_events", T.LongType()),
           T.StructField("evicted_events", T.LongType())]
    )),
    T.StructField("events", T.ArrayType(REPORT_EVENT)),
    T.StructField("tail_events", T.ArrayType(REPORT_EVENT)),
    T.StructField("coverage", T.ArrayType(T.StructType([
        T.StructField("source", SOURCE),
        T.StructField("status", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("important_groups", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("source", SOURCE),
        T.StructField("text", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("event_ids", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("usage", T.StructType([
        T.StructField("request_attempts", T.LongType()),
        T.StructField("requests_finished", T.LongType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("estimated_cost_usd", T.DoubleType()),
    ])),
    T.StructField("metrics", T.MapType(T.StringType(), T.LongType())),
])

# ``scope`` is read as JSON text so that the types of its scalars survive.
HUMAN_RULES = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("rules", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("match", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]))),
    T.StructField("acknowledged", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])

# Scope and literal values are kept as canonical JSON scalars so that 200 and "200" differ.
TEMPLATE_RULES = T.StructType([
    T.StructField("artifact_version", T.IntegerType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("rules", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("expires_at", T.LongType()),
        T.StructField("source_scope", T.StringType()),
        T.StructField("shape", T.MapType(T.StringType(), T.StringType())),
        T.StructField("required_literals", T.StringType()),
        T.StructField("normalize_paths", T.ArrayType(T.StringType())),
        T.StructField("protected_literals", T.StringType()),
        T.StructField("review", T.StructType([
            T.StructField("reviewer", T.StringType()),
            T.StructField("review_id", T.StringType()),
            T.StructField("compiler", T.StringType()),
            T.StructField("reviewed_at", T.LongType()),
        ])),
        T.StructField("prefix_identity", T.StructType([
            T.StructField("text", T.StringType()),
            T.StructField("clock_grammar", T.StringType()),
        ])),
    ]))),
])
