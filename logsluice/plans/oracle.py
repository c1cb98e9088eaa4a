"""Shared SQL building blocks for the DuckDB side of the result checks.

Each block is a CTE that rebuilds an adapter from the raw tables.
"""

WORD = "[0-9A-Za-z_]"

EVENTS = r"""
raw_events AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
),
ev0 AS (
  SELECT event_id AS arrival, event_type, user_id, k,
    {'type': 'kubernetes', 'path': NULL, 'cluster_id': NULL, 'context': 'demo',
     'namespace': 'ns' || (user_id % 3), 'pod': 'pod' || user_id, 'pod_uid': NULL,
     'container': 'app', 'kind': 'container', 'previous': false, 'restart_count': 0,
     'container_id': NULL} AS source,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_raw,
    epoch_us(ts) AS ts_us, epoch_us(ts) // 1000000 AS ts_s,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END
      || ' ' || event_type || ' request_id=' || md5(CAST(event_id AS VARCHAR))
      || ' user_id=' || user_id || ' status='
      || CASE WHEN event_type = 'error' AND k % 3 = 0 THEN '503' ELSE '200' END
      || ' n=' || k AS text,
    event_id + 1 AS line_start,
    k = 50 AS truncated, k = 60 AS sensitive, k = 70 AS parse_uncertain
  FROM raw_events
),
ev AS (
  SELECT *, to_json(source) AS source_json, sha256(CAST(to_json(source) AS VARCHAR)) AS source_id,
    substr(sha256(CAST(to_json({'source': source, 'ts_raw': ts_raw, 'line_start': line_start, 'text': text}) AS VARCHAR)), 1, 20) AS id,
    substr(sha256(CAST(to_json({'source': source, 'text': text}) AS VARCHAR)), 1, 20) AS group_id
  FROM ev0
)"""

# Signals of the generated texts; RE2's own word boundary is the ASCII one.
BASE = r"""
base AS (
  SELECT *,
    regexp_matches(text, '(?i)\b(error|fatal|panic|exception|critical|oomkilled|out of memory|crashloopbackoff)\b') AS sig_error,
    regexp_matches(text, '(?i)(?:status["\s:=]+|HTTP/\d(?:\.\d)?["\s]+)5\d\d\b') AS sig_http,
    regexp_matches(text, '(?i)\b(warn|warning)\b') AS sig_warn
  FROM ev
)"""

JUDGED = r"""
judged AS (
  SELECT *, sig_error OR sig_http OR sig_warn AS base_important,
    CASE WHEN k = 99 THEN 'unknown' WHEN event_type = 'error' AND k % 5 = 0 THEN 'uncertain'
         WHEN event_type = 'error' THEN 'important'
         WHEN event_type = 'signup' AND k % 7 = 0 THEN 'uncertain' ELSE 'routine' END AS importance,
    CASE WHEN k = 99 THEN 'unknown' WHEN event_type = 'error' AND k % 3 = 0 THEN 'outage'
         WHEN event_type = 'error' THEN 'degraded' WHEN event_type = 'purchase' THEN 'info'
         ELSE 'noise' END AS severity,
    CASE WHEN k = 99 THEN 'unknown' WHEN event_type = 'error' AND k % 4 = 0 THEN 'dependency'
         WHEN event_type = 'error' AND k % 4 = 1 THEN 'security'
         WHEN event_type = 'error' AND k % 4 = 2 THEN 'capacity'
         WHEN event_type = 'error' THEN 'unknown'
         WHEN event_type = 'signup' AND k % 11 = 0 THEN 'fraud' ELSE 'routine' END AS category,
    CASE WHEN k NOT IN (99, 13) THEN (k % 6 + 5) / 10.0::DOUBLE END AS i_conf,
    CASE WHEN k <> 99 THEN (k % 5 + 6) / 10.0::DOUBLE END AS s_conf,
    CASE WHEN k <> 99 THEN (k % 4 + 7) / 10.0::DOUBLE END AS c_conf,
    CASE WHEN k = 99 THEN 'provider analysis unavailable' END AS analysis_error
  FROM base
)"""

# Reusable verdicts, safe evidence and the policy decision over judged events.
DECIDED = r"""
decided AS (
  SELECT *,
    (analysis_error IS NULL AND importance IN ('routine', 'important')
      AND category NOT IN ('unknown', 'security', 'fraud')
      AND coalesce(i_conf BETWEEN 0.7 AND 1, false) AND coalesce(s_conf BETWEEN 0.7 AND 1, false)
      AND coalesce(c_conf BETWEEN 0.7 AND 1, false)) AS reusable,
    CASE WHEN parse_uncertain OR truncated OR sensitive OR analysis_error IS NOT NULL
           OR importance IN ('unknown', 'uncertain')
           OR NOT (coalesce(i_conf BETWEEN 0.85 AND 1, false) AND coalesce(s_conf BETWEEN 0.85 AND 1, false)
                   AND coalesce(c_conf BETWEEN 0.85 AND 1, false)) THEN 'review'
         WHEN importance = 'important' AND (category IN ('security', 'fraud')
           OR severity IN ('degraded', 'impact', 'outage')) THEN 'notify'
         ELSE 'ignore' END AS decision
  FROM judged
)"""

DOC_LINES = r"""
docs AS (
  SELECT 'file' AS type, source || '/' || doc_id AS path, text FROM documents WHERE text IS NOT NULL AND text <> ''
),
doc_lines AS (
  SELECT path, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS line_no
  FROM (SELECT path, string_split(CASE WHEN text LIKE '%' || chr(10) THEN substr(text, 1, length(text) - 1) ELSE text END, chr(10)) AS parts FROM docs)
)"""

CONV_LINES = r"""
conv AS (
  SELECT 'conv/' || conv_id AS path, turn + 1 AS line_start, turn + 1 AS line_end, role, text FROM conversations
)"""

TRACE = r"""
trace_rows AS (
  SELECT o_orderkey AS ok, o_custkey % 16 AS f, 0 AS n FROM orders
  UNION ALL
  SELECT DISTINCT o_orderkey, o_custkey % 16, CAST(l_linenumber AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
trace_heads AS (
  -- A stamped, indented source line continues only right after its frame line.
  SELECT *, ok % 3 AS dialect, ok * 8 + n + 1 AS line_no,
    n = 0 OR (ok % 3 = 2 AND n % 2 = 0
              AND NOT lag(n) OVER (PARTITION BY ok ORDER BY n) % 2 = 1) AS head
  FROM trace_rows
),
trace_events AS (
  SELECT 'orders/' || f AS path, ok, dialect, min(line_no) AS line_start, max(line_no) AS line_end,
    count(*) AS line_count
  FROM (SELECT *, sum(head::INT) OVER (PARTITION BY ok ORDER BY n) AS seg FROM trace_heads)
  GROUP BY f, ok, dialect, seg
)"""


def with_ctes(*parts_then_body: str) -> str:
    *parts, body = parts_then_body
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + body
