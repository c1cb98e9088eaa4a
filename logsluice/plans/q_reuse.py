"""Queries: verdict reuse, cache lookups, audits, budgets and usage."""

from pyspark.sql import functions as F

from ..functions import classify as C, templates as M
from ..operators import dossier as D, reuse as U, usage as G
from . import adapters as A, oracle as O
from .catalog import query
from .q_groups import ALL, keyed_events

_FOLD = """
lane AS (SELECT *, coalesce(ts_s < max(ts_s) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS rollback FROM fam),
seq AS (SELECT template_key, ts_s, id, importance, rollback,
  reusable AND NOT truncated AND NOT sensitive AND NOT parse_uncertain AS seeds, importance = 'routine' AS routine,
  row_number() OVER (PARTITION BY template_key ORDER BY arrival) AS n FROM lane WHERE template_key IS NOT NULL AND ts_s IS NOT NULL),
fold AS (
  SELECT DISTINCT template_key, 0::BIGINT AS n, false AS held, false AS stale, 0::BIGINT AS expires, 0::BIGINT AS audit_at,
    16::BIGINT AS step, NULL::VARCHAR AS rep, NULL::VARCHAR AS rep_importance, NULL::VARCHAR AS id, false AS reused,
    NULL::VARCHAR AS reason, NULL::VARCHAR AS importance FROM seq
  UNION ALL
  SELECT template_key, n, hit OR seeds,
    CASE WHEN hit THEN stale WHEN seeds THEN false ELSE stale OR rollback OR (held AND NOT alive) END,
    CASE WHEN NOT hit AND seeds THEN ts_s + {ttl} ELSE expires END,
    CASE WHEN NOT hit AND seeds THEN n + nstep ELSE audit_at END,
    CASE WHEN NOT hit AND seeds THEN nstep ELSE step END,
    CASE WHEN NOT hit AND seeds THEN id ELSE rep END,
    CASE WHEN NOT hit AND seeds THEN importance ELSE rep_importance END,
    id, hit,
    CASE WHEN hit THEN 'cached' WHEN rollback THEN 'clock_rollback' WHEN alive THEN 'stable_audit' WHEN stale OR held THEN 'cache_expired' ELSE 'new_or_expired' END,
    CASE WHEN hit THEN rep_importance ELSE importance END
  FROM (
    SELECT f.template_key, s.n, f.held, f.stale, f.expires, f.audit_at, f.step, f.rep, f.rep_importance, s.ts_s, s.id, s.seeds, s.importance, s.rollback,
      f.held AND s.ts_s < f.expires AND NOT s.rollback AS alive, f.held AND s.ts_s < f.expires AND NOT s.rollback AND ({plain} OR s.n < f.audit_at) AS hit,
      CASE WHEN s.routine THEN least({cap}, greatest(32, f.step * 2)) ELSE 32 END AS nstep
    FROM fold f JOIN seq s ON s.template_key = f.template_key AND s.n = f.n + 1)
)"""

_OUT = """
SELECT id, reused, reason, CASE WHEN reused THEN rep END AS representative_id, importance FROM fold WHERE n > 0
UNION ALL SELECT id, false, 'ineligible', NULL, importance FROM fam WHERE template_key IS NULL"""


def _shown(df):
    return df.select(
        "id", "reused", "reason", "representative_id", F.col("verdict.importance").alias("importance")
    )


@query("reused_verdicts", O.with_ctes(*ALL, _FOLD.format(ttl=14400, plain="true", cap=1024), _OUT))
def reused_verdicts(spark, sf_dir):
    return _shown(U.reuse_verdicts(keyed_events(spark, sf_dir), ttl=14400))


@query("adaptive_reuse", O.with_ctes(*ALL, _FOLD.format(ttl=432000, plain="false", cap=64), _OUT))
def adaptive_reuse(spark, sf_dir):
    return _shown(U.reuse_verdicts(keyed_events(spark, sf_dir), ttl=432000, adaptive=True, max_interval=64))


# Arrivals shuffled in tens, and events without a clock.
_LATE = """
shaken AS (SELECT * REPLACE ((arrival // 10) * 10 + (arrival * 7) % 10 AS arrival, CASE WHEN k % 17 <> 3 THEN ts_s END AS ts_s) FROM fam)"""


@query("reuse_without_clock", O.with_ctes(*ALL, _LATE, _FOLD.replace("FROM fam)", "FROM shaken)").format(ttl=14400, plain="true", cap=1024), """
SELECT id, reused, reason, CASE WHEN reused THEN rep END AS representative_id, importance FROM fold WHERE n > 0
UNION ALL SELECT id, false, CASE WHEN template_key IS NULL THEN 'ineligible' ELSE 'no_clock' END, NULL, importance FROM shaken
WHERE template_key IS NULL OR ts_s IS NULL"""))
def reuse_without_clock(spark, sf_dir):
    """Clocks that run backwards or are missing: nothing is lost, and a step back is judged again."""
    pos = F.floor(F.col("arrival") / 10) * 10 + (F.col("arrival") * 7) % 10
    ev = keyed_events(spark, sf_dir).withColumns({
        "arrival": pos, "ts_s": F.when(F.col("k") % 17 != 3, F.col("ts_s")),
    })
    return _shown(U.reuse_verdicts(ev, ttl=14400))


@query("reuse_vetoes", O.with_ctes(*ALL, """
SELECT id, template_key IN (SELECT template_key FROM fam WHERE base_important AND template_key IS NOT NULL) AS vetoed FROM fam
WHERE template_key IS NOT NULL"""))
def reuse_vetoes(spark, sf_dir):
    ev = M.families(keyed_events(spark, sf_dir))
    vetoes = ev.where("baseline.important").select("template_key")
    return U.veto_flag(ev, vetoes).select("id", "vetoed")


@query("audit_schedule", O.with_ctes(*ALL, """
SELECT id, seen, seen IN (1, 33, 97, 225) OR (seen > 225 AND (seen - 225) % 128 = 0) AS audit FROM (
  SELECT id, row_number() OVER (PARTITION BY template_key ORDER BY ts_s, arrival) AS seen FROM fam WHERE template_key IS NOT NULL)"""))
def audit_schedule(spark, sf_dir):
    return U.audit_schedule(keyed_events(spark, sf_dir), max_interval=128).select("id", "seen", "audit")


@query("clock_rollbacks", O.with_ctes(O.EVENTS, """
seq AS (SELECT id, ts_s, (arrival // 10) * 10 + (arrival * 7) % 10 AS pos FROM ev)""", """
SELECT id, coalesce(ts_s < max(ts_s) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS clock_rollback FROM seq"""))
def clock_rollbacks(spark, sf_dir):
    """Arrival order locally shuffled in tens."""
    pos = F.floor(F.col("arrival") / 10) * 10 + (F.col("arrival") * 7) % 10
    ev = A.events_log(spark, sf_dir).withColumn("pos", pos)
    return U.clock_rollback(ev, "pos").select("id", "clock_rollback")


_CACHE = """
requests AS (SELECT template_key AS key, id, ts_s AS now, (arrival * 7919) % 100003 AS seq, arrival FROM fam WHERE template_key IS NOT NULL),
stored AS (SELECT template_key AS key, min(ts_s) AS created, min(ts_s) + 1728000 AS expires, min_by(importance, arrival) AS importance
  FROM fam WHERE template_key IS NOT NULL AND reusable GROUP BY template_key),
checked AS (SELECT r.*, s.importance, s.created IS NOT NULL AS known,
  coalesce(now >= created AND now < expires AND now - created < 1296000, false) AS valid FROM requests r LEFT JOIN stored s USING (key)),
gone AS (SELECT key, min(seq) AS g FROM checked WHERE known AND NOT valid GROUP BY key)"""


def _stored(ev):
    good = M.families(ev).where(C.reusable("judgment"))
    return good.groupBy(F.col("template_key").alias("key")).agg(
        F.min("ts_s").alias("created"), (F.min("ts_s") + 1728000).alias("expires"),
        F.min_by("judgment", "arrival").alias("judgment"),
    )


@query("verdict_lookup", O.with_ctes(*ALL, _CACHE, """
SELECT id, valid AND (g IS NULL OR seq < g) AS hit, CASE WHEN valid AND (g IS NULL OR seq < g) THEN importance END AS importance
FROM checked LEFT JOIN gone USING (key)"""))
def verdict_lookup(spark, sf_dir):
    ev = keyed_events(spark, sf_dir)
    requests = M.families(ev).select(
        F.col("template_key").alias("key"), "id", F.col("ts_s").alias("now"),
        ((F.col("arrival") * 7919) % 100003).alias("seq"),
    )
    got = U.lookup_verdicts(requests, _stored(ev), ttl=1296000)
    return got.select("id", "hit", F.col("verdict.importance").alias("importance"))


@query("refreshed_cache", O.with_ctes(*ALL, _CACHE, """
round AS (SELECT template_key AS key, max(ts_s) AS now, max_by(arrival % 5 = 0, arrival) AS unsafe,
    max_by(reusable, arrival) AS reusable, max_by(importance, arrival) AS importance,
    CASE count(*) % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'refresh' ELSE 'bypass' END AS mode
  FROM fam WHERE template_key IS NOT NULL GROUP BY template_key),
fresh AS (SELECT key, importance, now AS created, now + 60 AS expires FROM round WHERE NOT unsafe AND mode <> 'bypass' AND reusable)""", """
SELECT key, importance, created, expires FROM fresh
UNION ALL SELECT key, importance, created, expires FROM stored
WHERE key NOT IN (SELECT key FROM fresh) AND key NOT IN (SELECT key FROM round WHERE unsafe OR mode <> 'default')"""))
def refreshed_cache(spark, sf_dir):
    ev = keyed_events(spark, sf_dir)
    judged = M.families(ev).groupBy(
        F.col("template_key").alias("key")
    ).agg(
        F.max("ts_s").alias("now"), F.max_by(F.col("arrival") % 5 == 0, "arrival").alias("unsafe"),
        F.max_by("judgment", "arrival").alias("judgment"), F.count(F.lit(1)).alias("_n"),
    ).withColumn(
        "mode", F.expr("CASE _n % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'refresh' ELSE 'bypass' END")
    )
    out = U.refresh_cache(_stored(ev), judged, ttl=60)
    return out.select("key", F.col("judgment.importance").alias("importance"), "created", "expires")


@query("live_verdicts", O.with_ctes(*ALL, _CACHE, """
SELECT key, created, expires FROM stored WHERE (SELECT min(ts_s) + 1728300 FROM ev) < expires"""))
def live_verdicts(spark, sf_dir):
    ev = keyed_events(spark, sf_dir)
    start = ev.agg((F.min("ts_s") + 1728300).alias("now"))
    stored = _stored(ev).select("key", "created", "expires", F.lit(1).alias("_j"))
    return U.live_rows(
        stored.join(start.withColumn("_j", F.lit(1)), "_j"), F.col("now")
    ).select("key", "created", "expires")


_CALLS = """
calls AS (SELECT arrival AS seq, CASE WHEN event_type = 'error' THEN 'template' ELSE 'risk' END AS kind,
  strlen(text) * 10 AS request_bytes, k * 10 AS input_tokens, CASE WHEN k % 20 = 0 THEN NULL ELSE k END AS output_tokens, k <> 99 AS finished FROM ev)"""


def _calls(spark, sf_dir):
    ev = A.events_log(spark, sf_dir, with_ids=False)
    return ev.select(
        F.col("arrival").alias("seq"),
        F.when(F.col("event_type") == "error", "template").otherwise("risk").alias("kind"),
        (F.octet_length("text") * 10).cast("bigint").alias("request_bytes"),
        (F.col("k") * 10).alias("input_tokens"),
        F.when(F.col("k") % 20 != 0, F.col("k")).alias("output_tokens"),
        (F.col("k") != 99).alias("finished"),
    )


@query("admitted_calls", O.with_ctes(O.EVENTS, _CALLS, """
sized AS (SELECT *, sum(request_bytes * 1000 + 16384 * 4000) OVER (ORDER BY seq) AS reserved, row_number() OVER (ORDER BY seq) AS attempt FROM calls)""", """
SELECT seq, reserved::BIGINT AS reserved_nano_usd, reserved <= 250000000000 AND attempt <= 5000 AS admitted FROM sized"""))
def admitted_calls(spark, sf_dir):
    prices = G.Prices(input_nano_usd=1000, output_nano_usd=4000)
    return G.admit_budget(_calls(spark, sf_dir), prices, 250_000_000_000, 5000).select(
        "seq", "reserved_nano_usd", "admitted"
    )


@query("usage_rollup", O.with_ctes(O.EVENTS, _CALLS, """
SELECT kind, count(*) AS attempts, count(*) FILTER (finished) AS finished,
  count(*) FILTER (finished AND output_tokens IS NOT NULL) AS metered,
  count(*) FILTER (finished AND output_tokens IS NULL) AS unmetered,
  sum(input_tokens) FILTER (finished AND output_tokens IS NOT NULL)::BIGINT AS input_tokens,
  sum(output_tokens) FILTER (finished AND output_tokens IS NOT NULL)::BIGINT AS output_tokens,
  sum(input_tokens * 1000 + output_tokens * 4000) FILTER (finished)::BIGINT AS cost_nano_usd,
  bool_and(NOT finished OR (output_tokens IS NOT NULL AND input_tokens * 1000 + output_tokens * 4000 <= request_bytes * 1000 + 16384 * 4000)) AS cost_complete
FROM calls GROUP BY kind"""))
def usage_rollup(spark, sf_dir):
    prices = G.Prices(input_nano_usd=1000, output_nano_usd=4000)
    return G.usage_rollup(_calls(spark, sf_dir), prices).select(
        "kind", "attempts", "finished", "metered", "unmetered", "input_tokens", "output_tokens",
        "cost_nano_usd", "cost_complete",
    )
