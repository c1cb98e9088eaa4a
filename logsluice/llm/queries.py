"""The queries of the operators in this package, as the driver calls them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, embeddings, mixing, packing, quality_model, quality_rules, simhash, substrings, suffix_dedup, toxicity, url_filter, warc, whitening
from .common import fold_of, labelled_sample, read_table, write_shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL of a text's words.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(oracle: str | None = None) -> Callable:
    """Register a query, and its SQL where SQL can express it."""
    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _scored(spark, sf_dir, model, label: str, parts: int, held_out: int, *more: str, **options) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", label)
    sample = labelled_sample(docs, labels, label, parts, held_out, model.TRAIN_ROWS, model.TRAIN_BYTES)
    out = model.score_documents(docs, model.fit(sample), **options)
    return out.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), parts) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), *more,
    )


@query()
def op1_quality_model(spark, sf_dir):
    return _scored(spark, sf_dir, quality_model, "quality", 3, 1)


_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS.split())))
QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
),
places AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS win FROM places),
repeated AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, sum(least(5, coalesce(following - i, 5))) AS n FROM repeated GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop
  FROM d JOIN lines USING (r) LEFT JOIN covered c USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words AND word_chars / n_words BETWEEN 2 AND 16
    AND n_symbols / word_chars <= 0.08 AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AND n_words / n_lines >= 1.5 AS kept
FROM counts"""


@query(QUALITY_SQL)
def op2_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules.judge_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


# Base32 by fives of hex digits, which are four letters each.
_DIGIT = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(encode(coalesce(html, ''))) AS h FROM pages),
letters AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(h, (5 * k + 1)::INT, 5))::BIGINT) AS fives FROM p),
named AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(fives, lambda v:
    substr({_DIGIT}, ((v >> 15) & 31)::INT + 1, 1) || substr({_DIGIT}, ((v >> 10) & 31)::INT + 1, 1)
    || substr({_DIGIT}, ((v >> 5) & 31)::INT + 1, 1) || substr({_DIGIT}, (v & 31)::INT + 1, 1)), '') AS payload_digest FROM letters),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM firsts"""


@query(WARC_SQL)
def op3_warc(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op4_simhash(spark, sf_dir):
    return simhash.simhash_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))


URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)


def _url_sql() -> str:
    fits = lambda r: (
        f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    )
    longest = sorted(URL_RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest) + " END"
    variable = url_filter._VARIABLE
    levels, source = "", "counted"
    for d in range(1, url_filter.DEPTH + 1):
        levels += f"""
    wild{d} AS (SELECT host, template, true AS w FROM (
      SELECT host, template, seg[{d}] AS s, sum(n) AS n FROM {source} WHERE seg[{d}] IS NOT NULL GROUP BY ALL)
      GROUP BY host, template HAVING count(*) > {url_filter.MAX_CHILDREN} AND 2 * count(*) FILTER (n = 1) > count(*)),
    level{d} AS (SELECT host, raw, seg, n, labelled, blocked,
      CASE WHEN seg[{d}] IS NULL THEN template ELSE template || '/' || CASE WHEN w THEN '*' ELSE seg[{d}] END END AS template
      FROM {source} LEFT JOIN wild{d} USING (host, template)),"""
        source = f"level{d}"
    m = url_filter.PRIOR
    return rf"""
    WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
    cut AS (SELECT page_id, u, regexp_extract(u, '^[^/?#]*') AS h FROM rest),
    split AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(u, length(h) + 1), '^[^?#]*') AS path FROM cut),
    said AS (SELECT *, {rule} AS rule, {said} AS said, list_transform(
      list_filter(string_split(path, '/'), lambda s: s <> '')[1:{url_filter.DEPTH}], lambda s: CASE WHEN regexp_matches(s, '{variable}')
        THEN '*' || regexp_extract(s, '(\.[A-Za-z]{{1,5}})$', 1) ELSE s END) AS seg FROM split),
    raws AS (SELECT *, array_to_string(seg, '/') AS raw FROM said),
    counted AS (SELECT host, raw, any_value(seg) AS seg, count(*) AS n, count(said) AS labelled,
      count(*) FILTER (said = 'block') AS blocked, '' AS template FROM raws GROUP BY host, raw),{levels}
    overall AS (SELECT sum(blocked) / (sum(labelled) + {m}) AS p FROM {source}),
    hosts AS (SELECT host, (sum(blocked) + {m} * (SELECT p FROM overall)) / (sum(labelled) + {m}) AS p, sum(labelled) > 0 AS seen FROM {source} GROUP BY host),
    branches AS (SELECT host, template, sum(blocked) AS b, sum(labelled) AS l, any_value(p) AS p, any_value(seen) AS seen, regexp_replace(template, '[^/*.]+', '+', 'g') AS shape
      FROM {source} JOIN hosts USING (host) GROUP BY host, template),
    banded AS (SELECT *, least(floor((b + {m} * p) / (l + {m}) * {url_filter.BANDS}), {url_filter.BANDS - 1}) AS band FROM branches),
    merged AS (SELECT host, template, (sum(b) OVER g + {m} * p) / (sum(l) OVER g + {m}) 
        >= {url_filter.BLOCK_AT} AND seen AS bad
      FROM banded WINDOW g AS (PARTITION BY host, shape, band)),
    judged AS (SELECT host, raw, template, bad FROM {source} JOIN merged USING (host, template))
    SELECT page_id, host, path, rule, template, coalesce(said, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
    FROM raws JOIN judged USING (host, raw)"""


URL_SQL = _url_sql()


@query(URL_SQL)
def op5_url_filter(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "template", "verdict")


@query()
def op6_toxicity(spark, sf_dir):
    return _scored(spark, sf_dir, toxicity, "toxic", 5, 0, "sentences", with_sentences=True)


@query()
def op7_packing(spark, sf_dir):
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


SUBSTRING_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, {_WORDS} AS w FROM documents),
each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
runs AS (SELECT r, j AS i, list(word) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM each),
windows AS (SELECT r, i, row_number() OVER (PARTITION BY array_to_string(win, ' ') ORDER BY r, i) AS k FROM runs WHERE len(win) = 20),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS j FROM windows WHERE k > 1),
left_ AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (r)"""


@query(SUBSTRING_SQL)
def op8_substrings(spark, sf_dir):
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))


MIXING_SQL = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
weighted AS (SELECT *, CASE n % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap,
  sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER before_, 0)) / sum(w) OVER after_ AS level, row_number() OVER fill AS turn FROM weighted
  WINDOW fill AS (ORDER BY source_size / w, n), before_ AS (ORDER BY source_size / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after_ AS (ORDER BY source_size / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
found AS (SELECT min_by(level, turn) AS level FROM levels WHERE w * level <= cap),
targets AS (SELECT source, source_size, n, least(cap, coalesce(w * found.level, cap)) AS target FROM levels, found),
-- Blocks hold all words up to the target and lose none, so adding them up needs no schedule.
reach AS (SELECT source, source_size, target, least(floor(target + 0.5), 2 * source_size)::BIGINT AS x FROM targets),
laid AS (SELECT d.*, source_size, target, x, (sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix/' || doc_id), doc_id, size))::BIGINT - size AS done
  FROM d JOIN reach ON d.source IS NOT DISTINCT FROM reach.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, x - done)) + greatest(0, least(size, x - source_size - done)))::BIGINT AS taken FROM laid"""


@query(MIXING_SQL)
def op9_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = write_shared(mixing.with_size(docs).drop("text"), "sizes")
    return mixing.taken_words(sized).select("doc_id", "size", "source_size", "target", "taken")


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_ AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least_ LEFT JOIN counts USING (vec_id)"""


@query(EMBEDDING_SQL)
def op10_embeddings(spark, sf_dir):
    return embeddings.link_components(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


# Bytes as pairs of hex digits, cut into overlapping pieces so that taking windows stays cheap. Windows are compared by their MD5.
SUFFIX_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, c, least(2000, len(h) // 2 - c - 199) AS m, substr(h, (2 * c + 1)::BIGINT, 4398) AS p
  FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199, 2000)) AS c FROM d)),
windows AS (SELECT r, c + i AS i, md5_number(substr(p, 2 * i + 1, 400)) AS w FROM (SELECT r, c, p, unnest(range(0, m)) AS i FROM pieces)),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 200 AS new FROM windows SEMI JOIN twice USING (w)),
islands AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM hits) GROUP BY r, g),
cuts AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS n FROM islands GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda k:
    substr(h, (2 * CASE WHEN k = 0 THEN 0 ELSE b[k] END + 1)::BIGINT, (2 * (CASE WHEN k = len(a) THEN len(h) // 2 ELSE a[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE b[k] END))::BIGINT)), '') END)) AS kept_sha256
FROM d LEFT JOIN cuts USING (r)"""


@query(SUFFIX_SQL)
def op11_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeated_bytes(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query()
def op12_whitening(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


# A table of all prefixes instead of an agenda: for every prefix of the rows and state of the pattern the least (cost, audit), with what it
# makes of the rows. CRC-32 is taken bit by bit.
CONVERSATION_SQL = r"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
  lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 20 AS kind FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(length(role) || ':' || role || text), 32), copy) AS k,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM damaged),
told AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS x,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS y FROM numbered),
moves(s, x, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ways AS (SELECT conv_id, k, s.s, s.s AS t, 2 AS cost, 'D' AS edit, []::VARCHAR[] AS turn FROM told, (VALUES (0), (1), (2), (3)) AS s(s)
  UNION ALL SELECT conv_id, k, s, t, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [role || ':' || text]
  FROM told JOIN moves USING (x) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, k, s, t, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [CASE m.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM told, moves m WHERE fault NOT IN ('blank', 'duplicate') AND m.x <> 's'),
inserts(s, t, n, turns) AS (VALUES (0, 0, 0, []::VARCHAR[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']),
  (3, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])),
ids AS (SELECT DISTINCT conv_id FROM conversations),
best(conv_id, k, s, w) AS (
  SELECT conv_id, 0::BIGINT, t, {'cost': 5 * n, 'audit': repeat('I', n), 'turns': turns} FROM ids, inserts WHERE inserts.s = 0
  UNION ALL
  SELECT b.conv_id, b.k + 1, i.t, min({'cost': b.w.cost + e.cost + 5 * i.n, 'audit': b.w.audit || e.edit || repeat('I', i.n), 'turns': b.w.turns || e.turn || i.turns})
  FROM best b JOIN ways e ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND e.k = b.k + 1 AND e.s = b.s JOIN inserts i ON i.s = e.t
  GROUP BY b.conv_id, b.k, i.t),
ends AS (SELECT conv_id, arg_max(w, k) AS w FROM (SELECT conv_id, k, min(w) AS w FROM best WHERE s IN (0, 3) GROUP BY conv_id, k) GROUP BY conv_id),
counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (y IS NOT NULL AND y || x NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, w.cost::BIGINT AS cost, w.audit AS audit, sha256(array_to_string(w.turns, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query(CONVERSATION_SQL)
def op13_conversations(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damage(rows), rows.select("conv_id")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
