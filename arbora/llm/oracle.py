"""DuckDB SQL for the rows of each query that SQL can express."""

SQL: dict[str, str] = {}

#: Words of a text as a list; null and empty texts have none.
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL["op10_substring_dedup"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, {WORDS} AS w FROM documents),
win AS (
  SELECT r, k, p, array_to_string(w[p:p+12], ' ') AS s
  FROM (SELECT r, k, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
hit AS (SELECT r, p FROM (SELECT r, k, p, min(k) OVER (PARTITION BY s) AS least FROM win) WHERE k > least),
gone AS (SELECT DISTINCT r, p + i AS p FROM hit, range(0, 13) AS t(i)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n
  FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op8_minhash_near_dup"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ways AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM both_ways JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT v, c FROM reach JOIN link ON u = doc_id),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)"""

SQL["op9_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1], ' ') AS s
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item_id, w, least(len(w), 10) AS m FROM q WHERE len(w) > 0))),
size AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i+m-1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, size WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, i, m FROM dw JOIN win USING (m, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

SQL["op2_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {WORDS} AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
line AS (
  SELECT r, host, text, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT r, host, text, unnest(lines) AS x FROM d)),
freq AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM line WHERE norm <> '' GROUP BY ALL)
  JOIN (SELECT host, count(DISTINCT text) AS all_n FROM d GROUP BY host) USING (host) WHERE n >= 10 AND n * 100 > all_n * 2),
gone AS (SELECT r, count(*) AS removed_lines, sum(len(string_split(norm, ' '))) AS removed_words FROM line JOIN freq USING (host, norm) GROUP BY r),
base AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_lines, 0)::BIGINT AS removed_lines, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN repeated USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  removed_lines, removed_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - removed_words) >= 30 * n_words AS kept
FROM base"""


#: Levels that the SQL of the template tree is written out for: it is exact for tables whose paths have no more segments.
URL_LEVELS = 12


def _urls() -> str:
    from .urls import MIN_SHARE, MIN_SUPPORT, REJECT, RULES, Z2, A

    rules = ", ".join(f"('{r}', '{v}')" for r, v in RULES)
    sql = rf"""
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS x FROM pages),
p AS (
  SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(x, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(x, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rule, v) AS (VALUES {rules}),
parts AS (SELECT rule, v, regexp_extract(rule, '^([^/]*)', 1) AS rh, regexp_extract(rule, '^[^/]*(.*)$', 1) AS rp FROM rules),
fit AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM p JOIN parts
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r),
ruled AS (SELECT p.*, rule, v FROM p LEFT JOIN fit USING (r)),
t0 AS MATERIALIZED (
  SELECT host, path, count(*) AS n, count(rule) AS lab, count(*) FILTER (v = 'block') AS blk,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, '' AS template FROM ruled GROUP BY host, path)"""
    for d in range(URL_LEVELS):
        sql += rf""",
s{d} AS (SELECT host, template, segs[{d + 1}] AS seg, sum(n) AS n, sum(lab) AS lab, sum(blk) AS blk FROM t{d} WHERE len(segs) > {d} GROUP BY ALL),
l{d} AS (SELECT *, n >= {MIN_SUPPORT} AND n * 100 >= sum(n) OVER (PARTITION BY host, template) * {MIN_SHARE} AS literal FROM s{d}),
m{d} AS (
  SELECT *, sum(lab) FILTER (literal) OVER (PARTITION BY host, template) AS l, sum(blk) FILTER (literal) OVER (PARTITION BY host, template) AS b FROM l{d}),
k{d} AS (
  SELECT host, template, seg, template || '/' || CASE WHEN NOT literal THEN '*'
    WHEN lab = 0 THEN '~'
    WHEN (blk * l - lab * b)::DOUBLE * (blk * l - lab * b) <= {Z2}::DOUBLE * ((b + {A / 2}::DOUBLE) / (l + {A})) * (1 - (b + {A / 2}::DOUBLE) / (l + {A})) * lab * l * l THEN '~=' ELSE seg END AS next FROM m{d}),
t{d + 1} AS MATERIALIZED (
  SELECT t.host, t.path, t.n, t.lab, t.blk, t.segs, coalesce(k.next, t.template) AS template
  FROM t{d} t LEFT JOIN k{d} k ON k.host = t.host AND k.template = t.template AND k.seg = t.segs[{d + 1}])"""
    t = f"t{URL_LEVELS}"
    return sql + rf""",
prior AS (SELECT coalesce(sum(blk)::DOUBLE / nullif(sum(lab), 0), 0) AS prior FROM {t}),
bad AS (SELECT host, template, (sum(blk) + {A} * any_value(prior)) / (sum(lab) + {A}) >= {REJECT} AS rejected FROM {t}, prior GROUP BY host, template)
SELECT page_id, ruled.host, ruled.path, rule, coalesce(v, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template
FROM ruled JOIN {t} t ON ruled.host = t.host AND ruled.path = t.path JOIN bad USING (host, template)""".replace("JOIN bad USING (host, template)", "JOIN bad ON bad.host = t.host AND bad.template = t.template").replace("verdict, template\n", "verdict, t.template\n")


SQL["op5_url_filters"] = _urls()

SQL["op4_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS least FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to FROM q"""

SQL["op13_filter_interaction"] = r"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)),
cell AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (
  SELECT part, filter_order, step, n, good, toxic, fails, contains(fails, filter_order[step]) AS own,
    length(translate(filter_order[1:step-1], fails, '')) < step - 1 AS gone FROM cell, s)
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE own AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE fails = filter_order[step]), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(CASE WHEN own THEN n * 120 // length(fails) END), 0)::BIGINT AS shapley
FROM r GROUP BY part, filter_order, step"""

SQL["op11_embedding_near_dup"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(x, lambda e: e <> 0)) > 0),
link AS (
  SELECT a.r AS u, b.r AS v FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT r, r AS c FROM v UNION SELECT link.v, c FROM reach JOIN link ON reach.r = u),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = c GROUP BY reach.r),
n AS (SELECT u AS r, count(*) AS n FROM link GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v LEFT JOIN least USING (r) LEFT JOIN n USING (r)"""
