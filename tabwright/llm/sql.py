"""SQL that checks the queries of this package on the same tables."""

from tabwright.llm.license_scan import GENERAL, RULES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_RULES = ", ".join(f"({k}, {_text(r.label)}, {r.priority}, {_text(r.keyword)}, {_text(r.pattern)})" for k, r in enumerate(RULES))
_GATE = " OR ".join(f"contains(s, {_text(w.replace(' ', '  '))})" for w in GENERAL)

OP2 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') AS x FROM documents),
d AS (SELECT r, doc_id, CASE WHEN x = '' THEN '' ELSE ' ' || x || ' ' END AS s FROM t),
rules(rule, label, priority, keyword, pattern) AS (VALUES {_RULES}),
phrases(label, pattern) AS (VALUES ('mit', ' mit  license '), ('apache', ' apache  license '), ('gpl', ' general  public  license ')),
words AS (SELECT r, doc_id, s, length(regexp_replace(s, '[^ ]', '', 'g')) // 2 AS n FROM d),
base AS (SELECT r, label, list_sum(list_transform(gaps[1:i], lambda g: length(regexp_replace(g, '[^ ]', '', 'g')) // 2))
  + (i - 1) * length(regexp_replace(pattern, '[^ ]', '', 'g')) // 2 AS w
  FROM (SELECT r, label, pattern, gaps, unnest(range(1, len(gaps))) AS i FROM (SELECT r, label, pattern, string_split(s, pattern) AS gaps FROM d, phrases WHERE contains(s, pattern)))),
hit AS (SELECT r, rule, label, priority, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (
  SELECT r, rule, label, priority, string_split_regex(s, pattern) AS gaps, regexp_extract_all(s, pattern) AS hits
  FROM (SELECT r, s FROM d WHERE {_GATE}), rules WHERE contains(s, keyword))),
det AS (SELECT r, rule, label, priority, list_sum(list_transform(gaps[1:i], lambda g: length(regexp_replace(g, '[^ ]', '', 'g')) // 2))
  + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(regexp_replace(g, '[^ ]', '', 'g')) // 2)), 0) AS a,
  length(regexp_replace(hits[i], '[^ ]', '', 'g')) // 2 AS n FROM hit),
kept AS (SELECT * FROM det x WHERE NOT EXISTS (SELECT 1 FROM det y WHERE y.r = x.r AND y.a <= x.a AND y.a + y.n >= x.a + x.n
  AND (y.a, y.n, y.rule) <> (x.a, x.n, x.rule) AND (y.priority > x.priority OR y.priority = x.priority AND (y.n > x.n OR y.rule < x.rule)))),
b AS (SELECT r, count(*) AS n, min(w) AS f, max(w) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(priority) AS p, sum(k) AS k FROM (
  SELECT r, label, priority, 1 AS k FROM kept UNION ALL SELECT r, label, 1, 0 FROM base) GROUP BY r)
SELECT doc_id, words.n::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  (CASE coalesce(every.p, 0) WHEN 0 THEN 0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.75 WHEN 3 THEN 0.9 ELSE 1 END)::DOUBLE AS score,
  coalesce(every.k, 0)::BIGINT AS n_found
FROM words LEFT JOIN b USING (r) LEFT JOIN every USING (r)"""

OP6 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
w AS (SELECT row_number() OVER () AS r, doc_id, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(s, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(s, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(s, '[^A-Z]', '', 'g'))::BIGINT AS n_upper FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * word_chars < 32 * n_words THEN 8 ELSE 0 END
  + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 32 ELSE 0 END
  + CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, 'web-2' AS policy FROM b"""


OP9 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, doc_id, a, array_to_string(ws[a:a + 19], ' ') AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS a FROM t)),
cov AS (SELECT r, a FROM (SELECT r, doc_id, a, min({'d': doc_id, 'a': a}) OVER (PARTITION BY g) AS f FROM win) WHERE f < {'d': doc_id, 'a': a}),
gone AS (SELECT DISTINCT r, unnest(range(a, a + 20)) AS p FROM cov),
words AS (SELECT r, p, ws[p] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM t)),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (r)"""


OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
use AS (SELECT q, w, count(*) AS c FROM (SELECT q, unnest(ws) AS w FROM i) GROUP BY q, w),
size AS (SELECT count(*) AS n, sum(len(ws)) AS l FROM d WHERE len(ws) > 0),
tf AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM use) GROUP BY r, w),
weight AS (SELECT w, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS x FROM tf, size GROUP BY w),
m AS (SELECT r, doc_id, (25 + (75 * len(ws) * n) // l)::BIGINT AS m FROM d, size WHERE len(ws) > 0),
s AS (SELECT q, r, sum(c * x * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM use JOIN weight USING (w) JOIN tf USING (w) JOIN m USING (r) GROUP BY q, r),
top AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM top JOIN i USING (q) WHERE rank <= 10"""


OP11 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
link AS (SELECT u, v FROM common JOIN n x ON x.r = u JOIN n y ON y.r = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(u, v) AS (SELECT u, v FROM edge UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u),
small AS (SELECT reach.u AS r, min(d.doc_id) AS m FROM reach JOIN d ON d.r = reach.v GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, m) AS component_id, doc_id = least(doc_id, m) AS kept FROM d LEFT JOIN n USING (r) LEFT JOIN small USING (r)"""
