"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(regexp_split_to_array({LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

COMPONENTS = """
, reach AS (
  SELECT a AS node, b AS other FROM edge
  UNION
  SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other
), component AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)
"""

OP1 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM doc WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), edge AS (
  SELECT a, b FROM shared s JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
) {COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN component ON node = doc_id
"""

OP8 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings
), fit AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND list_bool_and(list_transform(x, lambda c: c IS NOT NULL AND isfinite(c)))
    AND list_bool_or(list_transform(x, lambda c: c <> 0))
), edge AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM fit p JOIN fit q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.93
), degree AS (SELECT a AS node, count(DISTINCT b) AS links FROM edge GROUP BY a) {COMPONENTS}
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM v LEFT JOIN degree ON degree.node = vec_id LEFT JOIN component ON component.node = vec_id
"""

_CRC = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({id}, ''), lambda c: ascii(c)::UBIGINT)), "
    "lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"
)

OP3 = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC.format(id="doc_id::VARCHAR")} % 7 = 2, false) AS held, list_append({WORDS}, chr(0)) AS w FROM documents
), token AS (
  SELECT r, held, i, w[i] AS t, CASE WHEN i = 1 THEN chr(0) ELSE w[i - 1] END AS u, CASE WHEN i = 2 THEN chr(0) WHEN i > 2 THEN w[i - 2] END AS s FROM (SELECT r, held, w, unnest(range(1, len(w) + 1)) AS i FROM doc)
), one AS (SELECT t, count(*) AS c FROM token WHERE NOT held GROUP BY t),
two AS (SELECT u, t, count(*) AS c FROM token WHERE NOT held GROUP BY u, t),
three AS (SELECT s, u, t, count(*) AS c FROM token WHERE NOT held AND s IS NOT NULL GROUP BY s, u, t),
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM one),
p AS (
  SELECT k.r, k.i, coalesce(o.c, 0) AS c, (coalesce(o.c, 0) + 1.0::DOUBLE) / (n + v + 1) AS base, coalesce(b.c, 0) AS joint, coalesce(h.c, 0) AS context, coalesce(d.c, 0) AS joint3, coalesce(e.c, 0) AS context3
  FROM token k CROSS JOIN size LEFT JOIN one o ON o.t = k.t LEFT JOIN two b ON b.u = k.u AND b.t = k.t LEFT JOIN one h ON h.t = k.u
    LEFT JOIN three d ON d.s = k.s AND d.u = k.u AND d.t = k.t LEFT JOIN two e ON e.u = k.s AND e.t = k.u
), q AS (SELECT *, (joint + 200.0::DOUBLE * base) / (context + 200.0::DOUBLE) AS p2 FROM p)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, (SELECT n FROM size) AS train_tokens,
  round(sum(log10(base) ORDER BY i), 6) AS base_score, round(sum(log10((joint3 + 200.0::DOUBLE * p2) / (context3 + 200.0::DOUBLE)) ORDER BY i), 6) AS score
FROM doc JOIN q USING (r) GROUP BY r, doc_id, held
"""


OP11 = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\\x0A-\\x0D]')), '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM documents
), total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM piece GROUP BY lang),
gram AS (
  SELECT lang, w[i : i + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS m FROM piece))
), f AS (SELECT lang, p, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
part AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, n, (1000 * c.a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.p = c.p[:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:] JOIN total t ON t.lang = c.lang
), weakest AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, i.p, max(f) AS f FROM (SELECT lang, f, unnest([{{'p': p[1 : len(p) - 1]}}, {{'p': p[2 : len(p)]}}]) AS i FROM f WHERE len(p) > 2) GROUP BY ALL),
kept AS (
  SELECT w.lang, array_to_string(w.p, ' ') AS phrase, w.a, w.l, w.r, w.n, w.score FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.p = w.p WHERE g.f IS NULL OR g.f < w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

OP12 = """
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), known AS (SELECT doc_id, coalesce(max(quality), 0) AS quality, coalesce(max(toxic), 0) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic,
    map {
      'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
      'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)
    } AS f
  FROM t LEFT JOIN known USING (doc_id)
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), cell AS (
  SELECT part, f, quality, toxic, count(*) AS n FROM fails GROUP BY ALL
), placed AS (
  SELECT part, filter_order, step, f[filter_order[step]] AS fails, list_bool_or(list_append([f[filter_order[j]] FOR j IN range(1, step)], false)) AS gone,
    list_bool_or([f[filter_order[j]] FOR j IN range(1, 6) IF j <> step]) AS other, quality, toxic, n
  FROM cell, orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND NOT other), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (fails AND NOT gone AND quality = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM placed GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counted
"""

OP13 = """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), line AS (
  SELECT r, host, i, l, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS u
  FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM t)
), full_line AS (SELECT r, host, i, l, u, row_number() OVER (PARTITION BY r, l ORDER BY i) > 1 AS again FROM line WHERE len(u) > 0),
text_lines AS (SELECT r, any_value(host) AS host, list(l ORDER BY i) AS ls FROM full_line GROUP BY r),
host_docs AS (SELECT host, count(DISTINCT ls) AS host_docs FROM (SELECT t.host, coalesce(ls, []) AS ls FROM t LEFT JOIN text_lines USING (r)) GROUP BY host),
frequent AS (
  SELECT host, u FROM (SELECT f.host, u, count(DISTINCT ls) AS docs FROM full_line f JOIN text_lines USING (r) GROUP BY ALL) JOIN host_docs USING (host) WHERE docs > 20 AND docs > 0.01 * host_docs
), gone AS (SELECT r, count(*) AS n_lines, sum(len(u)) AS n_gone FROM full_line JOIN frequent USING (host, u) GROUP BY r),
dup AS (SELECT r, count(*) FILTER (again) AS n_dup_lines FROM full_line GROUP BY r),
win AS (SELECT r, i, w[i : i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
stat AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_removed_lines, coalesce(n_gone, 0) AS n_gone
  FROM t LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN gone USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_gone <= 0.5 * n_words AS kept, n_removed_lines
FROM stat
"""


def _op2() -> str:
    from .queries import RICH, RULES, SEEDS, THIN
    from .urlfilter import TemplateConfig

    c = TemplateConfig()
    rule = verdict = "NULL"
    for r in sorted(RULES, key=lambda r: (len(r), r)):
        name, _, tail = r.partition("/")
        fits = f"(host = '{name}' OR suffix(host, '.{name}')) AND starts_with(path, '/{tail}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{r}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{RULES[r]}' ELSE {verdict} END"
    keys = [f"s{k + 1}" for k in range(c.depth)]
    cut = ", ".join(f"coalesce(regexp_replace(parts[{k + 1}], '[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*', '*', 'g'), '') AS s{k + 1}" for k in range(c.depth))
    levels, last = "", "tree"
    for level in range(1, c.depth + 1):
        above = ", ".join(["host", *(f"t{k}" for k in range(1, level))])
        levels += f"""
, branch{level} AS (SELECT {above}, s{level}, sum(n) AS n, sum(bad) AS bad FROM {last} GROUP BY ALL),
node{level} AS (SELECT {above}, count(*) AS m, sum(n) AS all_n, sum(bad) AS all_bad FROM branch{level} GROUP BY ALL),
z{level} AS (
  SELECT {above}, s{level}, m, CASE WHEN m > {c.children} THEN coalesce(abs(bad / nullif(n, 0) - (all_bad - bad) / nullif(all_n - n, 0)) / nullif(sqrt(all_bad / nullif(all_n, 0) * (1 - all_bad / nullif(all_n, 0)) * (1 / nullif(n, 0) + 1 / nullif(all_n - n, 0))), 0), 0)
    ELSE abs((bad + (all_bad + 1.0::DOUBLE) / (all_n + 2)) / (n + 1) - (all_bad - bad + (all_bad + 1.0::DOUBLE) / (all_n + 2)) / (all_n - n + 1))
    / sqrt((all_bad + 1.0::DOUBLE) / (all_n + 2) * (1 - (all_bad + 1.0::DOUBLE) / (all_n + 2)) * (1.0::DOUBLE / (n + 1) + 1.0::DOUBLE / (all_n - n + 1))) END AS z
  FROM branch{level} JOIN node{level} USING ({above})
), grown{level} AS (
  SELECT g.*, CASE WHEN m > 1 AND z < {c.z} THEN '*' ELSE s{level} END AS t{level} FROM {last} g JOIN z{level} USING ({above}, s{level})
)"""
        last = f"grown{level}"
    shape = ", ".join(["host", *(f"t{k}" for k in range(1, c.depth + 1))])
    return f"""
WITH cut AS (
  SELECT page_id, url, html, coalesce(instr(url, '://') > 0, false) AS has, substr(url, instr(url, '://') + 3) AS rest FROM pages
), url AS (
  SELECT page_id, html, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS article, CASE WHEN has THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM cut
), judged AS (
  SELECT *, {rule} AS rule, {verdict} AS rule_verdict, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM url
), page AS (
  SELECT *, {cut}, CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(SEEDS)})([.-]|$)') THEN 1 WHEN rule_verdict = 'allow' THEN 0 WHEN words < {THIN} THEN 1 WHEN words >= {RICH} THEN 0 END AS bad
  FROM (SELECT *, len(regexp_extract_all(regexp_replace(CASE WHEN article <> '' THEN article ELSE html END, '<[^>]*>', ' ', 'g'), '[^\\x20\\x09-\\x0D]+')) AS words FROM judged)
), tree AS (SELECT host, {", ".join(keys)}, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM page GROUP BY ALL),
overall AS (SELECT (coalesce(sum(bad), 0) + {c.prior * c.strength}::DOUBLE) / (coalesce(sum(n), 0) + {c.strength}::DOUBLE) AS top FROM tree)
{levels}
, hosts AS (SELECT host, sum(n) AS host_n, sum(bad) AS host_bad FROM {last} GROUP BY host),
leaf AS (
  SELECT {shape}, (sum(bad) + {c.strength}::DOUBLE * any_value((host_bad + {c.strength}::DOUBLE * top) / (host_n + {c.strength}::DOUBLE))) / (sum(n) + {c.strength}::DOUBLE) AS purity
  FROM {last} JOIN hosts USING (host) CROSS JOIN overall GROUP BY {shape}
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN purity >= {c.reject} THEN 'block' ELSE 'allow' END) AS verdict,
  concat_ws('/', {shape}) AS template, round(purity, 6) AS purity
FROM page JOIN {last} USING (host, {", ".join(keys)}) JOIN leaf USING ({shape})
"""


ORACLE_SQL = {
    "op1_minhash_near_dedup": OP1,
    "op2_url_filters": _op2(),
    "op3_lm_scoring": OP3,
    "op8_embedding_near_dedup": OP8,
    "op11_phrase_collocation": OP11,
    "op12_filter_interaction": OP12,
    "op13_quality_rules": OP13,
}
