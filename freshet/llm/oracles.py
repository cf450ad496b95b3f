"""DuckDB SQL for what SQL can express of this folder's queries."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = r"""
WITH pages AS (SELECT doc_id, source, text, coalesce(source, '') AS host FROM documents),
lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM pages),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
common AS (
  SELECT l.host, l.line FROM (SELECT host, line, count(DISTINCT doc_id) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY host, line) l
  JOIN totals t ON l.host = t.host WHERE l.n >= 5 AND l.n > 0.1 * t.pages),
marked AS (SELECT l.doc_id, l.line, l.pos, c.line IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.host = c.host AND l.line = c.line),
joined AS (SELECT doc_id, count(*) AS n, sum(gone::INT) AS d, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT p.doc_id, p.source, coalesce(j.n, 0)::BIGINT AS n_lines, coalesce(j.d, 0)::BIGINT AS n_dropped, j.kept AS text
FROM pages p LEFT JOIN joined j ON p.doc_id = j.doc_id
"""


def url_rules(rules: list[tuple[str, str]]) -> str:
    listed = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in rules)
    return rf"""
WITH rules AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM (VALUES {listed}) v(rule, verdict)),
cut AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS p, row_number() OVER () AS n FROM pages),
parts AS (SELECT n, page_id, translate(p.host, {LOWER}) AS host, p.path AS path FROM cut),
best AS (
  SELECT u.n, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict FROM parts u
  JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path) GROUP BY u.n)
SELECT u.page_id, u.host, u.path, b.rule, b.verdict AS rule_verdict FROM parts u LEFT JOIN best b ON u.n = b.n
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = rf"""(?:{_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRET_BASE = rf"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
kinds AS (
  SELECT n, 'assign' AS kind, 0 AS place, 6 AS least, regexp_extract_all(t, '{ASSIGN}', 0) AS found, regexp_extract_all(t, '{ASSIGN}', 1) AS judged, regexp_split_to_array(t, '{ASSIGN}') AS gaps FROM texts
  UNION ALL SELECT n, 'access', 1, 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM texts
  UNION ALL SELECT n, 'hex', 2, 24, regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_split_to_array(t, '[0-9a-f]+') FROM texts),
matches AS (SELECT n, kind, place, least, unnest(found) AS m, unnest(judged) AS v, unnest(gaps[1:len(found)]) AS gap, unnest(range(len(found))) AS i FROM kinds),
placed AS (
  SELECT n, kind, place, least, v, length(m) AS size,
    sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS start FROM matches WINDOW w AS (PARTITION BY n, kind ORDER BY i)),
spans AS (SELECT n, kind, place, start::BIGINT AS start, (start + size)::BIGINT AS stop FROM placed WHERE length(v) >= least),
listed AS (
  SELECT n, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS line FROM spans GROUP BY n)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(line, '')) AS base_sha256
FROM texts t LEFT JOIN listed l ON t.n = l.n
"""

QUALITY_BASE = rf"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT n, doc_id, t, regexp_extract_all(t, '{WORD}') AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '{WORD}')] AS lines FROM texts),
words AS (SELECT n, unnest(w) AS x, unnest(range(len(w))) AS i FROM split),
windows AS (SELECT n, i, x || ' ' || lead(x, 1) OVER q || ' ' || lead(x, 2) OVER q AS x FROM words WINDOW q AS (PARTITION BY n ORDER BY i)),
twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, x) AS c FROM windows WHERE x IS NOT NULL) WHERE c > 1),
covered AS (SELECT n, count(DISTINCT i + o) AS words FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY n),
counts AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.words, 0)::BIGINT AS n_repeat_words FROM split s LEFT JOIN covered c ON s.n = c.n)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""

TOP_K = """
WITH rows AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score FROM scored)
SELECT * FROM ranked WHERE "rank" <= 5
"""

#: Equal sets are one node, so that copies do not make pairs. Shingles are compared by 64-bit hashes.
JACCARD = rf"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{WORD}') AS w FROM documents),
words AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM texts),
shingles AS (SELECT r, x || ' ' || lead(x, 1) OVER q || ' ' || lead(x, 2) OVER q || ' ' || lead(x, 3) OVER q || ' ' || lead(x, 4) OVER q AS x FROM words WINDOW q AS (PARTITION BY r ORDER BY i)),
lists AS (SELECT r, list_sort(list(DISTINCT hash(x))) AS s FROM shingles WHERE x IS NOT NULL GROUP BY r),
sets AS (SELECT doc_id, CASE WHEN l.s IS NOT NULL THEN l.s WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END AS s FROM texts t LEFT JOIN lists l ON t.r = l.r),
nodes AS (SELECT min(doc_id) AS node, s FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT node, len(s) AS n, unnest(s) AS x FROM nodes),
numbered AS (SELECT node, n, x, row_number() OVER (PARTITION BY node ORDER BY c, x) AS place FROM (SELECT *, count(*) OVER (PARTITION BY x) AS c FROM tokens)),
first AS (SELECT node, n, x FROM numbered WHERE place <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.node AS a, b.node AS b FROM first a JOIN first b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
shared AS (SELECT p.a, p.b, count(*) AS k, any_value(x.n + y.n) AS total FROM pairs p JOIN tokens x ON p.a = x.node JOIN tokens y ON p.b = y.node AND x.x = y.x GROUP BY p.a, p.b),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (total - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN nodes n ON s.s = n.s LEFT JOIN least l ON n.node = l.node
"""
