"""SQL for those of the queries that SQL can express, over small tables."""

from __future__ import annotations

import string

_SPACE = r"\x20\x09-\x0D"
_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"


def _components(vertices: str, edges: str) -> str:
    return f"""e AS (SELECT src AS a, dst AS b FROM ({edges}) UNION SELECT dst, src FROM ({edges})),
r(node, root) AS (SELECT node, node FROM ({vertices}) UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
comp AS (SELECT node, min(root) AS component FROM r GROUP BY node)"""


NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^{_SPACE}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) AS i FROM w)),
n AS (SELECT w.doc_id, count(g.g) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a AS src, b AS dst FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
{_components("SELECT doc_id AS node FROM w", "SELECT src, dst FROM links")}
SELECT doc_id, n AS n_shingles, component AS component_id FROM n JOIN comp ON node = doc_id"""

LINE_DEDUP = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), {_LOWER}) AS key FROM l),
held AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (top IS NOT NULL AND doc_id <> top) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (top IS NULL OR doc_id = top), '')) AS kept_sha256
FROM k LEFT JOIN held USING (key) GROUP BY doc_id"""

SUBSTRINGS = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
gone AS (SELECT word.doc_id, word.i, word, max(CASE WHEN later.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN later ON later.doc_id = word.doc_id AND later.i = word.i)
SELECT w.doc_id, count(word) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id GROUP BY w.doc_id"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM v WHERE label IS NOT NULL AND v IS NOT NULL),
links AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
{_components("SELECT vec_id AS node FROM v", "SELECT src, dst FROM links")}
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE src = node) AS n_links, component AS component_id, node = component AS kept FROM comp"""
