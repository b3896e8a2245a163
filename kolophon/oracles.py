"""SQL that says the same as the queries, for another engine to check them."""

from __future__ import annotations

from functools import cache

from kolophon.config import MinHash
from kolophon.functions.text import GAPS
from kolophon.operators.minhash import PRIME, coefficients

RAW = """
lines AS (SELECT doc_id * 2147483648 + pos AS line_id, doc_id, pos, source, text FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))"""


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def punctuation(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"


V1 = squeeze(punctuation("translate(lower(strip_accents(text)), '(){}', '')"))
V1_LOWER = squeeze("lower(text)")
V2 = squeeze(punctuation(f"lower(strip_accents(regexp_replace(text, '{GAPS}', ' ', 'g')))"))
WORDS = r"len(list_filter(string_split_regex(clean, '\s+'), lambda x: x <> ''))"

NORM = RAW + f",\nnorm AS (SELECT *, {V2} AS clean FROM lines)"
PREP = NORM + f",\nprep AS (SELECT * FROM norm WHERE length(clean) >= 5 AND {WORDS} BETWEEN 6 AND 50)"


def hash32(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def shingle(k: int) -> str:
    return f"substr(clean, i, {k})"


def positions(k: int) -> str:
    return f"(SELECT line_id, clean, unnest(range(1, greatest(length(clean) - {k} + 1, 1) + 1)) AS i FROM prep)"


@cache
def signatures(cfg: MinHash) -> str:
    a, b = ("[" + ", ".join(map(str, x)) + "]::BIGINT[]" for x in coefficients(cfg))
    return PREP + f""",
perm AS (SELECT unnest({a}) AS a, unnest({b}) AS b, unnest(range({cfg.perms})) AS slot),
sh AS (SELECT DISTINCT line_id, ('0x' || substr(md5({shingle(cfg.k)}), 1, 8))::BIGINT & {PRIME} AS h FROM {positions(cfg.k)}),
slots AS (SELECT line_id, slot, min((a * h + b) % {PRIME}) AS v FROM sh, perm GROUP BY line_id, slot),
sigs AS (SELECT line_id, list(v ORDER BY slot) AS sig FROM slots GROUP BY line_id)"""


@cache
def candidates(cfg: MinHash) -> str:
    """Pairs of representatives of equal signatures, with their similarity."""
    return signatures(cfg) + f""",
reps AS (SELECT min(line_id) AS rep, count(*) AS m, sig FROM sigs GROUP BY sig),
bands AS (SELECT rep, b AS band, list_slice(sig, b * {cfg.rows} + 1, (b + 1) * {cfg.rows}) AS key, sig FROM (SELECT *, unnest(range({cfg.bands})) AS b FROM reps)),
rep_pairs AS (SELECT src, dst, n_shared_bands, list_sum(list_transform(range(1, {cfg.perms + 1}), lambda i: CASE WHEN s1[i] = s2[i] THEN 1 ELSE 0 END)) / {cfg.perms}.0 AS sim
  FROM (SELECT x.rep AS src, y.rep AS dst, count(*)::INT AS n_shared_bands, any_value(x.sig) AS s1, any_value(y.sig) AS s2
        FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.rep < y.rep GROUP BY x.rep, y.rep)),
members AS (SELECT line_id, rep FROM sigs JOIN reps USING (sig))"""


def components(vertices: str, edges: str, name: str = "comp") -> str:
    """``(node, component)`` by the transitive closure to lesser nodes; ``edges`` has src and dst."""
    return f""",
{name}_e AS (SELECT src AS a, dst AS b FROM ({edges}) UNION SELECT dst, src FROM ({edges})),
{name}_r(node, root) AS (SELECT node, node FROM ({vertices}) UNION SELECT e.b, r.root FROM {name}_r r JOIN {name}_e e ON e.a = r.node),
{name} AS (SELECT node, min(root) AS component FROM {name}_r GROUP BY node)"""


def forest_weights(pairs: str, name: str) -> str:
    """``(sim, edges)`` of a maximum spanning forest of ``pairs(src, dst, sim)``.

    At or above a similarity it has as many edges as the components there have nodes beyond their first.
    """
    return f""",
{name}_e AS (SELECT t, a, b FROM (SELECT DISTINCT sim AS t FROM ({pairs})) JOIN (SELECT src AS a, dst AS b, sim FROM ({pairs}) UNION SELECT dst, src, sim FROM ({pairs})) ON sim >= t),
{name}_r(t, node, root) AS (SELECT DISTINCT t, a, a FROM {name}_e UNION SELECT r.t, e.b, r.root FROM {name}_r r JOIN {name}_e e ON e.t = r.t AND e.a = r.node),
{name}_n AS (SELECT t, count(*) - count(DISTINCT root) AS m FROM (SELECT t, node, min(root) AS root FROM {name}_r GROUP BY t, node) GROUP BY t),
{name} AS (SELECT t AS sim, m - coalesce(lag(m) OVER (ORDER BY t DESC), 0) AS edges FROM {name}_n)"""


@cache
def clusters(cfg: MinHash, t: float) -> str:
    """Components of representatives, and of all lines through them."""
    return candidates(cfg) + components("SELECT rep AS node FROM reps", f"SELECT src, dst FROM rep_pairs WHERE sim >= {t}", "rc") + """,
clusters AS (SELECT line_id AS node, component FROM members JOIN rc ON rep = rc.node)"""


@cache
def document_pairs(cfg: MinHash, t: float, fan_out: int | None = None) -> str:
    cap = f" AND count(*) <= {fan_out}" if fan_out else ""
    return clusters(cfg, t) + f""",
dc AS (SELECT DISTINCT doc_id, component AS cluster FROM prep JOIN clusters ON line_id = node),
usable AS (SELECT cluster FROM dc GROUP BY cluster HAVING count(*) >= 2{cap}),
doc_size AS (SELECT doc_id, count(*) AS size FROM dc GROUP BY doc_id),
shared AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS shared FROM dc x JOIN dc y ON x.cluster = y.cluster AND x.doc_id < y.doc_id
  WHERE x.cluster IN (SELECT cluster FROM usable) GROUP BY x.doc_id, y.doc_id),
doc_pairs AS (SELECT doc_a, doc_b, shared, shared::DOUBLE / (a.size + b.size - shared) AS jaccard FROM shared JOIN doc_size a ON a.doc_id = doc_a JOIN doc_size b ON b.doc_id = doc_b)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.lstrip()}\n{select}"


def grid(sims: str, lo: float, hi: float, n: int, digits: int, low: float | None = None, high: float | None = None) -> str:
    """Equal steps between two quantiles, rounded half to even."""
    a = f"quantile_cont(sim, {lo / 100})"
    b = f"quantile_cont(sim, {hi / 100})"
    a = f"greatest({a}, {low})" if low is not None else a
    b = f"least({b}, {high})" if high is not None else b
    return f"SELECT DISTINCT round_even(a + i * (b - a) / {n - 1}.0, {digits}) AS threshold FROM (SELECT {a} AS a, {b} AS b FROM ({sims})), (SELECT unnest(range({n})) AS i)"


KNN = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
near AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.v, b.v) AS sim FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
knn AS (SELECT * FROM (SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM near) WHERE rank <= {k})"""
