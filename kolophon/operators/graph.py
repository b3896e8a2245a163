"""Connected components by alternating star contraction (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolophon.runtime import Scratch


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges that point from the larger to the smaller node, without loops."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )


def _with_least(rows: DataFrame, low: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``m`` of their node in ``low(src, m)``.

    The second key has ``low`` shuffled anew after its aggregate, so that both sides are plain
    shuffles and adaptive execution can split the rows of a hub.
    """
    low = low.select(F.col("src").alias("_at"), F.xxhash64("src").alias("_h"), "m")
    return rows.join(low, (rows[key] == F.col("_at")) & (F.xxhash64(rows[key]) == F.col("_h"))).drop("_at", "_h")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    # Of a node's neighbours only the larger ones are hung below its least neighbour;
    # they are exactly the edges that point to the node.
    up = e.select(F.col("dst").alias("at"), F.col("src").alias("v"))
    return _with_least(up, low, "at").select(F.col("v").alias("src"), F.col("m").alias("dst"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("src").agg(F.min("dst").alias("m"))
    hung = _with_least(e, low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return hung.unionByName(low.select("src", F.col("m").alias("dst"))).where(F.col("src") != F.col("dst"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first())


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that an edge touches; component is its least node.

    ``edges`` has comparable columns ``src`` and ``dst``. Loops, duplicates and direction do
    not matter; rows with a null end are ignored. An empty table gives an empty result. Each
    round is two joins over at most as many rows as there are edges; the number of rounds
    grows with the logarithm of the longest path. The rows of a hub, a node with very many
    neighbours, meet in one key of these joins, which adaptive execution can split.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = scratch.save(_canonical(edges.select("src", "dst").dropna()), "edges")
    before = _state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # The result of one round: small-star applied to large-star.
        new = scratch.save(_canonical(_small_star(_canonical(_large_star(e)))), "stars")
        scratch.drop(e)
        e, after = new, _state(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def label_components(vertices: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(node, component)`` for all of ``vertices(node)``, isolated ones alone in theirs."""
    found = connected_components(edges, scratch)
    return vertices.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maximum spanning forest of the edges of one partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    table = table.sort_by([("sim", "descending"), ("src", "ascending"), ("dst", "ascending")])
    src, dst = table.column("src").to_pylist(), table.column("dst").to_pylist()
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for a, b in zip(src, dst, strict=True):
        ra, rb = find(a), find(b)
        keep.append(ra != rb)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    yield from table.filter(pa.array(keep)).combine_chunks().to_batches()


def boruvka(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The maximum spanning forest of ``edges(src, dst, sim)`` by joins alone.

    In each round every component takes its best edge to another, the first by (sim, src, dst); what
    these join is one component of the next. The number of components at least halves in a round.
    """
    best = F.min(F.struct((-F.col("sim")).alias("w"), "a", "b", "src", "dst")).alias("e")
    out = None
    cur = edges.select("src", "dst", "sim", F.col("src").alias("a"), F.col("dst").alias("b"))
    while not cur.isEmpty():
        ends = cur.withColumn("end", F.explode(F.array("src", "dst")))
        picked = scratch.save(ends.groupBy("end").agg(best).select("e.*").distinct(), "picked")
        own = picked.select(F.col("a").alias("src"), F.col("b").alias("dst"), (-F.col("w")).alias("sim"))
        out = own if out is None else out.unionByName(own)
        comps = scratch.save(connected_components(picked.select("src", "dst"), scratch), "merged")
        for end in ("src", "dst"):
            to = comps.select(F.col("node").alias(end), F.col("component").alias("_to"))
            cur = cur.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        # Of parallel edges the best stays.
        cur = cur.where("src != dst").withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}).groupBy("src", "dst").agg(F.min(F.struct((-F.col("sim")).alias("w"), "a", "b")).alias("e"))
        cur = scratch.save(cur.select("src", "dst", (-F.col("e.w")).alias("sim"), "e.a", "e.b"), "contracted")
    return edges if out is None else out


def maximum_spanning_forest(edges: DataFrame, scratch: Scratch | None = None, part_rows: int = 2_000_000) -> DataFrame:
    """``(src, dst, sim)``: edges of a maximum spanning forest, which answers every threshold.

    The forest of a union is the forest of the forests' union, so partitions of ``part_rows``
    are reduced in rounds, each dealing the rest into fewer of them. Where more are left than
    one partition may hold and a round no longer shrinks them, `boruvka` ends it with joins. Ties
    give one of several forests; the weights are those of all.
    """
    scratch = scratch or Scratch(edges.sparkSession, "forest")
    e = edges.select("src", "dst", F.col("sim").cast("double").alias("sim")).dropna().where("src != dst")
    n = None
    while True:
        e = scratch.save(e, "forest")
        m = e.count()
        parts = max(1, -(-m // part_rows))
        if n is not None and (parts == 1 and n == 1):
            return e
        if n is not None and parts >= n > 1:
            return boruvka(e, scratch)
        e, n = e.repartition(parts).mapInArrow(_kruskal, e.schema), parts


def clusters_by_threshold(vertices: DataFrame, forest: DataFrame, thresholds: list[float], scratch: Scratch | None = None) -> DataFrame:
    """``(threshold, node, component)``: `clusters_at` of all thresholds in one run, over copies of the nodes."""
    ts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t")
    at = lambda c: F.struct("t", F.col(c).alias("node"))
    edges = forest.select("src", "dst", "sim", ts).where("sim >= t").select(at("src").alias("src"), at("dst").alias("dst"))
    found = label_components(vertices.select("node", ts).select(at("node").alias("node")), edges, scratch)
    return found.select(F.col("node.t").alias("threshold"), F.col("node.node").alias("node"), F.col("component.node").alias("component"))


def clusters_at(vertices: DataFrame, forest: DataFrame, threshold: float, strict: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """``(node, component)`` of all vertices with the edges at or above the threshold, above it if ``strict``."""
    keep = F.col("sim") > threshold if strict else F.col("sim") >= threshold
    return label_components(vertices, forest.where(keep), scratch)
