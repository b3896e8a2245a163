"""Internal quality of clusterings without ground truth.

Lines or documents carry an array, a signature or a unit vector, and ``similarity`` of two
such columns is given. Random choices are seeded hashes, so that any engine repeats them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolophon.config import Quality
from kolophon.functions.text import hash32
from kolophon.operators.filters import degenerate
from kolophon.operators.graph import label_components
from kolophon.operators.sampling import adjacent_pairs, random_pairs, subsample
from kolophon.runtime import Scratch, with_global_index

Similarity = Callable[[Column, Column], Column]


def ranked_items(items: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Items with a gapless number ``idx`` in the order of their key."""
    return scratch.save(with_global_index(scratch, items, [F.col(key)]), "ranked")


def nsr_peaked(nsr: Column, low: float, high: float) -> Column:
    """1 in the middle between low and high, 0 at both and beyond."""
    mid, half = (low + high) / 2, (high - low) / 2
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - ((nsr - mid) / half) * ((nsr - mid) / half)))


def pair_similarities(pairs: DataFrame, ranked: DataFrame, value: str, sim: Similarity, values: DataFrame | None = None) -> DataFrame:
    """``pairs(i, j, ...)``, some thousands, with the similarity of the items of these numbers.

    ``ranked`` has the values, or ``values(line_id, <value>)`` has them, of which only those of drawn items are moved.
    """
    if values is not None:
        drawn = F.broadcast(pairs.select(F.explode(F.array("i", "j")).alias("idx")).distinct())  # two for each pair
        ranked = values.join(F.broadcast(ranked.join(drawn, "idx").select("idx", "line_id")), "line_id")
    a, b = (ranked.select(F.col("idx").alias(n), F.col(value).alias(f"_{n}")) for n in ("i", "j"))
    return pairs.join(a, "i").join(b, "j").withColumn("sim", sim(F.col("_i"), F.col("_j"))).drop("_i", "_j")


def corpus_density(ranked: DataFrame, value: str, sim: Similarity, n_pairs: int = 2_000, seed: int = 42, values: DataFrame | None = None) -> DataFrame:
    """One row of random pairs' similarity: mean, p50, p90, nonzero (part above .05), dense."""
    pairs = random_pairs(ranked.count(), n_pairs, seed, ranked.sparkSession)
    s = pair_similarities(pairs, ranked, value, sim, values)
    row = s.agg(
        F.avg("sim").alias("mean"),
        F.percentile("sim", F.lit(0.5)).alias("p50"),
        F.percentile("sim", F.lit(0.9)).alias("p90"),
        F.avg((F.col("sim") > 0.05).cast("double")).alias("nonzero"),
    )
    return row.withColumn("dense", (F.col("nonzero") > 0.30) | (F.col("p50") > 0.15))


def data_driven_thresholds(ranked: DataFrame, value: str, sim: Similarity, n_steps: int = 8, seed: int = 42, values: DataFrame | None = None) -> DataFrame:
    """``(threshold)`` from the similarities of 3,000 random pairs; fixed high ones if hardly any is similar."""
    dense = bool(corpus_density(ranked, value, sim, 2_000, seed, values).first()["dense"])
    s = pair_similarities(random_pairs(ranked.count(), 3_000, seed, ranked.sparkSession), ranked, value, sim, values)
    low, p_low, p_high, floor, few = (0.05, 0.2, 0.9, 0.25, 21) if dense else (0.10, 0.3, 0.95, 0.40, 30)
    row = s.where(F.col("sim") > low).agg(F.count(F.lit(1)), F.percentile("sim", F.lit(p_low)), F.percentile("sim", F.lit(p_high))).first()
    spark = ranked.sparkSession
    if row[0] < few and not dense:
        # Thresholds where hardly any pair is similar.
        grid = [0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]
        return spark.createDataFrame([(x,) for x in grid], "threshold double")
    lo = max(row[1], floor) if row[0] >= few else 0.40
    hi = min(row[2] if row[2] is not None else 0.98, 0.98)
    steps = spark.range(n_steps).select(F.bround(F.lit(float(lo)) + F.col("id") * F.lit((hi - lo) / max(n_steps - 1, 1)), 2).alias("threshold"))
    return steps.distinct().orderBy("threshold")


def within_between(lines: DataFrame, ranked: DataFrame, value: str, sim: Similarity, seed: int = 42, values: DataFrame | None = None) -> DataFrame:
    """One row: within (neighbouring lines of a document), between (random lines of two), score w / (w + b)."""
    v = (ranked if values is None else values).select("line_id", F.col(value).alias("_v"))
    w = adjacent_pairs(lines).join(v.select(F.col("line_id").alias("a"), F.col("_v").alias("_a")), "a").join(v.select(F.col("line_id").alias("b"), F.col("_v").alias("_b")), "b")
    within = w.agg(F.coalesce(F.avg(sim(F.col("_a"), F.col("_b"))), F.lit(0.0)).alias("within"))
    pairs = random_pairs(ranked.count(), 1_000, f"between{seed}", ranked.sparkSession)
    doc = ranked.select(F.col("idx"), "doc_id")
    apart = pairs.join(doc.select(F.col("idx").alias("i"), F.col("doc_id").alias("di")), "i").join(doc.select(F.col("idx").alias("j"), F.col("doc_id").alias("dj")), "j").where("di != dj").orderBy("pair").limit(500)
    between = pair_similarities(apart, ranked, value, sim, values).agg(F.coalesce(F.avg("sim"), F.lit(0.0)).alias("between"))
    rows = within.crossJoin(between)  # one row each
    return rows.withColumn("within_between", F.col("within") / (F.col("within") + F.col("between") + 1e-9))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def size_summary(clusters: DataFrame) -> DataFrame:
    """One row: n, n_clusters (single ones too), n_multi, clustered, max_size, nsr."""
    s = cluster_sizes(clusters).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("n"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("size") >= 2, 1).otherwise(0)), F.lit(0)).alias("n_multi"),
        F.coalesce(F.sum(F.when(F.col("size") >= 2, F.col("size")).otherwise(0)), F.lit(0)).alias("clustered"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
    )
    return s.withColumn("nsr", F.when(F.col("n") > 0, F.col("clustered") / F.col("n")).otherwise(0.0))


def numbered_members(clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """``(c, at, size, node)``: members of clusters of two or more, clusters numbered by least member, members within."""
    multi = cluster_sizes(clusters).where("size >= 2")
    numbered = with_global_index(scratch, multi, [F.col("component")], index="c")
    inside = clusters.join(numbered, "component")
    ranked = with_global_index(scratch, inside, [F.col("node")], group="component", index="at")
    return scratch.save(ranked.select("c", "at", "size", "node"), "members")


def inter_similarity(members: DataFrame, values: DataFrame, value: str, sim: Similarity, n_pairs: int = 2_000, seed: int = 42) -> DataFrame:
    """``(inter)``: mean similarity of random members of random pairs of clusters."""
    n = members.agg(F.max("c")).first()[0]
    spark = members.sparkSession
    if n is None or n < 1:
        return spark.range(1).select(F.lit(0.0).alias("inter"))
    pairs = random_pairs(n + 1, n_pairs, f"inter{seed}", spark)
    size = members.select("c", "size").distinct()
    out = pairs
    for side in ("i", "j"):
        one = size.select(F.col("c").alias(side), F.col("size").alias("_n"))
        out = out.join(one, side).withColumn(f"{side}_at", hash32(f"member{side}{seed}", F.col("pair")) % F.col("_n")).drop("_n")
        node = members.select(F.col("c").alias(side), F.col("at").alias(f"{side}_at"), F.col("node").alias(f"{side}_node"))
        v = values.select(F.col("node").alias(f"{side}_node"), F.col(value).alias(f"_{side}"))
        out = out.join(node, [side, f"{side}_at"]).join(v, f"{side}_node")
    return out.agg(F.coalesce(F.avg(sim(F.col("_i"), F.col("_j"))), F.lit(0.0)).alias("inter"))


def spreads(members: DataFrame, values: DataFrame, value: str, sim: Similarity, cap: int = 200, most: int = 50, seed: int = 42) -> DataFrame:
    """``(c, spread)`` of the first clusters: 1 less the mean similarity of up to 50 random pairs of members."""
    members = members.where(F.col("c") < cap)
    size = members.select("c", "size").distinct()
    n = F.least(F.lit(most), F.col("size") * (F.col("size") - 1) / 2).cast("int")
    rows = size.select("c", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("p"))
    for side in ("x", "y"):
        rows = rows.withColumn(side, hash32(f"spread{side}{seed}", F.col("c"), F.col("p")) % F.col("size"))
    rows = rows.withColumn("y", F.when(F.col("x") == F.col("y"), (F.col("y") + 1) % F.col("size")).otherwise(F.col("y")))
    for side in ("x", "y"):
        node = members.join(values, "node").select("c", F.col("at").cast("long").alias(side), F.col(value).alias(f"_{side}"))
        rows = rows.join(node, ["c", side])
    return rows.groupBy("c").agg((1.0 - F.avg(sim(F.col("_x"), F.col("_y")))).alias("spread"))


def dbi(spread: DataFrame, members: DataFrame, values: DataFrame, value: str, sim: Similarity, seed: int = 42) -> DataFrame:
    """One row (dbi, dbi_score) over the clusters of ``spread``, at most some hundreds: the mean over clusters
    of the greatest (spread + spread) / separation, the latter of a random member of each."""
    picked = members.join(spread, "c").select("c", "at", "size", "node", "spread")
    s = spread.select("c", "spread")
    grid = s.select(F.col("c").alias("i"), F.col("spread").alias("si")).join(s.select(F.col("c").alias("j"), F.col("spread").alias("sj")), F.col("i") < F.col("j"))
    for side in ("i", "j"):
        n = picked.select(F.col("c").alias(side), F.col("size").alias("_n")).distinct()
        grid = grid.join(n, side).withColumn(f"{side}_at", hash32(f"dbi{side}{seed}", F.col("i"), F.col("j")) % F.col("_n")).drop("_n")
        v = picked.join(values, "node").select(F.col("c").alias(side), F.col("at").cast("long").alias(f"{side}_at"), F.col(value).alias(f"_{side}"))
        grid = grid.join(v, [side, f"{side}_at"])
    ratio = (F.col("si") + F.col("sj")) / F.greatest(1.0 - sim(F.col("_i"), F.col("_j")), F.lit(1e-6))
    r = grid.select("i", "j", ratio.alias("r"))
    worst = r.select(F.col("i").alias("c"), "r").unionByName(r.select(F.col("j").alias("c"), "r")).groupBy("c").agg(F.max("r").alias("r"))
    out = worst.agg(F.coalesce(F.avg(F.greatest(F.col("r"), F.lit(0.0))), F.lit(0.0)).alias("dbi"))
    return out.withColumn("dbi_score", 1.0 / (1.0 + F.col("dbi")))


def clustering_metrics(clusters: DataFrame, intra: DataFrame, values: DataFrame, value: str, sim: Similarity, scratch: Scratch, q: Quality | None = None, seed: int = 42) -> DataFrame:
    """One row of all internal measures but within_between and stability.

    ``clusters(node, component)``, ``intra(intra)`` and ``values(node, <value>)``.
    """
    q = q or Quality()
    members = numbered_members(clusters, scratch)
    spread = scratch.save(spreads(members, values, value, sim, q.clusters, seed=seed), "spread")
    inter = inter_similarity(members, values, value, sim, q.pairs, seed)
    row = size_summary(clusters).crossJoin(intra).crossJoin(inter).crossJoin(dbi(spread, members, values, value, sim, seed))  # one row each
    row = row.withColumn("sil", F.col("intra") / (F.col("intra") + F.col("inter") + 1e-12))
    row = row.withColumn("nsr_peaked", nsr_peaked(F.col("nsr"), q.nsr_low, q.nsr_high))
    return row.withColumn("degenerate", degenerate(F.col("n_clusters"), F.col("nsr"), F.col("max_size"), F.col("n"), q))


def composite_lines(row: DataFrame, q: Quality | None = None) -> DataFrame:
    """Weighted sum of all five parts; 0 for a degenerate clustering."""
    w = (q or Quality()).weights
    total = w.dbi * F.col("dbi_score") + w.sil * F.col("sil") + w.nsr * F.col("nsr_peaked") + w.within_between * F.col("within_between") + w.stability * F.col("stability")
    return row.withColumn("composite", F.when(F.col("degenerate"), 0.0).otherwise(total))


def composite_documents(row: DataFrame, q: Quality | None = None) -> DataFrame:
    w = (q or Quality()).weights
    return row.withColumn("composite", w.dbi * F.col("dbi_score") + w.sil * F.col("sil") + w.nsr * F.col("nsr_peaked"))


def composite_mean(row: DataFrame) -> DataFrame:
    return row.withColumn("composite", (F.col("dbi_score") + F.col("sil") + F.col("nsr_peaked")) / 3)


def stability(items: DataFrame, key: str, edges_of: Callable[[DataFrame], DataFrame], scratch: Scratch, q: Quality | None = None, seed: int = 42) -> float:
    """1 - 4 mean p (1 - p), with p how often a fixed pair is in one cluster over runs on subsamples.

    The same pairs are asked in every run, and a run counts for those that it has both members of.
    """
    q = q or Quality()
    ranked = ranked_items(items.select(F.col(key).alias("node")), "node", scratch)
    n = ranked.count()
    if n < 2:
        return 1.0
    pairs = random_pairs(n, q.stability_pairs, f"stability{seed}", items.sparkSession)
    ids = ranked.select("idx", "node")
    pairs = scratch.save(pairs.join(ids.select(F.col("idx").alias("i"), F.col("node").alias("a")), "i").join(ids.select(F.col("idx").alias("j"), F.col("node").alias("b")), "j").select("pair", "a", "b"), "pairs")
    seen = None
    for run in range(q.runs):
        part = scratch.save(subsample(items, key, q.subsample, seed * 1000 + run, scratch), "part")
        comps = label_components(part.select(F.col(key).alias("node")), edges_of(part), scratch)
        a, b = (comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        same = pairs.join(a, "a").join(b, "b").select("pair", (F.col("ca") == F.col("cb")).cast("double").alias("same"))
        seen = same if seen is None else seen.unionByName(same)
    p = seen.groupBy("pair").agg(F.avg("same").alias("p"))
    value = p.agg(1.0 - 4.0 * F.avg(F.col("p") * (1.0 - F.col("p")))).first()[0]
    return 1.0 if value is None else float(value)


def document_metrics(documents: DataFrame, pairs: DataFrame, forest: DataFrame, threshold: float, scratch: Scratch, q: Quality | None = None, seed: int = 42) -> DataFrame:
    """One row for documents joined at ``jaccard >= threshold``.

    ``documents(node)``; ``pairs(src, dst, sim)`` of all known similarities, 0 elsewhere; intra is
    the mean over the edges of a maximum spanning forest, inter over up to 2,000 pairs below.
    """
    q = q or Quality()
    clusters = scratch.save(label_components(documents, forest.where(F.col("sim") >= threshold), scratch), "clusters")
    members = numbered_members(clusters, scratch)
    intra = forest.where(F.col("sim") >= threshold).agg(F.coalesce(F.avg("sim"), F.lit(0.0)).alias("intra"))
    below = pairs.where((F.col("sim") < threshold) & (F.col("sim") > 0)).orderBy(hash32(f"below{seed}", F.col("src"), F.col("dst")), "src", "dst").limit(q.pairs)
    inter = below.agg(F.when(F.count(F.lit(1)) >= 10, F.avg("sim")).otherwise(0.0).alias("inter"))
    capped = members.where(F.col("c") < q.clusters)
    m = capped.select("node", "c")
    inside = pairs.join(m.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(m.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
    mean = inside.groupBy(F.col("cs").alias("c")).agg(F.avg("sim").alias("s"))
    spread = scratch.save(capped.select("c").distinct().join(mean, "c", "left").select("c", (1.0 - F.coalesce("s", F.lit(0.0))).alias("spread")), "spread")
    # The separation of two clusters: of a random member of each, as far as it is known.
    s = spread
    grid = s.select(F.col("c").alias("i"), F.col("spread").alias("si")).join(s.select(F.col("c").alias("j"), F.col("spread").alias("sj")), F.col("i") < F.col("j"))
    for side in ("i", "j"):
        n = capped.select(F.col("c").alias(side), F.col("size").alias("_n")).distinct()
        grid = grid.join(n, side).withColumn(f"{side}_at", hash32(f"dbi{side}{seed}", F.col("i"), F.col("j")) % F.col("_n")).drop("_n")
        grid = grid.join(capped.select(F.col("c").alias(side), F.col("at").cast("long").alias(f"{side}_at"), F.col("node").alias(f"n{side}")), [side, f"{side}_at"])
    known = grid.withColumns({"src": F.least("ni", "nj"), "dst": F.greatest("ni", "nj")}).join(pairs.select("src", "dst", "sim"), ["src", "dst"], "left")
    r = known.select("i", "j", ((F.col("si") + F.col("sj")) / F.greatest(1.0 - F.coalesce("sim", F.lit(0.0)), F.lit(1e-6))).alias("r"))
    worst = r.select(F.col("i").alias("c"), "r").unionByName(r.select(F.col("j").alias("c"), "r")).groupBy("c").agg(F.max("r").alias("r"))
    value = worst.agg(F.coalesce(F.avg(F.greatest(F.col("r"), F.lit(0.0))), F.lit(0.0)).alias("dbi")).withColumn("dbi_score", 1.0 / (1.0 + F.col("dbi")))
    row = size_summary(clusters).crossJoin(intra).crossJoin(inter).crossJoin(value)  # one row each
    row = row.withColumn("sil", F.col("intra") / (F.col("intra") + F.col("inter") + 1e-12)).withColumn("nsr_peaked", nsr_peaked(F.col("nsr"), q.nsr_low, q.nsr_high))
    return composite_documents(row, q).withColumn("threshold", F.lit(float(threshold)))
