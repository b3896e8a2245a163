"""From line clusters to documents: exact set Jaccard over an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolophon.runtime import Scratch


def document_clusters(lines: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(doc_id, cluster)``, distinct, of ``lines(line_id, doc_id)`` and ``clusters(node, component)``."""
    at = lines.where("doc_id IS NOT NULL").join(clusters, lines["line_id"] == clusters["node"])
    return at.select("doc_id", F.col("component").alias("cluster")).distinct()


def cluster_sets(dc: DataFrame) -> DataFrame:
    return dc.groupBy("doc_id").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))


def inverted_index(dc: DataFrame) -> DataFrame:
    return dc.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs"), F.array_sort(F.collect_list("doc_id")).alias("docs"))


def shared_counts(dc: DataFrame, fan_out: int | None = None) -> DataFrame:
    """``(doc_a, doc_b, shared)``, doc_a < doc_b. With ``fan_out``, clusters in more documents make no pairs."""
    n = dc.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs >= 2")
    if fan_out:
        n = n.where(F.col("n_docs") <= fan_out)
    usable = dc.join(n.select("cluster"), "cluster", "left_semi")
    a, b = (usable.select("cluster", F.col("doc_id").alias(x)) for x in ("doc_a", "doc_b"))
    return a.join(b, "cluster").where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.count(F.lit(1)).alias("shared"))


def document_jaccard(dc: DataFrame, fan_out: int | None = None) -> DataFrame:
    """``(doc_a, doc_b, shared, jaccard)``; sizes count all clusters, those beyond ``fan_out`` too."""
    size = dc.groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"))
    a, b = (size.select(F.col("doc_id").alias(x), F.col("size").alias(f"{x}_size")) for x in ("doc_a", "doc_b"))
    j = F.col("shared") / (F.col("doc_a_size") + F.col("doc_b_size") - F.col("shared"))
    return shared_counts(dc, fan_out).join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", "shared", j.alias("jaccard"))


def document_links(dc: DataFrame, fan_out: int | None = None) -> DataFrame:
    """``(doc_a, doc_b, shared, jaccard)`` with the components of `document_jaccard` at each threshold up to 1.

    Documents with equal sets are linked to the least of them, which alone is compared with others. So
    ``fan_out`` counts different sets, and a text with any number of copies keeps its links.
    """
    sets = cluster_sets(dc)
    reps = sets.groupBy("clusters").agg(F.min("doc_id").alias("rep"))
    stars = sets.join(reps, "clusters").where("doc_id != rep")
    alone = dc.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    equal = stars.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.size("clusters").cast("long").alias("shared"), F.lit(1.0).alias("jaccard"))
    return document_jaccard(alone, fan_out).unionByName(equal)


def document_classes(dc: DataFrame, scratch: Scratch, fan_out: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, cls, size)`` of documents with clusters that make pairs, and ``(a, b, shared)``, a < b, of their classes.

    Documents that have the same of these clusters are one class, named by its least document; ``size``
    counts all clusters. Two classes share as many clusters as any of their documents do.
    """
    n = dc.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs >= 2")
    n = (n.where(F.col("n_docs") <= fan_out) if fan_out else n).select("cluster", F.lit(True).alias("_in"))
    sets = dc.join(n, "cluster", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.when(F.col("_in"), F.col("cluster")))).alias("set"))
    sets = scratch.save(sets.where(F.size("set") > 0), "sets")
    classes = scratch.save(sets.groupBy("set").agg(F.min("doc_id").alias("cls")), "classes")
    docs = scratch.save(sets.join(classes, "set").select("doc_id", "cls", "size"), "classed")
    has = classes.select("cls", F.explode("set").alias("cluster"))
    a, b = (has.select("cluster", F.col("cls").alias(x)) for x in ("a", "b"))
    return docs, a.join(b, "cluster").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def jaccard_counts(dc: DataFrame, scratch: Scratch, fan_out: int | None = None) -> DataFrame:
    """``(jaccard, n)``: how many pairs of `document_jaccard` have which value, without making the pairs."""
    docs, pairs = document_classes(dc, scratch, fan_out)
    usable = dc.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs >= 2")
    usable = usable.where(F.col("n_docs") <= fan_out) if fan_out else usable
    own = dc.join(docs.select("cls").distinct().withColumnRenamed("cls", "doc_id"), "doc_id").join(usable, "cluster", "left_semi")
    own = own.groupBy(F.col("doc_id").alias("cls")).agg(F.count(F.lit(1)).alias("shared"))
    sizes = scratch.save(docs.groupBy("cls", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    a, b = (sizes.select(F.col("cls").alias(x), F.col("size").alias(f"{x}_size"), F.col("m").alias(f"{x}_m")) for x in ("a", "b"))
    across = pairs.join(a, "a").join(b, "b").select("shared", (F.col("a_size") + F.col("b_size")).alias("sizes"), (F.col("a_m") * F.col("b_m")).alias("n"))
    inside = own.join(a, F.col("cls") == F.col("a")).join(b, F.col("cls") == F.col("b")).where("a_size <= b_size")
    n = F.when(F.col("a_size") < F.col("b_size"), F.col("a_m") * F.col("b_m")).otherwise(F.expr("a_m * (a_m - 1) div 2"))
    inside = inside.select("shared", (F.col("a_size") + F.col("b_size")).alias("sizes"), n.alias("n"))
    found = across.unionByName(inside).groupBy("shared", "sizes").agg(F.sum("n").alias("n")).where("n > 0")
    return found.select((F.col("shared") / (F.col("sizes") - F.col("shared"))).alias("jaccard"), "n")


def document_trees(dc: DataFrame, scratch: Scratch) -> DataFrame:
    """``(src, dst, sim)``: a maximum spanning forest of these is one of all pairs of `document_jaccard`.

    Documents of one class and size are equally near to all others. The least of them stands for them in the
    pairs; each other one adds its best edge to the forest, to that one or to the nearest of another class.
    """
    docs, pairs = document_classes(dc, scratch)
    n = dc.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs >= 2")
    own = dc.join(docs.select("cls").distinct().withColumnRenamed("cls", "doc_id"), "doc_id").join(n, "cluster", "left_semi")
    own = own.groupBy(F.col("doc_id").alias("cls")).agg(F.count(F.lit(1)).alias("shared"))
    reps = docs.groupBy("cls", "size").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).join(own, "cls")
    reps = scratch.save(reps, "stand_for")
    a, b = (reps.select(F.col("cls").alias(x), F.col("size").alias(f"{x}_size"), F.col("rep").alias(f"{x}_rep")) for x in ("a", "b"))
    j = (F.col("shared") / (F.col("a_size") + F.col("b_size") - F.col("shared"))).alias("sim")
    across = pairs.join(a, "a").join(b, "b").select("a_rep", "b_rep", j)
    inside = a.join(b, F.col("a") == F.col("b")).where("a_size < b_size").join(own, F.col("a") == F.col("cls")).select("a_rep", "b_rep", j)
    edges = scratch.save(across.unionByName(inside).select(F.least("a_rep", "b_rep").alias("src"), F.greatest("a_rep", "b_rep").alias("dst"), "sim"), "edges")
    both = edges.select(F.col("src").alias("rep"), F.col("dst").alias("to"), "sim").unionByName(edges.select(F.col("dst").alias("rep"), F.col("src").alias("to"), "sim"))
    near = both.groupBy("rep").agg(F.max(F.struct("sim", "to")).alias("best"))
    same = F.col("shared") / (2 * F.col("size") - F.col("shared"))
    copies = docs.join(reps.where("m > 1"), ["cls", "size"]).where("doc_id != rep").join(near, "rep", "left")
    best = F.greatest(F.struct(same.alias("sim"), F.col("rep").alias("to")), F.col("best"))
    copies = copies.select("doc_id", best.alias("e")).select(F.least("doc_id", "e.to").alias("src"), F.greatest("doc_id", "e.to").alias("dst"), "e.sim")
    return edges.unionByName(copies)


def exact_jaccard(pairs: DataFrame, sets: DataFrame, key: str, values: str) -> DataFrame:
    """Jaccard of two array columns for ``pairs(src, dst)``."""
    a, b = (sets.select(F.col(key).alias(x), F.col(values).alias(f"{x}_set")) for x in ("src", "dst"))
    shared = F.size(F.array_intersect("src_set", "dst_set"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", (shared / F.size(F.array_union("src_set", "dst_set"))).alias("jaccard"))


def histogram(sims: DataFrame, sim: str, edges: list[float], right_closed: bool, weight: str | None = None) -> DataFrame:
    """``(bin, n, percent)`` for each interval (edges[i], edges[i + 1]], or [.., ..) if not ``right_closed``.

    A row counts once, or as often as its ``weight``.
    """
    each = F.sum(weight) if weight else F.count(F.lit(1))
    x = F.col(sim)
    bin_: Column = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (x > lo) & (x <= hi) if right_closed else (x >= lo) & (x < hi)
        bin_ = F.when(inside, i).otherwise(bin_)
    counted = sims.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("bin").agg(each.alias("n"))
    every = sims.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    total = sims.agg(F.coalesce(each, F.lit(0)).alias("total"))
    rows = every.join(counted, "bin", "left").join(F.broadcast(total))  # one row
    return rows.select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("total") > 0, 100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("percent"))


def duplicate_groups(components: DataFrame) -> DataFrame:
    """``(group_id, size, members)`` of components with at least two documents; group_id is the least."""
    grouped = components.groupBy(F.col("component").alias("group_id")).agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
    return grouped.where("size >= 2")
