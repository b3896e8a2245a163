"""The five pipelines: labelled and unlabelled tuning, by spelling and by meaning, and their application.

Candidates are found once for a shingle size and reduced to a maximum spanning forest, which
answers all thresholds; a sweep is a small table with a row for each configuration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolophon.config import Apply, Knn, LineFilter, MinHash, Quality, Sampling
from kolophon.functions import text as T
from kolophon.operators import evaluation, filters, jaccard, lsh, metrics, minhash, sampling, sweep, vectors
from kolophon.operators.graph import clusters_at, label_components, maximum_spanning_forest
from kolophon.runtime import Scratch


#: Characters of a long line that are looked at first; at least two for each word that a line may have.
HEAD = 1_000


def prepare_lines(lines: DataFrame, rule: LineFilter | None = None, normalize: Callable = T.normalize_v2) -> DataFrame:
    """Normalised lines that pass the filter; null texts go. All native, so it fuses with the scan.

    A long line is normalised as a whole only if its first characters do not have too many words already:
    what follows them can change those of the last `GAP_REACH` alone.
    """
    rule = rule or LineFilter()
    most = rule.max_words + T.GAP_REACH
    long = F.length("text") > HEAD
    words = T.word_count(normalize(F.when(long, F.substring("text", 1, HEAD)).otherwise(F.lit(""))))
    rows = lines.where("text IS NOT NULL").where(words <= most)
    # A generated column is not put into the filter, where it would be worked out again for each mention.
    rows = rows.select("*", F.explode(F.array(normalize(F.col("text")))).alias("clean"))
    return rows.where(filters.line_predicate(F.col("clean"), rule))


def sample_lines(lines: DataFrame, s: Sampling) -> DataFrame:
    """Lines of a stratified sample of documents of the right size."""
    docs = filters.sized_documents(lines, s.min_lines, s.max_lines)
    return lines.join(sampling.stratified_sample(docs, s.documents, s.seed).select("doc_id"), "doc_id", "left_semi")


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def find_duplicates(lines: DataFrame, cfg: MinHash, apply: Apply, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a configuration to prepared lines: (document pairs, document groups, document components).

    The pairs are all those in line clusters of up to ``apply.fan_out`` documents, and the links beyond.
    """
    scratch = scratch or Scratch(lines.sparkSession, "duplicates")
    sigs = scratch.save(minhash.signatures(lines, cfg), "signatures")
    # Representatives are clustered; the other lines with their signatures follow them.
    reps = scratch.save(lsh.representatives(sigs), "representatives")
    edges = lsh.representative_trees(reps, cfg).where(F.col("sim") >= apply.line_threshold)
    comps = label_components(reps.select(F.col("rep").alias("node")), edges, scratch).withColumnRenamed("node", "rep")
    clusters = lsh.members(sigs, reps).join(comps, "rep").select(F.col("line_id").alias("node"), "component")
    dc = scratch.save(jaccard.document_clusters(lines, clusters), "document_clusters")
    links = scratch.save(jaccard.document_links(dc, apply.fan_out).where(F.col("jaccard") >= apply.document_threshold), "links")
    found = jaccard.document_jaccard(dc, apply.fan_out).where(F.col("jaccard") >= apply.document_threshold).unionByName(links)
    # A link may know of clusters that the pair was not made for.
    pairs = scratch.save(found.groupBy("doc_a", "doc_b").agg(F.max("shared").alias("shared"), F.max("jaccard").alias("jaccard")), "pairs")
    docs = dc.select(F.col("doc_id").alias("node")).distinct()
    comps = scratch.save(label_components(docs, links.select(F.col("doc_a").alias("src"), F.col("doc_b").alias("dst")), scratch), "documents")
    return pairs, jaccard.duplicate_groups(comps), comps


def duplicate_summary(components: DataFrame) -> DataFrame:
    """One row: documents, groups, duplicated documents and their percentage."""
    row = metrics.size_summary(components)
    return row.select(
        F.col("n").alias("documents"),
        F.col("n_multi").alias("groups"),
        F.col("clustered").alias("duplicated"),
        F.when(F.col("n") > 0, 100.0 * F.col("clustered") / F.col("n")).otherwise(0.0).alias("percent"),
    )


def labelled_texts(lines: DataFrame, truth: str) -> DataFrame:
    """``(line_id, clean, lo, hi, m)``: distinct texts of labelled lines, named by their least, as units of evaluation."""
    return lines.groupBy("clean").agg(F.min("line_id").alias("line_id"), F.min(truth).alias("lo"), F.max(truth).alias("hi"), F.count(F.lit(1)).alias("m"))


def line_sweep(texts: DataFrame, sizes: DataFrame, ks: list[int], thresholds: list[float], cfg: MinHash, scratch: Scratch) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The table of line configurations, and the forest of each shingle size.

    Equal texts have equal signatures, so ``texts`` of `labelled_texts` are the vertices; ``sizes(gt, n_gt)``.
    """
    units = texts.select(F.col("line_id").alias("node"), "lo", "hi", "m", F.lit(True).alias("whole"))
    rows, forests = [], {}
    for k in ks:
        forests[k] = maximum_spanning_forest(lsh.text_trees(texts.select("line_id", "clean"), replace(cfg, k=k), scratch), scratch)
        rows.append(evaluation.evaluate_forest(units, sizes, forests[k], thresholds, scratch).select(F.lit(k).alias("k"), "*"))
    return scratch.save(_union(rows), "table"), forests


def tune_labelled(lines: DataFrame, ks: list[int], thresholds: list[float], cfg: MinHash, truth: str = "idgroup", document_truth: str | None = "type_id", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Grid search on ``lines(line_id, doc_id, clean, <truth>, <document_truth>)`` with ground truth.

    Returns the table of line configurations and, by the best of these, that of document thresholds.
    """
    scratch = scratch or Scratch(lines.sparkSession, "labelled")
    lines = scratch.save(lines.where(F.col(truth).isNotNull()), "lines")
    texts = scratch.save(labelled_texts(lines, truth), "texts")
    table, forests = line_sweep(texts, lines.groupBy(F.col(truth).alias("gt")).agg(F.count(F.lit(1)).alias("n_gt")), ks, thresholds, cfg, scratch)
    return table, labelled_documents(lines, texts, table, forests, document_truth, scratch)


def labelled_documents(lines: DataFrame, texts: DataFrame, table: DataFrame, forests: dict[int, DataFrame], document_truth: str | None, scratch: Scratch) -> DataFrame:
    """The table of document thresholds by the best line configuration of ``table``."""
    top = sweep.best(table, "recall", ["k", "threshold"]).first()
    if top is None:
        return table
    found = clusters_at(texts.select(F.col("line_id").alias("node")), forests[top.k], top.threshold, scratch=scratch)
    named = texts.select("clean", F.col("line_id").alias("_text")).join(found, F.col("_text") == F.col("node")).select("clean", "component")
    clusters = lines.select(F.col("line_id").alias("node"), "clean").join(named, "clean").select("node", "component")
    return document_sweep(lines, clusters, document_truth, scratch)


def document_sweep(lines: DataFrame, clusters: DataFrame, truth: str | None, scratch: Scratch, n: int = 15) -> DataFrame:
    """Documents joined by Jaccard of line clusters at each threshold of a grid, scored against labels."""
    dc = scratch.save(jaccard.document_clusters(lines, clusters), "document_clusters")
    counts = scratch.save(jaccard.jaccard_counts(dc, scratch), "counts")
    grid = [r.threshold for r in sweep.threshold_grid(counts, "jaccard", 5, 95, n, 3, 0.05, 0.99, "n").collect()] or sweep.FALLBACK
    forest = maximum_spanning_forest(jaccard.document_trees(dc, scratch), scratch)
    docs = dc.select(F.col("doc_id").alias("node")).distinct()
    if not truth:
        pairs = scratch.save(jaccard.document_jaccard(dc).select(F.col("doc_a").alias("src"), F.col("doc_b").alias("dst"), F.col("jaccard").alias("sim")), "pairs")
        return _union([metrics.document_metrics(docs, pairs, forest, t, scratch) for t in grid])
    labels = filters.keep_first(lines.where(F.col(truth).isNotNull() & F.col("doc_id").isNotNull()), ["doc_id"], ["line_id"])
    gt = evaluation.clusters_from_labels(labels, "doc_id", truth)
    units = docs.join(gt, "node", "left").select("node", F.col("cluster").alias("lo"), F.col("cluster").alias("hi"), F.lit(1).cast("long").alias("m"), F.col("cluster").isNotNull().alias("whole"))
    return evaluation.evaluate_forest(units, gt.groupBy(F.col("cluster").alias("gt")).agg(F.count(F.lit(1)).alias("n_gt")), forest, grid, scratch, least=2)


def tune_semantic_labelled(rows: DataFrame, truth: str, knn: Knn, n: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """Thresholds of a neighbour graph on ``rows(vec_id, embedding, <truth>)``, scored on clusters of two or more."""
    scratch = scratch or Scratch(rows.sparkSession, "semantic")
    cleaned = vectors.all_but_the_top(rows.withColumn("embedding", vectors.l2_normalize("embedding")), knn.abtt_global)
    near = scratch.save(vectors.knn_exact(cleaned, knn.k), "knn")
    edges = vectors.knn_edges(near)
    forest = maximum_spanning_forest(edges, scratch)
    grid = [r.threshold for r in sweep.threshold_grid(near.where("sim > 0"), "sim", 50, 99, n, 4).collect()] or sweep.FALLBACK
    units = rows.select(F.col("vec_id").alias("node"), F.col(truth).alias("lo"), F.col(truth).alias("hi"), F.lit(1).cast("long").alias("m"), F.col(truth).isNotNull().alias("whole"))
    sizes = rows.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("gt")).agg(F.count(F.lit(1)).alias("n_gt"))
    return evaluation.evaluate_forest(units, sizes, forest, grid, scratch, least=2)


def line_quality(lines: DataFrame, sigs: DataFrame, cfg: MinHash, threshold: float, scratch: Scratch, q: Quality | None = None, with_stability: bool = True) -> DataFrame:
    """The row of one configuration: all internal measures of line clusters and their composite."""
    q = q or Quality()
    reps = scratch.save(lsh.representatives(sigs), "representatives")
    pairs = lsh.representative_pairs(reps, cfg)  # read for one sum
    stars = lsh.members(sigs, reps).where("line_id != rep").select(F.col("rep").alias("src"), F.col("line_id").alias("dst"))
    nodes = sigs.select(F.col("line_id").alias("node"))
    edges = lsh.representative_trees(reps, cfg).where(F.col("sim") >= threshold).select("src", "dst").unionByName(stars)
    clusters = scratch.save(label_components(nodes, edges, scratch), "clusters")
    sim = lambda a, b: minhash.similarity(a, b, cfg.perms)
    values = sigs.select(F.col("line_id").alias("node"), "sig")
    row = metrics.clustering_metrics(clusters, lsh.intra_similarity(reps, pairs, threshold, cfg), values, "sig", sim, scratch, q)
    ranked = metrics.ranked_items(lines.select("line_id", "doc_id"), "line_id", scratch)
    row = row.crossJoin(metrics.within_between(lines, ranked, "sig", sim, values=sigs).select("within_between"))  # one row each
    stable = lsh.stability(sigs, cfg, threshold, scratch, q) if with_stability else 0.0
    row = row.withColumns({"k": F.lit(cfg.k), "threshold": F.lit(float(threshold)), "stability": F.lit(float(stable))})
    return metrics.composite_lines(row, q)


def tune_unlabelled(lines: DataFrame, ks: list[int], cfg: MinHash, sample: Sampling, scratch: Scratch | None = None, q: Quality | None = None) -> tuple[DataFrame, DataFrame]:
    """Grid search by internal quality on a sample: (line configurations, document thresholds by the best)."""
    scratch = scratch or Scratch(lines.sparkSession, "unlabelled")
    lines = scratch.save(sample_lines(lines, sample), "sample")
    rows, kept = [], {}
    for k in ks:
        c = replace(cfg, k=k)
        kept[k] = scratch.save(minhash.signatures(lines, c), "signatures")
        ranked = metrics.ranked_items(kept[k], "line_id", scratch)
        sim = lambda a, b: minhash.similarity(a, b, cfg.perms)
        for r in metrics.data_driven_thresholds(ranked, "sig", sim).collect():
            rows.append(scratch.save(line_quality(lines, kept[k], c, r.threshold, scratch, q), "row"))
    table = _union(rows)
    top = sweep.best(filters.without_degenerate(table), "composite", ["k", "threshold"]).first()
    nodes = kept[top.k].select(F.col("line_id").alias("node"))
    edges = lsh.line_edges(kept[top.k], replace(cfg, k=top.k)).where(F.col("sim") >= top.threshold)
    return table, document_sweep(lines, label_components(nodes, edges, scratch), None, scratch)


def tune_semantic(rows: DataFrame, knn: Knn, q: Quality | None = None, n: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """Thresholds of a neighbour graph on ``rows(vec_id, embedding, source)``, scored by internal quality."""
    q = q or Quality(nsr_low=0.10, nsr_high=0.50)
    scratch = scratch or Scratch(rows.sparkSession, "semantic")
    unit = rows.withColumn("embedding", vectors.l2_normalize("embedding"))
    cleaned = scratch.save(vectors.all_but_the_top(vectors.all_but_the_top_per_source(unit, knn.abtt_source), knn.abtt_global), "vectors")
    near = scratch.save(vectors.knn_exact(cleaned, knn.k), "knn")
    edges = scratch.save(vectors.knn_edges(near), "edges")
    grid = [r.threshold for r in sweep.threshold_grid(near.where("sim > 0"), "sim", 50, 99, n, 4).collect()] or sweep.FALLBACK
    nodes, values = cleaned.select(F.col("vec_id").alias("node")), cleaned.select(F.col("vec_id").alias("node"), "embedding")
    forest = maximum_spanning_forest(edges, scratch)
    out = []
    for t in grid:
        clusters = scratch.save(clusters_at(nodes, forest, t, scratch=scratch), "clusters")
        intra = edges.where(F.col("sim") >= t).agg(F.coalesce(F.avg("sim"), F.lit(0.0)).alias("intra"))
        row = metrics.clustering_metrics(clusters, intra, values, "embedding", vectors.dot, scratch, q)
        out.append(metrics.composite_mean(row).withColumn("threshold", F.lit(float(t))))
    return _union(out)
