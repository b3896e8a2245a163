import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kolophon.config import Apply, MinHash, Quality, Sampling
from kolophon.operators import evaluation, filters, jaccard, lsh, metrics, minhash, sampling, sweep, vectors
from kolophon.operators.graph import boruvka, clusters_at, clusters_by_threshold, connected_components, label_components, maximum_spanning_forest
from kolophon.plans import pipelines
from kolophon.runtime import Scratch, with_global_index
from kolophon.sources.tables import LABELLED, TableCache, pivot_heatmap, read_verses, verse_lines, write_groups, write_pairs


def components(nodes, edges):
    p = {x: x for x in nodes}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    nodes = {x for e in edges for x in e}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = components(nodes, edges)
    assert got == {x: want[x] for x in {x for a, b in edges if a != b for x in (a, b)}}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, None)], "src long, dst long")).count() == 0
    alone = label_components(spark.createDataFrame([(7,)], "node long"), spark.createDataFrame([], "src long, dst long"))
    assert alone.first().asDict() == {"node": 7, "component": 7}


def test_forest_answers_thresholds(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.6), (4, 5, 0.8), (1, 3, 0.7)], "src long, dst long, sim double")
    forest = maximum_spanning_forest(edges)
    assert sorted(r.sim for r in forest.collect()) == [0.7, 0.8, 0.9]
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    for t, want in ((0.5, {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}), (0.75, {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7})):
        assert {r.node: r.component for r in clusters_at(nodes, forest, t).collect()} == want
    assert {r.node: r.component for r in clusters_at(nodes, forest, 0.8, strict=True).collect()}[5] == 5


def test_forest_by_joins_and_by_threshold(spark):
    rng = random.Random(3)
    edges = {}
    for _ in range(300):
        a, b = sorted(rng.sample(range(120), 2))
        edges[a, b] = rng.randrange(20) / 20
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "src long, dst long, sim double").repartition(6)
    # Kruskal, plainly: the multiset of weights is that of every maximum spanning forest.
    p = {x: x for e in edges for x in e}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    want = []
    for (a, b), s in sorted(edges.items(), key=lambda e: -e[1]):
        if find(a) != find(b):
            p[find(a)] = find(b)
            want.append(s)
    nodes = spark.createDataFrame([(i,) for i in range(130)], "node long")
    forests = [maximum_spanning_forest(df), maximum_spanning_forest(df, part_rows=25), boruvka(df, Scratch(spark, "t"))]
    for forest in forests:
        assert sorted((r.sim for r in forest.collect()), reverse=True) == want
        got = {(r.threshold, r.node): r.component for r in clusters_by_threshold(nodes, forest, [0.3, 0.9]).collect()}
        for t in (0.3, 0.9):
            assert {n: c for (u, n), c in got.items() if u == t} == components(range(130), [e for e, s in edges.items() if s >= t])


def test_global_index(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3).withColumn("w", F.col("id") % 5)
    rows = with_global_index(Scratch(spark, "t"), df, [F.desc("id")], group="g", weight="w").collect()
    for g in range(3):
        own = sorted((r for r in rows if r.g == g), key=lambda r: -r.id)
        total = 0
        for i, r in enumerate(own):
            assert (r.idx, r.weight_before) == (i, total)
            total += r.w


def test_document_jaccard(spark):
    sets = {"A": [1, 2, 3], "B": [2, 3, 4], "C": [9]}
    dc = spark.createDataFrame([(d, c) for d, v in sets.items() for c in v], "doc_id string, cluster long")
    assert [tuple(r) for r in jaccard.document_jaccard(dc).collect()] == [("A", "B", 2, 0.5)]
    assert jaccard.document_jaccard(dc, fan_out=1).count() == 0
    bins = jaccard.histogram(jaccard.document_jaccard(dc), "jaccard", [0, 0.5, 1.0], True).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in bins] == [(0, 1), (1, 0)]


def test_evaluation(spark):
    label = lambda cs: spark.createDataFrame([(n, i) for i, c in enumerate(cs) for n in c], "node string, cluster int")
    gt, pred = label(["ab", "c", "de"]), label(["ab", "cd", "e"])
    row = evaluation.evaluate(pred, gt).first()
    assert (row.perfect_clusters, row.recall, row.precision) == (1, 1 / 3, 1 / 3)
    multi = evaluation.evaluate(pred, gt, least=2).first()
    assert (multi.recall, multi.precision, multi.f1) == (0.5, 0.5, 0.5)


def test_evaluation_of_a_sweep(spark):
    rng = random.Random(4)
    rows = [(t, n, rng.randrange(1 + int(12 * t))) for t in (0.2, 0.5, 0.9) for n in range(40)]
    pred = spark.createDataFrame(rows, "threshold double, node long, cluster long")
    gt = spark.createDataFrame([(n, n // 2) for n in range(30)] + [(n, n) for n in range(30, 40)], "node long, cluster long")
    for least in (1, 2):
        got = {r.threshold: tuple(r)[1:] for r in evaluation.evaluate_sweep(pred, gt, "threshold", least).collect()}
        assert got == {t: tuple(evaluation.evaluate(pred.where(F.col("threshold") == t).drop("threshold"), gt, least).first()) for t in got} and len(got) == 3


def test_data_driven_thresholds(spark):
    rng = random.Random(6)
    same = lambda a, b: F.when(a == b, 0.9).otherwise(F.abs(a - b))
    for values, dense in (([rng.random() for _ in range(60)], True), ([0.0] * 60, True), ([i / 1e6 for i in range(60)], False)):
        ranked = spark.createDataFrame(list(enumerate(values)), "idx long, v double")
        pairs = sampling.random_pairs(60, 3000, 42, spark).collect()
        sims = np.array([0.9 if values[r.i] == values[r.j] else abs(values[r.i] - values[r.j]) for r in pairs])
        got = [r.threshold for r in metrics.data_driven_thresholds(ranked, "v", same).collect()]
        low, p, q, floor = (0.05, 20, 90, 0.25) if dense else (0.10, 30, 95, 0.40)
        sims = sims[sims > low]
        if not dense:
            assert not len(sims) and got == [0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]
            continue
        lo, hi = max(np.percentile(sims, p), floor), min(np.percentile(sims, q), 0.98)
        assert got == sorted({round(lo + i * (hi - lo) / 7, 2) for i in range(8)})


def test_document_metrics(spark):
    pairs = [(1, 2, 0.9), (2, 3, 0.6), (1, 3, 0.5), (4, 5, 0.7), (5, 6, 0.3), (3, 4, 0.2)]
    df = spark.createDataFrame(pairs, "src long, dst long, sim double")
    docs = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    scratch = Scratch(spark, "t")
    row = metrics.document_metrics(docs, df, maximum_spanning_forest(df), 0.5, scratch).first()
    # Groups 1 2 3 and 4 5 of seven; the forest's edges at or above the threshold: .9, .6, .7.
    assert (row.n, row.n_clusters, row.n_multi, row.clustered, row.max_size) == (7, 4, 2, 5, 3)
    assert abs(row.intra - (0.9 + 0.6 + 0.7) / 3) < 1e-9 and row.inter == 0 and abs(row.sil - 1) < 1e-9  # fewer than ten below
    spread = [1 - (0.9 + 0.6 + 0.5) / 3, 1 - 0.7]
    # The members drawn have the similarity .2 if they are 3 and 4, else none that is known.
    assert min(abs(row.dbi - sum(spread) / d) for d in (1.0, 0.8)) < 1e-9
    nsr = 5 / 7
    want = 0.3 * row.dbi_score + 0.25 * row.sil + 0.2 * max(0, 1 - ((nsr - 0.325) / 0.275) ** 2)
    assert abs(row.composite - want) < 1e-9


def test_stability_of_what_is_never_stable(spark):
    # A pair that is together in half of all runs has p (1 - p) = 1/4, so its stability is 0, and stays 0.
    items = spark.createDataFrame([(1,), (2,)], "id long")
    turn = []

    def edges(part):
        turn.append(1)
        both = part.crossJoin(part.select(F.col("id").alias("dst"))).select(F.col("id").alias("src"), "dst")
        return both if len(turn) % 2 else both.where("false")

    value = metrics.stability(items, "id", edges, Scratch(spark, "t"), Quality(runs=4, subsample=1.0, stability_pairs=5))
    assert value == 0.0


def test_sampling(spark):
    docs = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else "c") for i in range(100)], "doc_id long, source string")
    got = {r.source: r["count"] for r in sampling.stratified_sample(docs, 10).groupBy("source").count().collect()}
    assert got == {"a": 9, "b": 1, "c": 1}
    assert sampling.subsample(docs, "doc_id", 0.8, 1).count() == 80
    pairs = sampling.random_pairs(3, 50, 1, spark).collect()
    assert all(r.i != r.j and 0 <= r.i < 3 and 0 <= r.j < 3 for r in pairs)


def test_filters(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id long, k string")
    assert sorted(r.id for r in filters.keep_first(df, ["k"], ["id"]).collect()) == [1, 3]
    table = spark.createDataFrame([(1, True), (2, True)], "k int, degenerate boolean")
    assert filters.without_degenerate(table).count() == 2
    assert filters.without_degenerate(table.unionByName(spark.createDataFrame([(3, False)], table.schema))).count() == 1


def test_quality_parts(spark):
    df = spark.createDataFrame([(0.325,), (0.05,), (0.6,), (0.9,)], "nsr double")
    got = [r[0] for r in df.select(metrics.nsr_peaked(F.col("nsr"), 0.05, 0.60)).collect()]
    assert np.allclose(got, [1, 0, 0, 0])
    sims = spark.createDataFrame([(x / 10,) for x in range(11)], "sim double")
    assert [round(r.threshold, 3) for r in sweep.threshold_grid(sims, "sim", 0, 100, 3, 3).collect()] == [0.0, 0.5, 1.0]
    assert sweep.threshold_grid(sims.where("sim > 2"), "sim", 0, 100, 3, 3).count() == 0


LINES = [
    (1, 10, "of arms and the man i sing who forced by fate"),
    (2, 10, "of arms and the man i sing who forced by fate"),
    (3, 11, "of arms and the man i sang who forced by fate"),
    (4, 11, "sing goddess the anger of peleus son achilleus and its"),
    (5, 12, "sing goddess the anger of peleus son achilleus and its"),
    (6, 13, "tell me muse of the man of many ways who was driven"),
]


def test_minhash_and_lsh(spark):
    cfg = MinHash(k=3)
    lines = spark.createDataFrame(LINES, "line_id long, doc_id long, clean string")
    sigs = minhash.signatures(lines, cfg)
    by = {r.line_id: np.array(r.sig) for r in sigs.collect()}
    assert (by[1] == by[2]).all() and len(by[1]) == 128
    shingled = {i: {t[j : j + 3] for j in range(len(t) - 2)} for i, _, t in LINES}
    exact = len(shingled[1] & shingled[3]) / len(shingled[1] | shingled[3])
    assert abs((by[1] == by[3]).mean() - exact) < 0.2
    plain = {(r.src, r.dst) for r in lsh.candidate_pairs(sigs, cfg).collect()}
    assert {(1, 2), (4, 5), (1, 3), (2, 3)} <= plain
    # Through representatives the components are the same.
    for t in (0.3, 1.0):
        direct = label_components(lines.select(F.col("line_id").alias("node")), lsh.candidate_pairs(sigs, cfg).where(F.col("sim") >= t))
        short = label_components(lines.select(F.col("line_id").alias("node")), lsh.line_edges(sigs, cfg).where(F.col("sim") >= t))
        assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, short.collect()))
    assert minhash.signatures(spark.createDataFrame([(1, None)], "line_id long, clean string"), cfg).count() == 1


def test_apply_pipeline(spark):
    lines = spark.createDataFrame(LINES, "line_id long, doc_id long, clean string")
    pairs, groups, comps = pipelines.find_duplicates(lines, MinHash(k=3), Apply(0.5, 0.3, 500))
    assert [(r.group_id, r.members) for r in groups.collect()] == [(10, [10, 11, 12])]
    assert pipelines.duplicate_summary(comps).first().duplicated == 3
    assert {(r.doc_a, r.doc_b) for r in pairs.collect()} == {(10, 11), (11, 12)}


def test_copies_beyond_fan_out_stay_linked(spark):
    # Five copies, a near copy of them, a text alone; no cluster of the copies is in 3 documents or less.
    sets = {d: [1, 2, 3] for d in range(10, 15)} | {20: [1, 2, 3, 4], 30: [9]}
    dc = spark.createDataFrame([(d, c) for d, v in sets.items() for c in v], "doc_id long, cluster long")
    links = {(r.doc_a, r.doc_b): (r.shared, r.jaccard) for r in jaccard.document_links(dc, 3).collect()}
    assert links == {(10, d): (3, 1.0) for d in range(11, 15)} | {(10, 20): (3, 0.75)}
    lines = spark.createDataFrame([(d, d, LINES[0][2]) for d in range(10, 15)] + [(20, 20, LINES[5][2])], "line_id long, doc_id long, clean string")
    pairs, groups, _ = pipelines.find_duplicates(lines, MinHash(k=3), Apply(0.5, 0.5, 3))
    assert [(r.group_id, r.members) for r in groups.collect()] == [(10, [10, 11, 12, 13, 14])]
    assert {(r.doc_a, r.doc_b) for r in pairs.collect()} == {(10, d) for d in range(11, 15)}


def test_duplicate_groups_of_many_copies(spark, tmp_path):
    from kolophon import queries

    rows = [(d, LINES[0][2], "s") for d in range(25)] + [(40, LINES[3][2], "s"), (41, LINES[3][2] + " woes", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["duplicate_groups"](spark, str(tmp_path)).collect()
    assert (0, 25) in [(r.group_id, r.size) for r in got]


def test_labelled_sweep(spark):
    lines = spark.createDataFrame([(*x, g, y) for x, g, y in zip(LINES, [1, 1, 1, 2, 2, 3], ["p", "p", "q", "q", "q", "r"], strict=True)], "line_id long, doc_id long, clean string, idgroup long, type_id string")
    table, docs = pipelines.tune_labelled(lines, [3], [0.5], MinHash())
    assert table.first().recall == 1.0 and docs.count() > 0


def test_quality_row_and_stability(spark):
    lines = spark.createDataFrame(LINES, "line_id long, doc_id long, clean string")
    cfg, scratch = MinHash(k=3), Scratch(spark, "t")
    sigs = scratch.save(minhash.signatures(lines, cfg))
    row = pipelines.line_quality(lines, sigs, cfg, 0.5, scratch, Quality(runs=2, pairs=20, stability_pairs=10)).first()
    assert row.n == 6 and row.n_clusters == 3 and not row.degenerate and 0 < row.composite <= 1


def test_composite_query_is_whole(spark, sf_dir, monkeypatch):
    """With its stability term and the default numbers of pairs and runs."""
    from kolophon import queries

    asked, whole = [], pipelines.line_quality

    def line_quality(lines, sigs, cfg, threshold, scratch, q=None, with_stability=True):
        asked.append((q or Quality(), with_stability))
        few = spark.createDataFrame(LINES, "line_id long, doc_id long, clean string")
        sigs = scratch.save(minhash.signatures(few, cfg))
        return whole(few, sigs, cfg, threshold, scratch, replace(q or Quality(), runs=2), with_stability)

    monkeypatch.setattr(pipelines, "line_quality", line_quality)
    row = queries.QUERIES["composite"](spark, sf_dir).first()
    assert asked == [(Quality(), True)] and 0 < row.stability <= 1
    w = Quality().weights
    parts = w.dbi * row.dbi_score + w.sil * row.sil + w.nsr * row.nsr_peaked + w.within_between * row.within_between
    assert row.degenerate or abs(row.composite - parts - w.stability * row.stability) < 1e-9


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6)) + 3
    df = spark.createDataFrame([(i, v.tolist(), "s" if i % 2 else "t") for i, v in enumerate(x)], "vec_id long, embedding array<double>, source string")
    unit = {r.vec_id: np.array(r.u) for r in df.select("vec_id", vectors.l2_normalize("embedding").alias("u")).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in unit.values())
    got = np.array([r.embedding for r in vectors.all_but_the_top(df, 2).orderBy("vec_id").collect()])
    e = x - x.mean(axis=0)
    top = np.linalg.svd(e, full_matrices=False)[2][:2]
    want = e - e @ top.T @ top
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-8)
    per = np.array([r.embedding for r in vectors.all_but_the_top_per_source(df, 2).orderBy("vec_id").collect()])
    own = x[::2] - x[::2].mean(axis=0)
    top = np.linalg.svd(own, full_matrices=False)[2][:2]
    want = own - own @ top.T @ top
    assert np.allclose(per[::2], want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-8)
    near = vectors.knn_exact(df, 3).collect()
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    assert {(r.src, r.dst) for r in near} == {(i, j) for i in range(80) for j in np.argsort(-sims[i])[:3]}


def test_ivf_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    want = {(i, int(j)) for i in range(1500) for j in np.argsort(-sims[i])[:10]}
    got = vectors.knn_ivf(df, 10, 20, 8).collect()
    assert len(want & {(r.src, r.dst) for r in got}) / len(want) >= 0.9
    assert all(abs(r.sim - sims[r.src, r.dst]) < 1e-9 and r.src != r.dst for r in got[:500])
    assert len({(r.src, r.rank) for r in got}) == len(got)


def test_semantic_pipelines(spark):
    rng = np.random.default_rng(2)
    # The grid starts at the median similarity, which splits the looser of these clusters.
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.05 * rng.normal(size=16)).tolist(), str(i % 6), "s") for i in range(96)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, idgroup string, source string")
    from kolophon.config import Knn

    table = pipelines.tune_semantic_labelled(df, "idgroup", Knn(k=15, abtt_global=1), n=2)
    assert table.agg(F.max("f1")).first()[0] > 0.6
    assert pipelines.tune_semantic(df, Knn(k=15, abtt_source=1, abtt_global=1), Quality(pairs=20), n=2).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text('ID, Verse ,idgroup,IDORIGINAL_POEM,type_id\n1,"a, b",007,p1,t\n2,,8,p1,t\n')
    df = read_verses(spark, str(src), LABELLED, required=("type_id",))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "a, b", "007", "p1", "t"), ("2", None, "8", "p1", "t")]
    cache, calls = TableCache(spark, str(tmp_path / "cache")), []

    def compute():
        calls.append(1)
        return df

    for _ in range(2):
        assert TableCache(spark, cache.folder).get(("x", TableCache.fingerprint(df)), compute).count() == 2
    assert len(calls) == 1
    write_pairs(spark.createDataFrame([("a", "b", 0.5)], "doc_a string, doc_b string, jaccard double"), str(tmp_path / "pairs"))
    write_groups(spark.createDataFrame([(1, 2, ["a", "b"])], "group_id long, size long, members array<string>"), str(tmp_path / "groups"))
    assert spark.read.parquet(str(tmp_path / "groups")).first().members == ["a", "b"]
    sweep_table = spark.createDataFrame([(3, 0.5, 0.1), (4, 0.5, 0.2)], "k int, threshold double, m double")
    assert pivot_heatmap(sweep_table, "m").first().asDict() == {"threshold": 0.5, "3": 0.1, "4": 0.2}


def test_verses_to_pipeline(spark, tmp_path):
    src = tmp_path / "in.csv"
    text = [x[2] for x in LINES]
    src.write_text("id,verse,idgroup,idoriginal_poem,type_id\n" + "".join(f" {i + 1} ,{t} ,{g}, p{d} ,t{d}\n" for i, (t, g, d) in enumerate(zip(text, [1, 1, 1, 2, 2, 3], [1, 1, 2, 2, 3, 4], strict=True))))
    scratch = Scratch(spark, "t")
    lines = verse_lines(read_verses(spark, str(src), LABELLED), scratch)
    assert [tuple(r) for r in lines.orderBy("line_id").select("line_id", "doc_id", "text").collect()] == [(i, f"p{d}", t) for i, (t, d) in enumerate(zip(text, [1, 1, 2, 2, 3, 4], strict=True))]
    ready = pipelines.prepare_lines(lines)
    pairs, groups, _ = pipelines.find_duplicates(ready, MinHash(k=3), Apply(0.5, 0.3, 500))
    assert {(r.doc_a, r.doc_b) for r in pairs.collect()} == {("p1", "p2"), ("p2", "p3")}
    table, documents = pipelines.tune_labelled(ready, [3], [0.5, 0.9], MinHash())
    assert table.count() == 2 and documents.count() > 0


def test_unlabelled_pipeline(spark):
    rng = random.Random(2)
    rows, at = [], 0
    for d in range(40):
        for _ in range(3):
            words = LINES[rng.randrange(6)][2].split()
            words[rng.randrange(len(words))] = rng.choice(["sea", "ship", "oar"])
            rows.append((at, d, "s", " ".join(words)))
            at += 1
    lines = spark.createDataFrame(rows, "line_id long, doc_id long, source string, clean string")
    table, documents = pipelines.tune_unlabelled(lines, [3], MinHash(), Sampling(documents=30), q=Quality(runs=2, pairs=50, stability_pairs=20))
    got = table.collect()
    assert got and all(0 <= r.composite <= 1 and 0 <= r.stability <= 1 and r.k == 3 for r in got)
    assert documents.agg(F.max("composite")).first()[0] >= 0


def test_files_written_anew_are_another_input(spark, tmp_path):
    from kolophon import queries

    path = str(tmp_path / "documents.parquet")
    for n in (3, 4):
        spark.createDataFrame([(d, LINES[0][2], "s") for d in range(n)], "doc_id long, text string, source string").write.mode("overwrite").parquet(path)
        assert [r.size for r in queries.QUERIES["duplicate_groups"](spark, str(tmp_path)).collect()] == [n]


def test_signatures_of_long_and_many_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STEP", 50)
    monkeypatch.setattr(minhash, "CACHE", 120)
    rng, cfg = random.Random(1), MinHash(k=3, perms=8, bands=4)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 2, 30, 400]))) for _ in range(60)]
    a, b = minhash.coefficients(cfg)
    import hashlib

    def plain(t):
        h = np.array([int.from_bytes(hashlib.md5(t[j : j + 3].encode()).digest()[:4]) & minhash.PRIME for j in range(max(1, len(t) - 2))])
        return ((h[:, None] * a + b) % minhash.PRIME).min(axis=0).tolist()

    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["line_id", "text"])
    got = [x for out in minhash._signatures(iter([batch]), cfg) for x in out.column("sig").to_pylist()]
    assert got == [plain(t) for t in texts]


def test_hash_choice(spark):
    lines = spark.createDataFrame(LINES, "line_id long, doc_id long, clean string")
    a = minhash.signatures(lines, replace(MinHash(), hash="xxhash64")).first().sig
    assert len(a) == 128 and a != minhash.signatures(lines, MinHash()).first().sig
