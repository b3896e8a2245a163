"""What a query makes on the way grows with its input, and no faster."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from kolophon.config import MinHash, Quality
from kolophon.functions import text as T
from kolophon.operators import evaluation, jaccard, lsh, metrics, minhash, sweep, vectors
from kolophon.operators.graph import clusters_by_threshold, maximum_spanning_forest
from kolophon.plans import pipelines
from kolophon.runtime import Scratch


def near_copies(spark, n, cfg):
    rng = random.Random(3)
    words = ["arms", "and", "the", "man", "i", "sing", "who", "first", "from", "troy", "came", "to", "italy", "by", "fate"]
    rows = []
    for i in range(n):
        w = list(words)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    return minhash.signatures(spark.createDataFrame(rows, "line_id long, clean string"), cfg).cache()


def test_a_bucket_gives_a_tree_and_blocks_give_all_pairs(spark, monkeypatch):
    cfg = MinHash(k=3, perms=32, bands=8)
    sigs = near_copies(spark, 60, cfg)
    by = {r.line_id: np.array(r.sig) for r in sigs.collect()}
    bands = {i: {(b, tuple(s[b * 4 : b * 4 + 4].tolist())) for b in range(8)} for i, s in by.items()}
    want = {(i, j): (len(bands[i] & bands[j]), float((by[i] == by[j]).mean())) for i in by for j in by if i < j and bands[i] & bands[j]}
    whole = [(r.src, r.dst) for r in maximum_spanning_forest(spark.createDataFrame([(i, j, s) for (i, j), (_, s) in want.items()], "src long, dst long, sim double")).collect()]
    sizes = sigs.select("line_id", F.posexplode(F.array(*[F.slice("sig", b * 4 + 1, 4) for b in range(8)])).alias("band", "key")).groupBy("band", "key").count()
    most = sizes.agg(F.sum(F.col("count") - 1)).first()[0]
    for block in (1024, 16):
        monkeypatch.setattr(lsh, "BLOCK", block)
        got = lsh.candidate_pairs(sigs, cfg).collect()
        assert len(got) == len(want) and {(r.src, r.dst): (r.n_shared_bands, r.sim) for r in got} == want
        trees = lsh.candidate_trees(sigs, cfg)
        if block == 1024:
            assert trees.count() <= most < len(want)
        forest = sorted(r.sim for r in maximum_spanning_forest(trees).collect())
        assert forest == sorted(want[e][1] for e in whole)


def test_long_lines_are_told_by_their_heads(spark):
    texts = ["ab cd " * 400, "[" + "x " * 700, "… " * 700 + "one two three four five six", "a" * 1200 + " b c d e f", "b c d e " + "." * 1500 + " f g", " ".join(f"w{i}" for i in range(50)) + " " * 1500, None]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_id long, text string")
    got = {r.line_id: r.clean for r in pipelines.prepare_lines(lines).collect()}
    want = {r.line_id: r.clean for r in lines.select("line_id", T.normalize_v2(F.col("text")).alias("clean")).where(F.col("clean") != "").collect()}
    assert got == {i: c for i, c in want.items() if 6 <= len(c.split()) <= 50} and set(got) == {2, 3, 4, 5}
    plan = pipelines.prepare_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\p{N}_") <= 2


def test_a_search_moves_its_vectors_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "TILE", 5)
    monkeypatch.setattr(vectors, "HELD", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 8))
    x[60:80] = x[3]  # equal vectors are told apart by their ids alone
    df = spark.createDataFrame([(1000 - i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = vectors.knn_exact(df, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    sims = {(1000 - i, 1000 - j): float((x[i] * x[j]).sum()) for i in range(150) for j in range(150) if i != j}
    want = {a: [b for _, b in sorted((-sims[a, b], b) for b in range(851, 1001) if b != a)[:6]] for a in range(851, 1001)}
    got = {a: [] for a in want}
    for r in sorted(found.collect(), key=lambda r: (r.src, r.rank)):
        got[r.src].append(r.dst)
        assert r.sim == sims[r.src, r.dst] and r.rank == len(got[r.src])
    assert got == want
    by_cells = vectors.knn_ivf(df, 6, 3, 3)
    assert {(r.src, r.dst, r.rank) for r in by_cells.collect()} == {(a, b, i + 1) for a, v in want.items() for i, b in enumerate(v)}
    assert vectors.knn_exact(df.limit(0), 6).count() == 0 and vectors.knn_exact(df.limit(1), 6).count() == 0


def test_jaccard_is_counted_without_its_pairs(spark):
    rng = random.Random(8)
    sets = {d: {0} if d < 40 else {rng.randrange(12) for _ in range(rng.randrange(1, 5))} for d in range(70)}
    rows = [(d, c) for d, v in sets.items() for c in v | {100 + 3 * d + i for i in range(d % 3)}]  # and up to two of their own
    dc = spark.createDataFrame(rows, "doc_id long, cluster long")
    for cap in (None, 20):
        pairs = jaccard.document_jaccard(dc, cap)
        counts = jaccard.jaccard_counts(dc, Scratch(spark, "t"), cap).cache()
        got = {}
        for r in counts.collect():
            got[r.jaccard] = got.get(r.jaccard, 0) + r.n
        assert got == {r.jaccard: r["count"] for r in pairs.groupBy("jaccard").count().collect()}
        assert sum(got.values()) > 10 * counts.count()
        edges = [0, 0.1, 0.3, 0.5, 1.01]
        assert sorted(jaccard.histogram(counts, "jaccard", edges, True, "n").collect()) == sorted(jaccard.histogram(pairs, "jaccard", edges, True).collect())
        assert sweep.percentiles(counts, "jaccard", [5, 50, 99], "n").first() == sweep.percentiles(pairs, "jaccard", [5, 50, 99]).first()


def test_a_forest_is_evaluated_by_units(spark):
    rng = random.Random(9)
    edges = [(a, b, rng.choice([0.3, 0.5, 0.7])) for a, b in {tuple(sorted(rng.sample(range(30), 2))) for _ in range(25)}]
    members = [(u, n, rng.choice([None, u % 7, u % 7, 7 + u]) if u % 3 else u) for n, u in enumerate(list(range(30)) + [rng.randrange(30) for _ in range(30)])]
    lines = spark.createDataFrame(members, "unit long, node long, cluster long")
    forest = maximum_spanning_forest(spark.createDataFrame(edges, "src long, dst long, sim double"))
    units = lines.groupBy(F.col("unit").alias("node")).agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.count(F.lit(1)).alias("m"), F.min(F.col("cluster").isNotNull()).alias("whole"))
    truth = lines.where("cluster IS NOT NULL").select("node", "cluster")
    sizes = truth.groupBy(F.col("cluster").alias("gt")).agg(F.count(F.lit(1)).alias("n_gt"))
    found = clusters_by_threshold(units.select("node"), forest, [0.3, 0.6, 0.9]).withColumnRenamed("node", "unit")
    pred = lines.select("unit", "node").join(found, "unit").select("threshold", "node", F.col("component").alias("cluster")).cache()
    for least in (1, 2):
        got = evaluation.evaluate_forest(units, sizes, forest, [0.3, 0.6, 0.9], Scratch(spark, "t"), least).collect()
        want = evaluation.evaluate_sweep(pred, truth, "threshold", least).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and max(r.perfect_clusters for r in got) > 0


def test_trees_of_documents_and_texts(spark):
    rng = random.Random(10)
    sets = {d: {0} if d < 15 else {rng.randrange(8) for _ in range(rng.randrange(1, 5))} for d in range(40)}
    dc = spark.createDataFrame([(d, c) for d, v in sets.items() for c in v | {100 + 3 * d + i for i in range(d % 3)}], "doc_id long, cluster long")
    pairs = jaccard.document_jaccard(dc).select(F.col("doc_a").alias("src"), F.col("doc_b").alias("dst"), F.col("jaccard").alias("sim"))
    weights = lambda e: sorted(r.sim for r in maximum_spanning_forest(e).collect())
    assert weights(jaccard.document_trees(dc, Scratch(spark, "t"))) == weights(pairs)
    cfg = MinHash(k=3, perms=32, bands=8)
    texts = spark.createDataFrame([(i, f"arms and the man {'x' * (i % 4)} i sing who {i % 5}") for i in range(20)], "line_id long, clean string")
    assert weights(lsh.text_trees(texts, cfg, Scratch(spark, "t"))) == weights(lsh.candidate_pairs(minhash.signatures(texts, cfg), cfg))


def test_stability_of_all_runs_at_once(spark):
    cfg, scratch = MinHash(k=3, perms=32, bands=8), Scratch(spark, "t")
    sigs = scratch.save(near_copies(spark, 14, cfg).union(near_copies(spark, 3, cfg).select(F.col("line_id") + 50, "sig")))
    q = Quality(runs=3, subsample=0.6, stability_pairs=60)
    by = {r.line_id: tuple(r.sig) for r in sigs.collect()}
    ids = sorted(by)
    draw = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:8], 16)
    share = lambda a, b: sum(x == y for x, y in zip(by[a], by[b], strict=True)) / 32
    near = {(a, b): share(a, b) for a in ids for b in ids if a < b and any(by[a][i : i + 4] == by[b][i : i + 4] for i in range(0, 32, 4))}

    def plain(t):
        seen = {}
        for run in range(3):
            of = {x: x for x in sorted(ids, key=lambda x: (draw(42000 + run, x), x))[: int(len(ids) * 0.6)]}
            for (a, b), s in near.items():
                if s >= t and a in of and b in of:
                    of = {x: of[a] if c == of[b] else c for x, c in of.items()}
            for pair in range(60):
                i, j = (draw("stability42", side, pair) % len(ids) for side in "ab")
                a, b = ids[i], ids[(j + 1) % len(ids) if i == j else j]
                if a in of and b in of:
                    seen.setdefault(pair, []).append(of[a] == of[b])
        p = [sum(v) / len(v) for v in seen.values()]
        return 1 - 4 * sum(x * (1 - x) for x in p) / len(p)

    t = min(sorted(set(near.values())), key=plain)
    assert plain(t) < 1 and abs(lsh.stability(sigs, cfg, t, scratch, q) - plain(t)) < 1e-9


def test_only_drawn_values_are_looked_up(spark):
    cfg = MinHash(k=3, perms=32, bands=8)
    sigs = near_copies(spark, 40, cfg)
    ids = spark.createDataFrame([(i, i, i // 4) for i in range(40)], "idx long, line_id long, doc_id long")
    same = lambda a, b: minhash.similarity(a, b, 32)
    with_values = ids.join(sigs, "line_id")
    pairs = spark.createDataFrame([(0, 1, 2), (1, 2, 39)], "pair long, i long, j long")
    found = metrics.pair_similarities(pairs, ids, "sig", same, sigs)
    assert sorted(found.collect()) == sorted(metrics.pair_similarities(pairs, with_values, "sig", same).select(*found.columns).collect())
    assert metrics.corpus_density(ids, "sig", same, 50, values=sigs).first() == metrics.corpus_density(with_values, "sig", same, 50).first()
