import random

import numpy as np
import pytest
from brute import components, lines, ngram_join, substrings
from pyspark.sql import functions as F

from kolophon.llm import embedding_dedup, repeats
from kolophon.llm import ngram_join as nj
from kolophon.llm.line_dedup import LineRuns, line_dedup
from kolophon.llm.substrings import COVER, PERIOD, substring_dedup


def test_ngram_join(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(docs).collect()}
    assert got == ngram_join(corpus)


@pytest.mark.parametrize(("k", "percent"), [(1, 50), (3, 30)])
def test_ngram_join_other_parameters(docs, corpus, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(docs, k, percent).collect()}
    assert got == ngram_join(corpus, k, percent)


def test_ngram_join_finds_links_past_hubs(spark, monkeypatch):
    # A chain, each only near its neighbours: hubs do not see all links.
    monkeypatch.setattr(nj, "HUBS", 1)
    words = [f"c{i}" for i in range(160)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(20)]
    got = {r.doc_id: r.component_id for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in ngram_join(rows).items()} and len(set(got.values())) == 1


def test_ngram_join_edges(spark, no_docs):
    assert nj.ngram_join(no_docs).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "zz"), (None, "a b c d e f"), (2, "zz"), (3, "a b c d e f")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # Document 1 has two sets, and links with the equal one of each.
    assert got == [(0, 2, 0), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1)]


def test_ngram_join_compares_all_sets_of_a_doc_id(spark):
    x, y = ([f"{c}{i}" for i in range(60)] for c in "xy")
    rows = [(1, " ".join(x)), (1, " ".join(y[:50])), (2, " ".join(x + ["end"])), (3, " ".join(y[:49]))]
    got = nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 46, 1), (1, 56, 1), (2, 57, 1), (3, 45, 1)]


def test_ngram_join_of_many_near_copies_without_their_origin(spark, monkeypatch):
    monkeypatch.setattr(nj, "LOCAL_OFTEN", 3)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(3, 7)):
            w[rng.randrange(200)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == ngram_join(rows) and len({c for _, c in got.values()}) > 1


def test_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("flush", [50, repeats.FLUSH])
def test_substrings(docs, corpus, monkeypatch, flush):
    monkeypatch.setattr(repeats, "FLUSH", flush)
    got = {r.doc_id: (r.kept_text, r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}
    assert got == substrings(corpus)
    assert any(x[2] for x in got.values())


def test_substrings_edges(spark, no_docs):
    assert substring_dedup(no_docs).count() == 0
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, text + " end"), (3, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 30, 0), (1, 30, 0), (1, 30, 0), (2, 31, 30), (3, 0, 0)]
    with pytest.raises(ValueError):
        substring_dedup(no_docs, 5)


@pytest.mark.parametrize("batches", [1, 6])
def test_lines(docs, corpus, batches):
    out = line_dedup(docs, batches=batches)
    assert out.columns == [*docs.columns, "kept_text", "n_lines", "n_dropped"]
    assert {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in out.collect()} == lines(corpus)


def test_lines_edges(spark, no_docs):
    assert line_dedup(no_docs).count() == 0
    long = "x" * 40
    rows = [(i, f"{long}\nown {i}") for i in (1, 2, 3, 4, 4)] + [(None, long)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.agg(F.sum("n_dropped")).first()[0] == 0  # four documents, however many rows
    rows += [(5, long)]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1), (5, 0)]


def test_line_runs_compact(spark):
    runs = LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(100 - b, 1, 1), (100 - b, 2, b)], "doc_id long, k1 long, k2 long"))
    assert sum(map(len, runs.levels)) == 2 and len(runs.levels) == 3
    assert [tuple(r) for r in runs.repeated(5).collect()] == [(1, 1, 100)]


def brute_vectors(rows, threshold):
    ok = [(i, np.array(v, float), g) for i, v, g in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a[0], b[0]) for n, a in enumerate(ok) for b in ok[n + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= threshold]
    c = components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for x in (x for e in links for x in e):
        n[x] += 1
    return {i: (n[i], c[i], c[i] == i) for i in n}


@pytest.mark.parametrize("tile", [7, 1024])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 40))
    for i in range(30, 60):
        x[i] = x[i % 10] + rng.normal(size=40) * 0.02 * (i % 7)
    x[60:64] = x[3]
    x[64] = 5 * x[3]
    rows = [(i, [float(np.float32(y)) for y in v], i % 2 if i >= 60 else 0) for i, v in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 40, 0), (202, [None] * 40, 0), (203, [float("nan")] * 40, 0), (204, [], 0), (205, rows[3][1], None), (206, rows[3][1][:5], 0), (207, rows[4][1][:5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dedup(df).collect()}
    assert got == brute_vectors(rows, 0.98) and max(v[0] for v in got.values()) > 5
    assert embedding_dedup.embedding_near_dedup(df.where("false")).count() == 0


def test_embeddings_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, v, 1), (3, v, 1), (3, v, 1), (3, w, 1), (5, [1.0, 0.01, 0.0], 1), (None, [0.0, 0.0, 1.0], 1), (4, [float("inf"), 1.0, 0.0], 1)]
    got = embedding_dedup.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in got if r.vec_id) == [(3, 0, 3, True), (3, 3, 3, True), (3, 3, 3, True), (4, 0, 4, True), (5, 3, 3, False)]
    assert sorted((r.n_links, r.component_id or -1) for r in got if not r.vec_id) == [(0, -1), (3, 3)]
