import random
from collections import Counter, defaultdict

from brute import WORD, lines, ngram_join, targets

import corpus_pipeline
from kolophon.llm import queries
from kolophon.runtime import Scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "test")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.save(stage(spark, docs, sf_dir), name)
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "language_id":
            assert {r.doc_id for r in rows} == {i for i, r in before.items() if r.text and any(c.isalpha() for c in r.text)}
        if name == "line_dedup":
            want = lines([(i, r.text) for i, r in before.items()])
            assert {r.doc_id: r.text for r in rows} == {i: t for i, (t, _, dropped) in want.items() if not dropped or WORD.search(t)}
            assert all(r.n_chars == len(r.text) for r in rows if want[r.doc_id][2])
        if name == "ngram_join":
            want = ngram_join([(i, r.text) for i, r in before.items()])
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in want.items() if c == i)
        if name == "mixing":
            words = sum(len(WORD.findall(r.text)) for r in rows)
            whole = sum(len(WORD.findall(r.text)) for r in before.values())
            assert abs(words - 1.5 * whole) < 0.02 * whole
        if name == "packing":
            assert sum(r.piece == 0 for r in rows) == docs.count()
        docs, before = out, {r.doc_id: r for r in rows if "text" in out.columns}


def test_stages_edges(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["der", "und", "nicht", "the", "and", "with", "haus", "house"]) + str(rng.randrange(99)) for _ in range(n))
    text = prose(60)
    line = "This very line is in many of the documents, word for word."
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, prose(50), "en", "b"), (None, text, None, "a"), (None, prose(40), "en", None), (None, None, "en", "a"), (2, "", None, "a"), (3, "12 !?", "en", "a")]
    rows += [(10 + i, f"{prose(20)}\n{line}", "en", "b") for i in range(6)] + [(9, text + " more", "en", "b")]
    rows = [(d, t, g, s, len(t or ""), "clash", 7, "r", 1.5) for d, t, g, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, row long, kept_text string, copies double"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, ""), stage(spark, docs.where("false"), "")
        assert none.count() == 0, name
        if name == "packing":
            assert sum(r.piece == 0 for r in out.collect()) == len(rows)
            continue
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all((r.score, r.row, r.kept_text, r.copies) == ("clash", 7, "r", 1.5) for r in got)
        if name == "language_id":
            assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows if r[1] and any(c.isalpha() for c in r[1]))
        if name == "line_dedup":
            assert len(got) == len(rows) and [r.doc_id for r in got if line in (r.text or "")] == [15]
        if name == "ngram_join":
            # Copies by any doc_id, near copies, and nothing else.
            want = [r[:2] for r in rows if r[1] != text and r[0] != 9] + [(1, text)]
            assert Counter((r.doc_id, r.text) for r in got) == Counter(want)
        if name == "mixing":
            words = sum(len(WORD.findall(r.text or "")) for r in got)
            sizes = defaultdict(int)
            for r in rows:
                sizes[r[3]] += len(WORD.findall(r[1] or ""))
            assert abs(words - sum(targets(sizes).values())) <= 3 * 61 / 2
            assert max(Counter((r.doc_id, r.text) for r in got).values()) <= 4


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_queries_have_contract_columns(spark, sf_dir):
    want = {
        "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op2_cube_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op3_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op4_ngram_join": ["doc_id", "n_shingles", "component_id"],
        "op5_html_extraction": ["page_id", "url", "text", "n_chars"],
        "op6_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        "op7_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op8_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op9_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op10_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    }
    assert set(queries.QUERIES) == set(want)
    types = {"doc_id": "bigint", "page_id": "bigint", "vec_id": "bigint", "held_out": "boolean", "kept": "boolean", "score": "double", "target": "double", "piece": "int", "shard": "int", "grown_shard": "int", "near_edited": "double", "near_next": "double"}
    text = {"lang_pred", "law", "url", "text", "kept_sha256", "edited_sha256", "fingerprint", "edited_fingerprint"}
    for name, query in queries.QUERIES.items():
        got = query(spark, sf_dir)
        assert got.columns == want[name]
        assert dict(got.dtypes) == {c: types.get(c, "string" if c in text else "bigint") for c in want[name]}, name


def test_held_out_accuracy(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op1_language_id(spark, sf_dir).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [i for i, r in got.items() if r.held_out and lang[i]]
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.97 * len(held) > 0
