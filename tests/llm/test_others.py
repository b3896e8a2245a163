import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import WORD, targets
from pyspark.sql import functions as F

from kolophon.llm import html_extraction, packing
from kolophon.llm.fingerprints import fingerprint_documents
from kolophon.llm.html_extraction import extract_main_text, main_text
from kolophon.llm.language_id import fit, identify_language, viterbi
from kolophon.llm.mixing import flight, mix_sources
from kolophon.llm.packing import best_fit_packing, pack
from kolophon.llm.sharding import propagate, shard_documents
from kolophon.runtime import Scratch

SYLLABLES = {"aa": ["ka", "mo", "ti", "sel", "un"], "bb": ["sch", "ein", "ung", "keit", "ver"], "cc": ["пр", "иве", "ток", "да"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(speak(rng, lang, 40), lang) for lang in SYLLABLES for _ in range(30)]
    return fit(spark.createDataFrame([*rows, (None, "aa"), ("x", None)], "text string, lang string"))


def test_language_of_held_out_texts(spark, model):
    rng = random.Random(2)
    rows = [(i, speak(rng, lang, 12), lang) for i, lang in enumerate(list(SYLLABLES) * 20)]
    got = identify_language(spark.createDataFrame(rows, "doc_id long, text string, score string"), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "spans"]
    want = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] and r.score > 0.9 for r in got.collect())


def test_language_spans_and_edges(spark, model):
    rng = random.Random(3)
    mixed = f"{speak(rng, 'aa', 10)}. {speak(rng, 'bb', 30)}, {speak(rng, 'cc', 5)}"
    rows = [(1, mixed), (2, None), (3, "12 !?"), (4, "½ ² Ⅷ"), (5, "漢字漢字")]
    got = {r.doc_id: r for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [(s.lang, s.words) for s in got[1].spans] == [("aa", 10), ("bb", 30), ("cc", 5)] and got[1].lang_pred == "bb"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4))
    assert got[5].lang_pred in SYLLABLES and got[5].score == 0
    assert identify_language(spark.createDataFrame([], "text string"), model).count() == 0
    long = f"{speak(rng, 'aa', 60_000)} {speak(rng, 'bb', 50)}"
    rows = [(1, long), (1, long), (2, "हिन्दी"), (3, "e\u0301te\u0301")]
    got = identify_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [(s.lang, s.words) for s in got[0].spans] == [("aa", 60_000), ("bb", 50)] and got[0] == got[1]
    assert [sum(s.words for s in r.spans) for r in got[2:]] == [1, 1]


def test_language_stage_keeps_balanced_texts(spark):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, speak(rng, lang, 40), lang) for i, lang in enumerate(list(SYLLABLES) * 30)]
    # Most letters in long words of one language, most words of another.
    few = lambda: " ".join("".join(rng.choice(SYLLABLES["bb"]) for _ in range(4)) for _ in range(15))
    many = lambda: " ".join("".join(rng.choice(SYLLABLES["aa"]) for _ in range(2)) for _ in range(30))
    rows += [(1000 + i, f"{few()}. {many()}" if i % 2 else f"{many()}. {few()}", None) for i in range(6)]
    rows += [(2000, "漢字漢字", None), (2001, "12 !?", None), (2002, None, None)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert kept.columns == ["doc_id", "text", "lang"]
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows if i < 2000}


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 5, 1, 5])
    e = rng.normal(size=(counts.sum(), 3)).astype(np.float32) * 2
    got, at = viterbi(e, counts, 1.0), 0
    for n in counts:
        if n:
            score = lambda p: sum(e[at + i, s] for i, s in enumerate(p)) - sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            best = max(product(range(3), repeat=int(n)), key=score)
            assert abs(score(best) - score(got[at : at + n])) < 1e-4
        at += n


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)) if rng.random() > 0.02 else None, rng.choice(["a", "b", "b", "b", "ç", None])) for i in range(600)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix_sources(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    off = {s: round(taken[s] - want[s], 3) for s in sizes}
    assert max(map(abs, off.values())) <= 59 / 2, off  # half of the largest document
    again = mix_sources(df.repartition(5)).collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in got) == Counter((r.doc_id, r.source, r.taken) for r in again)
    assert mix_sources(df.where("false")).count() == 0
    assert mix_sources(df.where("doc_id = 0")).count() == 2


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    s, p = rng.integers(1, 500, 400), np.full(400, 0.37)
    x = flight(s, p, rng, 4)
    assert abs(x.sum() - p.sum()) < 1e-6 and abs(x @ s - p @ s) < 1e-4 and ((x > 0) & (x < 1)).sum() <= 4


def test_sharding(spark, docs, corpus):
    rng = random.Random(6)
    rows = [*corpus, *[(1000 + i, "copy of one text " * 9) for i in range(400)], *[(2000 + i, "y" * rng.randrange(300)) for i in range(700)], (None, "z"), (7, "again")]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert set(load) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    biggest = max(len((t or "").encode()) for _, t in rows)
    assert max(load.values()) - min(load.values()) <= biggest
    # A group larger than a shard's share fills few shards, not all alike.
    at = Counter(r.shard for r in got if r.doc_id and 1000 <= r.doc_id < 1400)
    assert sorted(at.values())[-3:][0] > 0 and sum(sorted(at.values())[-4:]) > 300
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert shard_documents(docs.where("false")).count() == 0


def test_propagation_joins_every_link(spark):
    rng = random.Random(8)
    rows = [(f"text {g} " * 5, s) for g in range(60) for s in range(rng.randrange(2, 12))]
    scratch = Scratch(spark, "test")
    nodes = scratch.save(spark.createDataFrame([(i, 50) for i in range(len(rows))], "id long, size long"))
    members = scratch.save(spark.createDataFrame([(i, hash(t)) for i, (t, _) in enumerate(rows)], "id long, link long"))
    at = {r.id: r.shard for r in propagate(nodes, members, 1e9, scratch).collect()}
    by = defaultdict(set)
    for i, (t, _) in enumerate(rows):
        by[t].add(at[i])
    assert all(len(v) == 1 for v in by.values()) and len(set(at.values())) == 8
    # No more than what a shard may hold moves there, or stays beyond it by more than a draw.
    tight = len(rows) * 50 / 8 * 1.02
    load = Counter()
    for r in propagate(nodes, members, tight, scratch).collect():
        load[r.shard] += r.size
    assert max(load.values()) < 1.35 * tight and sum(load.values()) == 50 * len(rows)


def test_sharding_keeps_equal_texts_together(spark):
    rng = random.Random(10)
    rows = [f"{g} " * rng.randrange(20, 60) for g in range(80) for _ in range(5)] + [f"single {i} " * rng.randrange(40) for i in range(600)] + [f"s {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumns({"shard": F.lit("clash"), "t": F.lit(1), "id": F.lit("c")})
    got = shard_documents(df).collect()
    by = defaultdict(set)
    for r in got:
        by[rows[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for v in by.values()) <= 8  # one for each shard that is too full
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 400
    again = shard_documents(df).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_sharding_of_a_very_long_text(spark):
    rows = [(1, "long " * 200_000)] + [(i, f"short {i}") for i in range(2, 100)] + [(None, "short 5")]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    alone = next(r for r in got if r.doc_id == 1)
    assert len(got) == 100 and len([r for r in got if r.shard == alone.shard]) <= 2


def test_fingerprints(spark, docs, corpus):
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    order = sorted(corpus, reverse=True)
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = t or "", nxt or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited == 1 or r.edited_fingerprint != r.fingerprint)
    by = defaultdict(set)
    for i, t in corpus:
        by[t or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
    assert fingerprint_documents(docs.where("false")).count() == 0


def test_fingerprint_is_homomorphic_and_native(spark):
    rows = [(1, "b b b\na a a"), (2, "a a a\nb b b"), (3, "a a a\nb b b\nc"), (None, "a a a\nb b b"), (2, "other")]
    df = fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, r.n_chars, r.fingerprint) for r in df.collect()]
    prints = {f for i, n, f in got if n == 11}
    assert len(got) == 5 and len(prints) == 1 and {f for i, _, f in got if i == 3} != prints

    def numbers(text):
        r = fingerprint_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().fingerprint
        return [int(r[i : i + 8], 16) for i in range(0, len(r), 8)]

    both = [(a + b) % 2**32 for a, b in zip(numbers("a b c d"), numbers("x y"), strict=True)]
    assert both == numbers("a b c d\nx y")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_likeness_estimates_the_cosine(spark):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 900))]
        rows.append((2 * i + 1, " ".join(base)))
        share = rng.random()
        rows.append((2 * i, "\n".join(" ".join(w if rng.random() < share else f"x{rng.randrange(3000)}" for w in base[j : j + 50]) for j in range(0, len(base), 50))))
    rows.append((100, "many " * 70_000))  # more than a byte, or 16 bits, count
    rows.append((101, "many " * 70_000 + "more"))

    def features(t):
        return Counter(" ".join(w[i : i + 3]) for line in t.split("\n") for w in [line.split(" ")] for i in range(len(w)))

    def cosine(a, b):
        dot = lambda x, y: sum(v * y[k] for k, v in x.items())
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    got = {r.doc_id: r.near_next for r in fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = {i: features(t) for i, t in rows}
    off = [got[2 * i + 1] - cosine(of[2 * i + 1], of[2 * i]) for i in range(40)]
    assert max(map(abs, off)) < 4 / 16 and np.mean(np.abs(off)) < 1 / 16
    assert got[101] > 0.999


def test_fingerprints_across_blocks(spark, monkeypatch):
    from kolophon.llm import fingerprints

    monkeypatch.setattr(fingerprints, "BLOCK", 10)
    rows = [(i * 7, f"text {i} " * (i % 5 + 1)) for i in range(200)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    order = rows[::-1]
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        h = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()


def test_packing(docs, corpus):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in corpus}
    by, bins = defaultdict(list), defaultdict(list)
    for r in best_fit_packing(docs).collect():
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, rows in by.items():
        at = 0
        for n, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            own = ids[i][at : at + r.length]
            assert (r.piece, r.start) == (n, at) and (n == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += r.length
        assert at == len(ids[i])
    for rows in bins.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 1024
    assert set(by) == set(ids) and len(bins) <= -(-sum(map(len, ids.values())) // 1024) + 1
    assert best_fit_packing(docs.where("false")).count() == 0


def test_packing_chunks_meet_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 5)
    df = spark.createDataFrame([(i, "word " * 30) for i in range(60)], "doc_id long, text string")
    assert best_fit_packing(df).select("sequence_id").distinct().count() <= 4


def test_encoder_agrees_with_tokenizer():
    e = packing.Encoder()
    rng = random.Random(9)
    parts = [" ", "  ", "\n", "\t", "don't", "'s", "é", "ñu.", "12,5", "\xa0", "。", "a" * 80, "word", "Word!", "<|endoftext|>", "..."]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert e.encode(text) == e.direct(text), text


def test_encoder_agrees_with_tokenizer_on_white_space():
    from itertools import product

    e = packing.Encoder()
    for size in range(6):
        for s in product(" \n\xa0\u3000\x85a7.é", repeat=size):
            text = "".join(s)
            assert e.encode(text) == e.direct(text), repr(text)
    for text in ("a \xa0 \xa0 b", "word \xa0 \xa0", " \x1c \u2028 x  ½ y", "\u0966\u0967 हिन्दी. x", " "):
        assert e.encode(text) == e.direct(text), repr(text)


def test_pack_follows_the_rule():
    rng = np.random.default_rng(7)
    for capacity in (10, 37):
        sizes = np.sort(rng.integers(1, capacity, 300))[::-1]
        want, gaps = [], []  # gaps of bins, in the order of opening; the last change decides among equal gaps
        order: list[int] = []
        for s in sizes.tolist():

            def squares(gap, size=s):
                now = Counter(g for g in gaps if g)
                now[gap] -= 1
                if gap > size:
                    now[gap - size] += 1
                return sum(v * v for v in now.values())

            room = sorted({g for g in gaps if g >= s})
            if room:
                gap = min(room, key=lambda g: (squares(g), g))
                b = next(x for x in reversed(order) if gaps[x] == gap)
                order.remove(b)
            else:
                b = len(gaps)
                gaps.append(capacity)
            want.append((b, capacity - gaps[b]))
            gaps[b] -= s
            order.append(b)
        assert list(zip(*(x.tolist() for x in pack(sizes, capacity)), strict=True)) == want


def test_packing_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, "w " * 1500)]
    got = best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.piece) for r in got)[1, 0] == 2 and len(got) == 6 and sum(r.length for r in got if r.doc_id == 2) == 2 + len(packing.Encoder().encode("w " * 1500)) // 4 - 1
    places = [(r.sequence_id, r.offset) for r in got]
    assert len(set(places)) == len(places)


def test_sum_of_squares_fills(spark):
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 700, 3000))[::-1]
    bins, offsets = pack(sizes, 1024)
    load = np.bincount(bins, weights=sizes)
    assert load.max() <= 1024 and len(load) <= 1.01 * sizes.sum() / 1024 + 1
    for b in range(50):
        own = sorted(zip(offsets[bins == b], sizes[bins == b], strict=True))
        assert [o for o, _ in own] == list(np.cumsum([0, *(s for _, s in own)])[:-1])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="comments-open"><header><h1>Site</h1></header><div id="nav-main"><a href=x>Home</a> <a href=y>News</a></div>
<div class="cookie-notice"><p>We use cookies, as everyone does. Agree?</p></div>
<div class="wrap"><div class="post"><h2>Title  here</h2><p>First para, with a <a href=q>link</a> in&nbsp;it. And &lt;on&gt; it goes &amp; on.
<p>Short.</p><div class="ad-box">Buy now, it is cheap!</div><ul><li>one thing<li>two things</ul><form>name <input></form>
<p>Last para of the text, really; it is the end.</p><!-- <p>no</p> --></div>
<aside><p>Side text that is long, and has some. Punctuation, too.</p></aside>
<section id="comments"><p>I liked this, thanks. A lot, really!</p></section></div><footer>bye</footer></body></html>"""


def test_html(spark):
    want = "Title here\nFirst para, with a link in it. And <on> it goes & on.\nShort.\none thing\ntwo things\nLast para of the text, really; it is the end."
    assert main_text(PAGE) == want
    article = "<nav><ul><li><a>x</a></li></ul></nav><article><h1>H</h1><p><b>Some text, here.<br><p>More.</p></article><footer>f"
    assert main_text(article) == "H\nSome text, here.\nMore."
    df = spark.createDataFrame([(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (2, None, None, "c"), (None, "v", "", "c"), (3, "w", "<nav>x</nav>", "c")], "page_id long, url string, html string, text string")
    got = extract_main_text(df).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, want, len(want))] * 2 + [(2, "", 0), (None, "", 0), (3, "", 0)]
    assert extract_main_text(df.where("false")).count() == 0


def test_html_of_wrappers():
    text = "<h2>Head</h2><p>First para, which is long; it has marks, too.</p><p>Second para. It ends here, as it must.</p>"
    want = "Head\nFirst para, which is long; it has marks, too.\nSecond para. It ends here, as it must."
    side = '<div class="sidebar"><p>Side text, not of it.</p></div>'
    for tag, end in (('div class="content has-sidebar"', "div"), ('div id="page" class="no-comments"', "div"), ('div class="search-results"', "div"), ('section class="discussion"', "section"), ('form id="aspnetForm"', "form")):
        for inside in (text, f"<article>{text}</article>"):
            assert main_text(f"<body><nav>menu</nav><{tag}>{inside}{side}</{end}><footer>bye</footer></body>") == want, (tag, inside)
    # Many comments are no article, in a wrapper or not.
    comments = f'<section id="comments">{"<p>I liked this, thanks. A lot, really!</p>" * 20}</section>'
    for inside in (text, f"<article>{text}</article>"):
        assert main_text(f"<body><div>{inside}</div>{comments}</body>") == want
        assert main_text(f'<body><div class="has-sidebar"><div>{inside}</div>{comments}</div></body>') == want


PARAS = [f"Paragraph {i} of the text, which is long; it has marks, and more of them. It ends here, as it must." for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in PARAS)
#: Pages without help from an article tag, and their text.
PAGES = [
    (f'<body><nav>a b</nav><div class="post-popular"><h1>Head</h1>{BODY}</div><footer>bye</footer></body>', ["Head", *PARAS]),
    (f'<body><div id="search-results">{BODY}</div><div class="links"><a href=x>One</a> <a href=y>Two</a></div></body>', PARAS),
    (f'<body><div><div>Home</div><div>News</div><div>About</div></div><div><h1>Head</h1>{BODY}</div><div><div>Imprint</div><div>Contact</div></div></body>', ["Head", *PARAS]),
    # More text in short entries than in the article.
    ("<body><div>" + "".join(f"<div>Topic number {i}</div>" for i in range(90)) + f"</div><div>{BODY}</div></body>", PARAS),
    # A section that is as rich as the rest belongs to it, one that is not does not.
    (f'<body><article>{BODY}<section class="discussion"><h2>Discussion</h2><p>{PARAS[0]}</p></section></article></body>', [*PARAS, "Discussion", PARAS[0]]),
    (f'<body><article>{BODY}<div class="notice">Note this</div><div class="legal">All rights</div></article></body>', PARAS),
    (f'<body><article>{BODY}<div class="ad">{PARAS[0]}</div></article></body>', PARAS),
    (f'<body><article data-hidden="false" data-class="ad" title="hidden id=comments">{BODY}</article></body>', PARAS),
    (f'<body><article>{BODY}<p>Some <span class="ad">ad <span>in</span> it</span> text, <span class="search-term">found</span> here.</p></article></body>', [*PARAS, "Some text, found here."]),
]


def test_html_pages_by_hand():
    for page, want in PAGES:
        assert main_text(page) == "\n".join(want), page


def test_html_rests_on_path_scores(monkeypatch):
    monkeypatch.setattr(html_extraction, "path_scores", lambda length, marks: np.ones(len(length)))
    assert sum(main_text(page) != "\n".join(want) for page, want in PAGES) >= 2


def test_html_of_a_very_long_page(spark):
    page = f"<body><article>{BODY * 3000}</article><footer>x</footer></body>"
    got = extract_main_text(spark.createDataFrame([(1, None, page), (1, None, page)], "page_id long, url string, html string")).collect()
    assert got[0] == got[1] and got[0].text == "\n".join(PARAS * 3000) and got[0].url is None


def test_html_keeps_reference_lists():
    refs = "<ol>" + "".join(f"<li><a href=x>Reference number {i}</a></li>" for i in range(4)) + "</ol>"
    page = f"<body><article><p>Some text, here. It is long enough, and more so.</p>{refs}</article></body>"
    assert main_text(page) == "Some text, here. It is long enough, and more so.\n" + "\n".join(f"Reference number {i}" for i in range(4))


def test_html_of_test_pages(spark, sf_dir):
    import html
    import re

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1])
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", inner))
        assert main_text(r.html) == "\n".join(x for x in blocks if x)
