"""Language identification of whole texts, and of the spans of mixed ones.

A word's script, told by code point ranges, narrows the languages it may be in. Each word
gets a score for each of these from character n-grams. Viterbi decoding over the words,
with a penalty for a switch of language, labels spans; a text's language is the one that
labels most of its letters.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolophon.llm.kernels import slices

UNKNOWN = "und"
#: About so many labelled rows are drawn, by a hash of their text, to fit the n-grams.
FIT_ROWS = 12_000
#: So many n-grams are kept: those counted most often.
VOCABULARY = 60_000
#: Lengths of n-grams; a word is bounded by one blank on each side.
ORDERS = (2, 3)
#: Added to each n-gram's count.
SMOOTH = 0.5
#: What a switch of language costs, and the most by which one word favours a language.
SWITCH, CLIP = 8.0, 6.0
#: A language uses a script if that has this share of its letters.
SCRIPT_SHARE = 0.005
#: Words whose scores a worker remembers.
CACHE = 600_000

# First code points of Unicode script ranges.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
]
_FIRST = [x for x, _ in SCRIPTS]
#: Letters, and the marks that belong to them.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_FIRST, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams and, under a key that is no n-gram, of letters by script."""
    words: dict[str, Counter] = defaultdict(Counter)
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words[lang].update(_WORD.findall(text.lower()))
    for lang, found in words.items():
        total: Counter = Counter()
        for w, n in found.items():
            for g in grams(w):
                total[g] += n
            total["\n" + script(w)] += n * len(w)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    index: dict[str, int]  # of n-grams
    weights: np.ndarray  # log probabilities by n-gram and language, with a last row for unseen ones
    scripts: dict[str, np.ndarray]  # which languages use it


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on ``labelled(text, lang)``, of which about ``fit_rows`` rows with both are drawn by a hash."""
    rows = labelled.select("text", "lang").dropna()
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_000)) < int(1e6 * fit_rows / n))
    counted = rows.mapInArrow(_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = counted.groupBy("gram").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))
    scripts = by_gram.where("gram LIKE '\n%'").collect()  # one row for a script
    top = by_gram.where("gram NOT LIKE '\n%'").orderBy(F.desc("total"), "gram").limit(VOCABULARY).collect()
    langs = sorted({k for r in scripts for k in r.n})
    table = np.array([[r.n.get(k, 0) for k in langs] for r in top] + [[0] * len(langs)], float).reshape(len(top) + 1, len(langs)) + SMOOTH
    letters = np.array([[r.n.get(k, 0) for k in langs] for r in scripts], float).reshape(len(scripts), len(langs))
    uses = letters >= SCRIPT_SHARE * np.maximum(1, letters.sum(axis=0))
    return Model(langs, {r.gram: i for i, r in enumerate(top)}, np.log(table / table.sum(axis=0)), {r.gram[1:]: u for r, u in zip(scripts, uses, strict=True) if u.any()})


class _Scores(dict):
    """Numbers of words; the scores of new ones are worked out together, by `settle`."""

    def __init__(self, model: Model):
        self.model = model
        self.new: list[str] = []
        self.rows = np.empty((1 << 16, len(model.langs)), np.float32)
        self.lengths = np.empty(1 << 16, np.int32)
        self.known = np.empty(1 << 16, bool)
        self.index = dict(model.index)
        self.weights = model.weights.astype(np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def settle(self) -> None:
        m, new = self.model, self.new
        if not new:
            return
        while len(self.rows) < len(self):
            self.rows, self.lengths, self.known = (np.concatenate([x, np.empty_like(x)]) for x in (self.rows, self.lengths, self.known))
        at = slice(len(self) - len(new), len(self))
        get, unseen = self.index.get, len(m.index)
        found = [[get(g, unseen) for g in grams(w)] for w in new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        score = np.add.reduceat(self.weights[np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))], np.cumsum(sizes) - sizes, axis=0)
        kinds: dict[str, int] = {}
        kind = np.fromiter((kinds.setdefault(script(w), len(kinds)) for w in new), np.int64, len(new))
        none = np.zeros(len(m.langs), bool)
        use = np.array([m.scripts.get(k, none) for k in kinds])[kind]
        top = np.where(use, score, -np.inf).max(axis=1, keepdims=True)
        some = use.any(axis=1)
        score = np.where(use, np.maximum(score - np.where(some[:, None], top, 0), -CLIP), -CLIP)
        self.rows[at] = np.where(some[:, None], score, 0)
        self.lengths[at] = np.fromiter(map(len, new), np.int64, len(new))
        self.known[at] = some
        self.new = []


def viterbi(emissions: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best state of each word. ``emissions``: of the words of one text after another; texts go in step."""
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    size, start = size[size > 0], start[: int((size > 0).sum())]
    n, k = emissions.shape
    kind = np.uint8 if k <= 256 else np.int32
    back = np.empty((n, k), kind)
    path = np.empty(n, kind)
    if not len(size):
        return path
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
    own = np.arange(k, dtype=kind)
    v = emissions[start].copy()
    last = np.empty(len(size), kind)
    for t in range(1, int(size[0])):
        a = active[t]
        if a < len(v):
            last[a : len(v)] = v[a:].argmax(axis=1)
            v = v[:a]
        at = start[:a] + t
        from_ = v.argmax(axis=1).astype(kind)
        best = v[np.arange(a), from_][:, None] - switch
        change = best > v
        back[at] = np.where(change, from_[:, None], own)
        v = np.where(change, best, v) + emissions[at]
    last[: len(v)] = v.argmax(axis=1)
    state = last[:0]
    for t in range(int(size[0]) - 1, -1, -1):
        a = active[t]
        state = np.concatenate([state, last[len(state) : a]])  # texts that end here
        at = start[:a] + t
        path[at] = state
        state = back[at, state] if t else state
    return path


_SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32()), ("letters", pa.int32())])


class _Predictor:
    """Keeps the scores of words from one slice of texts to the next."""

    def __init__(self, model: Model, switch: float, spans: bool):
        self.model, self.switch, self.spans = model, switch, spans
        self.names = np.array(model.langs, object)
        self.scores = _Scores(model)

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        if len(self.scores) > CACHE:
            self.scores = _Scores(self.model)
        k, size = len(self.names), len(texts)
        ids, counts = [], []
        for text in texts.to_pylist():
            words = _WORD.findall(text.lower()) if text else []
            counts.append(len(words))
            ids.append(np.fromiter(map(self.scores.__getitem__, words), np.int64, len(words)))
        n = np.array(counts, np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        if not k or not len(flat):
            return [pa.array([UNKNOWN] * size, pa.string()), pa.array(np.zeros(size)), pa.array([[]] * size, pa.list_(_SPAN)), pa.array(np.zeros(size))]
        doc = np.repeat(np.arange(size), n)
        self.scores.settle()
        e, letters, known = self.scores.rows[flat], self.scores.lengths[flat].astype(float), self.scores.known[flat]
        path = viterbi(e, n, self.switch).astype(np.int64)
        held = np.bincount(doc * k + path, weights=letters * known, minlength=size * k).reshape(-1, k)
        alone = np.stack([np.bincount(doc, weights=e[:, s], minlength=size) for s in range(k)], axis=1)
        total = np.bincount(doc, weights=letters, minlength=size)
        best = np.where(held.max(axis=1) > 0, held.argmax(axis=1), alone.argmax(axis=1))
        share = held[np.arange(size), best] / np.maximum(total, 1)
        # How sure: the chance of this language against the others, had the text only one.
        odds = np.exp(np.clip(alone - alone[np.arange(size), best][:, None], -50, 50)).sum(axis=1)
        label = np.where(n > 0, self.names[best], UNKNOWN)
        score = np.where(n > 0, share / np.maximum(odds, 1), 0.0)
        spans = _spans(path, n, letters, self.names) if self.spans else [[]] * size
        return [pa.array(label.tolist(), pa.string()), pa.array(score), pa.array(spans, pa.list_(_SPAN)), pa.array(held.sum(axis=1) / np.maximum(total, 1))]


def _spans(path: np.ndarray, n: np.ndarray, letters: np.ndarray, names: np.ndarray) -> list[list[dict]]:
    out, at = [], 0
    for size in n.tolist():
        p, w = path[at : at + size], letters[at : at + size]
        cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), size] if size else [0]
        out.append([{"lang": names[p[a]], "first_word": a, "words": b - a, "letters": int(w[a:b].sum())} for a, b in zip(cuts, cuts[1:], strict=False)])
        at += size
    return out


def identify_language(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True, known: bool = False) -> DataFrame:
    """Add lang_pred, score and spans to ``docs``, which has a column ``text``.

    lang_pred is a language of the model; `und`, with score 0, for a text that is null or
    has no letter, or if the model has no language. score, from 0 to 1, is the share of the
    letters that are in spans of that language and in a script that some language uses, times
    the chance of that language as the only one. spans: runs of words (maximal runs of letters)
    labelled alike, with the number of the first word; empty unless ``spans``. With ``known``,
    a column of this name has the share of the letters that are in spans of any language and
    in a script that some language uses. Columns of ``docs`` stay as they are, but for any with
    the names of the new ones, which are replaced. Only
    ``text`` is looked at. Repeated rows are judged alike; an empty table gives an empty result.
    """
    model_ = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY
    names = ["lang_pred", "score", "spans", *["known"] * known]
    keep = [c for c in docs.columns if c.lower() not in names]
    schema = docs.select(*[docs[c] for c in keep]).schema

    text = next(c for c in keep if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _Predictor(model_.value, switch, spans)
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, *predict(part.column(text))[: len(names)]], names=[*part.schema.names, *names])

    span = T.StructType([T.StructField("lang", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("first_word", "words", "letters")]])
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span)), *[T.StructField("known", T.DoubleType())] * known]
    return docs.select(*[docs[c] for c in keep]).mapInArrow(run, T.StructType([*schema.fields, *new]))
