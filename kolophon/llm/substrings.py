"""Removal of repeated passages by difference-cover anchors.

A window is so many consecutive words of one document. Not every window is hashed: only
shorter anchors are, at positions whose remainder modulo a period is in a difference cover.
Any two equal windows share an anchor at one offset that is a cover position in both, so
a window that repeats holds an anchor that repeats. Those anchors are then extended: each
window that holds one is hashed in full, with 128 bits, and is a repeat unless it is the
first of its kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolophon.llm import repeats
from kolophon.llm.kernels import Words, signed, slices
from kolophon.runtime import Scratch

#: Words in a window.
WINDOW = 20
#: A perfect difference cover: every remainder modulo PERIOD is a difference of two of COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Stands for all positions of a document that repeats another as a whole.
WHOLE = -1

_SIG = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def _whole(w: Words, which: int) -> np.ndarray:
    """A hash of all words of each text."""
    count = w.counts()
    some = count > 0
    out = np.zeros(len(count), np.int64)
    out[some] = signed(w.windows(0, len(w.hashes), w.bounds[:-1][some], count[some], which))
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = Words(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in (w.counts(), _whole(w, 1), _whole(w, 2)))], schema=_SIG)


def _rows(w: Words, texts: np.ndarray, at: list[np.ndarray], docs: np.ndarray, sig: np.ndarray, length: int, wide: bool) -> repeats.Part:
    """Hashes of the windows at words ``at[i]`` of text ``texts[i]``."""
    sizes = np.array([len(x) for x in at], np.int64)
    pos = np.concatenate(at) if at else np.empty(0, np.int64)
    absolute = pos + np.repeat(w.bounds[:-1][texts], sizes)
    k = signed(w.windows(0, len(w.hashes), absolute, length, 1))
    k2 = signed(w.windows(0, len(w.hashes), absolute, length, 2)) if wide else np.zeros(len(k), np.int64)
    return k, k2, np.repeat(docs[texts], sizes), pos, np.repeat(sig[texts], sizes)


def _mark(sig: np.ndarray, unique: bool) -> np.ndarray:
    """What tells the texts of one doc_id apart: nothing has to where each has one text."""
    return np.zeros_like(sig) if unique else sig


def _anchors(batches: Iterator[pa.RecordBatch], window: int, unique: bool) -> Iterator[pa.RecordBatch]:
    width = window - PERIOD + 1
    cover = np.array(COVER, np.int64)
    parts, held = [], 0
    for batch in slices(batches):
        w = Words(batch.column("text"))
        docs, want = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "s1"))
        sig = _whole(w, 1)
        texts = np.flatnonzero(sig == want)
        at = []
        for n in w.counts()[texts].tolist():
            pos = (np.arange(0, n - width + 1, PERIOD)[:, None] + cover).ravel()
            at.append(pos[pos <= n - width])
        parts.append(_rows(w, texts, at, docs, _mark(sig, unique), width, False))
        held += len(parts[-1][0])
        if held >= repeats.FLUSH:
            yield from repeats.flush(parts)
            parts, held = [], 0
    yield from repeats.flush(parts)


def _windows(batches: Iterator[pa.RecordBatch], window: int, unique: bool) -> Iterator[pa.RecordBatch]:
    """All windows that hold a repeated anchor."""
    reach = PERIOD - 1
    parts, held = [], 0
    for batch in slices(batches):
        w = Words(batch.column("text"))
        docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
        sig = _mark(_whole(w, 1), unique)
        count = w.counts()
        texts, at = [], []
        for i, found in enumerate(batch.column("found")):
            own = _own(found, sig[i])
            if len(own):
                last = int(count[i]) - window
                change = np.zeros(last + reach + 2, np.int32)
                np.add.at(change, np.minimum(np.maximum(own - reach, 0), last + 1), 1)
                np.add.at(change, np.minimum(own, last) + 1, -1)
                texts.append(i)
                at.append(np.flatnonzero(np.cumsum(change[: last + 1]) > 0))
        parts.append(_rows(w, np.array(texts, np.int64), at, docs, sig, window, True))
        held += len(parts[-1][0])
        if held >= repeats.FLUSH:
            yield from repeats.flush(parts)
            parts, held = [], 0
    yield from repeats.flush(parts)


def _own(found: pa.ListScalar, sig: int) -> np.ndarray:
    """The positions that were found for a text with this mark; a repeated doc_id may have others."""
    if not found.is_valid:
        return np.empty(0, np.int64)
    n, pos = (found.values.field(i).to_numpy() for i in (0, 1))
    return pos[n == sig]


def _remove(batches: Iterator[pa.RecordBatch], window: int, unique: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kept, total, removed = [], [], []
        flagged = [x if x.is_valid else None for x in batch.column("found")]
        if any(flagged):
            sig = np.zeros(len(flagged), np.int64) if unique else _whole(Words(batch.column("text")), 1)
        for i, (text, found) in enumerate(zip(batch.column("text"), flagged, strict=True)):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            n, gone = len(words), 0
            pos = _own(found, sig[i]) if found is not None else ()
            if len(pos):
                if pos.min() == WHOLE:
                    words, gone = [], n
                else:
                    change = np.zeros(n + 1, np.int32)
                    np.add.at(change, pos, 1)
                    np.add.at(change, pos + window, -1)
                    keep = np.cumsum(change[:n]) == 0
                    words, gone = list(compress(words, keep.tolist())), n - int(keep.sum())
            kept.append(b" ".join(words))
            total.append(n)
            removed.append(gone)
        out = [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(out, schema=_OUT)


def _per_document(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("n", "pos")).alias("found"))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word that a repeated window covers.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored. A window is
    ``window`` (at least PERIOD) consecutive words, runs of characters other than space and
    ``\\t\\n\\v\\f\\r``. It is a repeat if the same words also start earlier: in a document
    with a smaller doc_id, or earlier in the same. Windows are judged on the input.

    Returns a row per row of ``docs``: doc_id, kept_text (the kept words joined by one
    space), n_words, n_removed. A null or blank text has no words. Rows with a null doc_id
    have no place in the order and keep all. Rows that repeat a doc_id are at the same
    place: they are no repeats of each other where they start at the same word, so a row
    that is there twice is treated as once. An empty table gives an empty result.
    """
    if window < PERIOD:
        raise ValueError(f"a window must have at least {PERIOD} words")
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.save(docs.mapInArrow(_signatures, "doc_id long, n_words long, s1 long, s2 long"), "signatures")
    total, distinct = sig.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    unique = total == distinct
    long = sig.where(F.col("n_words") >= window).dropna(subset=["doc_id"])

    # Copies of a whole document are repeats throughout; the first stands for them.
    # Written first, so that both sides of the join are plain shuffles and a hot key's can be split.
    first = scratch.save(long.groupBy("n_words", "s1", "s2").agg(F.min("doc_id").alias("first")), "first")
    known = scratch.save(long.join(first, ["n_words", "s1", "s2"]), "copies")
    copies = known.where("doc_id > first").select(F.col("doc_id").alias("doc"), (F.lit(0).cast("long") if unique else F.col("s1")).alias("n"), F.lit(WHOLE).cast("long").alias("pos")).distinct()
    todo = known.where("doc_id = first").select("doc_id", "s1").distinct()

    anchors = docs.join(todo, "doc_id").mapInArrow(lambda it: _anchors(it, window, unique), repeats.COLUMNS)
    found = scratch.save(_per_document(repeats.repeated(anchors, firsts_too=True)), "anchors")
    wide = docs.join(found, "doc_id").mapInArrow(lambda it: _windows(it, window, unique), repeats.COLUMNS)
    later = repeats.repeated(wide, firsts_too=False).select("doc", "n", "pos")
    flagged = scratch.save(_per_document(later.unionByName(copies)), "flagged")
    return docs.join(flagged, "doc_id", "left").mapInArrow(lambda it: _remove(it, window, unique), "doc_id long, kept_text string, n_words long, n_removed long")
