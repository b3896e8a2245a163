"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches of descending doc_id. A run holds, sorted by a line's hash, in how
many documents of its batch the line is, and, for lines that no older run holds, the largest
document with it. Each new batch is merge-anti-joined with the runs to learn which of its
lines are new, and adds its own run; so many runs of one level are compacted into one of
the next. A line that ends up in enough documents is kept in its largest document alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolophon.llm.kernels import slices
from kolophon.runtime import Scratch

#: Least length of a key in code points, and of documents with it.
MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of a whole table, and runs of one level that are compacted.
BATCHES, FANOUT = 6, 3

#: Columns that `line_dedup` adds.
ADDED = ("kept_text", "n_lines", "n_dropped")

_KEYS = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A 128-bit hash of the line's key, or None if the key is too short. Both methods are about ASCII alone."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _lines(text: pa.StringScalar) -> list[bytes]:
    return (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")


def _keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        docs, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            found = {line_key(x, min_chars) for x in _lines(text)} - {None}
            docs += [doc] * len(found)
            keys += found
        k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], schema=_KEYS)


def _drop(batches: Iterator[pa.RecordBatch], text_column: str, min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text_column):
        kept, total, dropped = [], [], []
        for text, found in zip(batch.column(text_column), batch.column("_found"), strict=True):
            lines = _lines(text)
            stay = lines
            if found.is_valid:
                k = np.stack([found.values.field(i).to_numpy() for i in (0, 1)], axis=1)
                gone = {row.tobytes() for row in k}
                stay = [x for x in lines if line_key(x, min_chars) not in gone]
            kept.append(b"\n".join(stay))
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
        new = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
        rest = [c for c in batch.schema.names if c != "_found"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *new], names=[*rest, *ADDED])


class LineRuns:
    """The levelled runs: tables (k1, k2, docs, top), each sorted by its keys."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.scratch, self.fanout = Scratch(spark, "line_runs"), fanout
        self.levels: list[list[DataFrame]] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        return self.scratch.save(rows.sortWithinPartitions("k1", "k2"), "run")

    def add(self, keys: DataFrame) -> None:
        """Add a batch of ``keys(doc_id, k1, k2)``, of documents that no batch before had.

        Its doc_ids must be less than those before it.
        """
        own = keys.distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top"))
        held = self.all()
        if held is not None:
            # What is new is known by a merge anti-join; the rest keeps its place in an older run.
            own = self.scratch.save(own, "batch")
            new = own.join(held.select("k1", "k2"), ["k1", "k2"], "left_anti")
            old = own.join(held.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "docs", F.lit(None).cast("long").alias("top"))
            own = new.unionByName(old)
        self._push(0, self._run(own))

    def _push(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self._run(self._merged(runs))
            self.scratch.drop(*runs)
            self._push(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy("k1", "k2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def all(self) -> DataFrame | None:
        """All keys of all runs; a key may be in several."""
        out = None
        for run in (r for level in self.levels for r in level):
            out = run if out is None else out.unionByName(run)
        return out

    def repeated(self, min_docs: int) -> DataFrame | None:
        """Keys in at least ``min_docs`` documents, with the largest."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs).where(F.col("docs") >= min_docs).select("k1", "k2", "top") if runs else None


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Drop lines that many documents have, except in the largest of these.

    ``docs`` has ``doc_id`` (long) and ``text``. A text is cut at
    each ``\\n``; a null or empty one is one empty line. A line's key is the line without
    space and ``\\t\\n\\v\\f\\r`` at its ends, lower-cased in A-Z. A key of at least ``min_chars`` code
    points in at least ``min_docs`` documents loses all its lines but those in the largest
    doc_id with it. The others stay, joined by ``\\n``.

    Returns ``docs`` with kept_text, n_lines (before) and n_dropped; columns that had these
    names are replaced, and others stay. Rows that repeat a doc_id are one document. A null doc_id is not counted as a document and
    keeps all lines. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line_dedup")
    docs = docs.select(*[docs[c] for c in docs.columns if c.lower() not in (*ADDED, "_found")])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = scratch.save(plain.where("doc_id IS NOT NULL").mapInArrow(lambda it: _keys(it, min_chars), "doc_id long, k1 long, k2 long"), "keys")
    # Bounds of the batches; where they lie changes no result.
    cuts = sorted(set(keys.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)), reverse=True) if batches > 1 else []
    runs = LineRuns(spark)
    for low, high in zip([*cuts, None], [None, *cuts], strict=True):
        own = keys
        own = own.where(F.col("doc_id") >= low) if low is not None else own
        own = own.where(F.col("doc_id") < high) if high is not None else own
        runs.add(own)
    # Written first, so that both sides of the join are plain shuffles and a hot key's can be split.
    repeated = scratch.save(runs.repeated(min_docs), "repeated")
    gone = keys.join(repeated.hint("merge"), ["k1", "k2"]).where(F.col("doc_id") != F.col("top"))
    found = scratch.save(gone.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("_found")), "found")
    text_column = next(c for c in docs.columns if c.lower() == "text")
    out = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    found = found.withColumnRenamed("doc_id", "_found_id")
    # Never broadcast: what is found grows with the corpus.
    joined = docs.join(found.hint("merge"), docs["doc_id"] == found["_found_id"], "left").drop("_found_id")
    return joined.mapInArrow(lambda it: _drop(it, text_column, min_chars), out)
