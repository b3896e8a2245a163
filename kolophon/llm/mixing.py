"""Mixing of sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes each document floor(r) times and, with an
inclusion probability, once more. The flight phase moves the vector of these probabilities
along the null space of the constraints, so that the totals of words and of documents keep
their values, until a probability in each step is 0 or 1. Chunks of a source fly apart; what
a chunk leaves undecided, fewer documents than HELD, flies on in the next round. What is left
at the end for a whole source is landed together, nearest to its totals.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolophon.runtime import Scratch, with_global_index

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix, and the most that a source gives, as multiples of sizes.
SHARE, CAP = 1.5, 2.0
#: Documents in a chunk, about, and the most that it leaves undecided.
CHUNK, HELD = 20_000, 14
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, n, source_size, target)`` of ``sizes(source, size)``.

    Sources by code point, null last, get the weights in turn. They share the mix by weight; what
    one would get beyond its cap is shared again by the rest. The level that a unit of weight
    gets rises with each source that is capped, so the rounds end.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = with_global_index(scratch, totals, [F.col("source").asc_nulls_last()])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    table = scratch.save(ranked.select("source", "source_size", "n", w.alias("w")), "sources")
    full = F.col("source_size") * F.lit(float(cap))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        over = F.col("w") * level > full if level else F.lit(False)
        capped, free = table.agg(F.sum(F.when(over, full).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        new = (total - (capped or 0.0)) / free if free else level
        if not new > level:
            break
        level = new
    return table.select("source", "n", "source_size", F.least(full, F.col("w") * level).alias("target"))


def flight(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator, held: int) -> np.ndarray:
    """Move ``p`` until at most ``held`` are undecided; sums of p and of p * size stay."""
    x = p.astype(float).copy()
    todo = np.flatnonzero((x > 0) & (x < 1)).tolist()
    draws = iter(rng.random(len(todo) + 8).tolist())
    s, v = sizes.astype(float).tolist(), x.tolist()
    left = len(todo)
    at = 3
    work = todo[:3]
    while left > max(held, 2) and len(work) == 3:
        i, j, k = work
        # Orthogonal to (1, 1, 1) and to the sizes; with equal sizes any difference will do.
        u = (s[j] - s[k], s[k] - s[i], s[i] - s[j])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - v[a]) / b if b > 0 else -v[a] / b for a, b in zip(work, u, strict=True) if b)
        down = min(v[a] / b if b > 0 else (v[a] - 1) / b for a, b in zip(work, u, strict=True) if b)
        step = up if next(draws) * (up + down) < down else -down
        rest = []
        for a, b in zip(work, u, strict=True):
            y = v[a] + step * b
            if y < 1e-9 or y > 1 - 1e-9:
                v[a] = 0.0 if y < 0.5 else 1.0
                left -= 1
            else:
                v[a] = y
                rest.append(a)
        work = rest + todo[at : at + 3 - len(rest)]
        at += 3 - len(rest)
    return np.array(v)


def land(sizes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Decide the last few: nearest in words, then in documents, then the first by binary count."""
    at = np.flatnonzero((x > 0) & (x < 1))
    if len(at):
        bits = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        words = np.abs(bits @ sizes[at] - x[at] @ sizes[at])
        docs = np.abs(bits.sum(axis=1) - x[at].sum())
        x = x.copy()
        x[at] = bits[np.lexsort((docs, np.round(words, 6)))[0]]
    return x


_COLS = "row long, doc_id long, source string, size long, source_size long, target double, base long, x double, chunks long, r long"


def _fly(key: tuple, table: pa.Table) -> pa.Table:
    source, chunk, last, turn = (k.as_py() for k in key)
    # Small documents come last, so that what is landed is small.
    table = table.sort_by([("big", "descending"), ("r", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
    size, x = table.column("size").to_numpy(), table.column("x").to_numpy()
    seed = [chunk, turn, *(source or "").encode()]
    x = flight(size, x, np.random.default_rng(seed), HELD)
    if last:
        x = land(size, x)
    at = table.schema.get_field_index("x")
    return table.set_column(at, "x", pa.array(x)).drop_columns(["chunk", "last", "turn", "big"])


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, row: str | None = None) -> DataFrame:
    """How many words, repeats counted, the mix takes of each document.

    ``docs`` has ``doc_id`` (long), ``text`` and ``source``; other columns are ignored. A
    document's size is its number of words; a null text has none. Returns a row per row of
    ``docs``: doc_id, source, size, source_size, target (of its source), copies, taken (copies
    times size). ``cap`` bounds copies. A null source is a source. The draws come from hashes
    of a row's values, so reruns agree, also with repeated rows, each of which is drawn for
    itself. ``row`` names a column of longs that tells rows apart; it is returned as well, first and
    as row. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.save(docs.select((F.col(row) if row else F.lit(None)).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")), "sizes")
    targets = scratch.save(source_targets(sizes, scratch, weights, share, cap), "targets")
    t = targets.withColumnRenamed("source", "t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = sizes.join(t, sizes["source"].eqNullSafe(t["t_source"])).select(
        "row", "doc_id", "source", "size", "source_size", "target",
        F.floor(rate).alias("base"),
        (rate - F.floor(rate)).alias("x"),
        F.ceil(F.col("n") / CHUNK).alias("chunks"),
        F.xxhash64("doc_id", "size").alias("r"),
    )
    done, turn = [], 0
    while True:
        flown = (
            state.withColumns({"chunk": F.pmod("r", F.col("chunks")), "last": F.col("chunks") == 1, "turn": F.lit(turn), "big": F.col("size") >= F.col("source_size") / 10_000})
            .groupBy("source", "chunk", "last", "turn")
            .applyInArrow(_fly, _COLS)
        )
        flown = scratch.save(flown, "flown")
        done.append(flown.where("x IN (0.0, 1.0)"))
        state = flown.where("x NOT IN (0.0, 1.0)").withColumn("chunks", F.ceil(F.col("chunks") * HELD / CHUNK))
        turn += 1
        if state.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("base") + F.col("x")).cast("int")
    return out.select(*["row"] * bool(row), "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
