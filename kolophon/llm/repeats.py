"""Find keys that occur more than once, without bringing a frequent key's rows together.

A mapper sorts what it has gathered. Of the rows with one key it sends a single one to the
key's place; the others are known to be repeats already and are spread by another hash.
So a key that a third of all rows share reaches its task at most once for every flush.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kolophon.llm.kernels import mix, signed

#: Rows that a mapper gathers before it sorts and sends them.
FLUSH = 1_500_000

COLUMNS = "part long, role int, k long, k2 long, doc long, pos long, n long"
_SCHEMA = pa.schema([("part", pa.int64()), ("role", pa.int32()), *((c, pa.int64()) for c in ("k", "k2", "doc", "pos", "n"))])
#: role: ONE row for the key so far; FIRST of several; REST, known to be a repeat.
ONE, FIRST, REST = 0, 1, 2

Part = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def flush(parts: list[Part]) -> Iterator[pa.RecordBatch]:
    """Sort gathered rows by key, document and position, and give each its role."""
    if not parts:
        return
    k, k2, doc, pos, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((n, pos, doc, k2, k))
    k, k2, doc, pos, n = (x[order] for x in (k, k2, doc, pos, n))
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
    again = ~new  # the very same row
    again[1:] &= (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1]) & (n[1:] == n[:-1])
    if again.any():
        k, k2, doc, pos, n, new = (x[~again] for x in (k, k2, doc, pos, n, new))
    at = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    several = np.diff(np.append(at, len(k)))[run] > 1
    head = (doc == doc[at][run]) & (pos == pos[at][run])  # the first row, and any at its place
    role = np.where(head, np.where(several, FIRST, ONE), REST).astype(np.int32)
    spread = signed(mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64)))
    part = np.where(role == REST, spread, k)
    for i in range(0, len(k), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (part, role, k, k2, doc, pos, n)], schema=_SCHEMA)


def _decide(cand: pa.Table, firsts_too: bool) -> pa.Table:
    """Of whole runs of candidates, the rows to put out."""
    k, k2, role = (cand.column(i).to_numpy() for i in (2, 3, 1))
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
    run = np.cumsum(new) - 1
    if not firsts_too:
        at = np.flatnonzero(new)[run]
        doc, pos = cand.column(4).to_numpy(), cand.column(5).to_numpy()
        return cand.filter(pa.array((doc != doc[at]) | (pos != pos[at])))
    doc, pos, n = (cand.column(i).to_numpy() for i in (4, 5, 6))
    other = ~new  # a further row of the key, not the same one from another mapper
    other[1:] &= (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]) | (n[1:] != n[:-1])
    several = np.bincount(run, weights=other | (role == FIRST)) > 0
    return cand.filter(pa.array(several[run] & (new | other)))


def _runs(batches: Iterator[pa.RecordBatch], firsts_too: bool) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by part, k, k2, doc, pos. A run has a row for each flush at most, so the last is held."""
    held = pa.Table.from_batches([], _SCHEMA)
    for batch in batches:
        role = batch.column(1).to_numpy()
        yield from pa.Table.from_batches([batch.filter(pa.array(role == REST))]).to_batches()
        cand = pa.concat_tables([held, pa.Table.from_batches([batch.filter(pa.array(role != REST))]).cast(_SCHEMA)])
        if not cand.num_rows:
            continue
        k, k2 = cand.column(2).to_numpy(), cand.column(3).to_numpy()
        changes = np.flatnonzero((k[1:] != k[:-1]) | (k2[1:] != k2[:-1]))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut:
            yield from _decide(cand.slice(0, cut), firsts_too).to_batches()
        held = cand.slice(cut)
    if held.num_rows:
        yield from _decide(held, firsts_too).to_batches()


def repeated(rows: DataFrame, firsts_too: bool) -> DataFrame:
    """Rows of keys with several rows; without their least (doc, pos) unless ``firsts_too``.

    ``rows`` has COLUMNS, as `flush` makes them.
    """
    fn: Callable = lambda it: _runs(it, firsts_too)
    return rows.repartition("part").sortWithinPartitions("part", "k", "k2", "doc", "pos").mapInArrow(fn, COLUMNS)
