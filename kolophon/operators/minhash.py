"""MinHash signatures and bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolophon.config import MinHash

#: A Mersenne prime; with factors below it no product leaves 62 bits.
PRIME = (1 << 31) - 1


def coefficients(cfg: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """Factors in [1, p) and terms in [0, p), by the configuration's seed."""
    rng = np.random.RandomState(cfg.seed)
    return rng.randint(1, PRIME, cfg.perms).astype(np.int64), rng.randint(0, PRIME, cfg.perms).astype(np.int64)


#: Shingles that a worker looks at together, and those of a text that are taken in one piece.
CACHE, STEP = 1 << 18, 1 << 16


class _Hashes(dict):
    """The hash of each shingle, forgotten when there are many."""

    def __init__(self, cfg: MinHash):
        if cfg.hash == "md5":
            self.of = lambda s: int.from_bytes(hashlib.md5(s.encode()).digest()[:4]) & PRIME
        else:
            import xxhash

            self.of = lambda s: xxhash.xxh64_intdigest(s.encode()) % PRIME

    def __missing__(self, shingle: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[shingle] = h = self.of(shingle)
        return h


def _shingle_ids(pieces: list[str], k: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Numbers of the shingles of all pieces in turn, the shingles themselves, and where each piece's begin."""
    size = np.array([len(p) for p in pieces])
    padded = "".join(p if len(p) >= k else p + "\0" * (k - len(p)) for p in pieces)
    end = np.cumsum(np.maximum(size, k))
    start = end - np.maximum(size, k)
    chars = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.int64)
    for i in np.flatnonzero(size < k):  # what fills up a short text is no character
        chars[start[i] + size[i] : end[i]] = -1
    seen = np.zeros(int(chars.max()) + 2, bool)
    seen[chars + 1] = True
    rank = (np.cumsum(seen) - 1)[chars + 1]
    base, code, most = int(rank.max()) + 1, rank[: len(rank) - k + 1], int(rank.max()) + 1
    for j in range(1, k):
        if most * base >= 1 << 62:
            code, found = pd.factorize(code)
            most = len(found)
        code = code * base + rank[j : len(rank) - k + 1 + j]
        most *= base
    n = np.maximum(size - k + 1, 1)
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(start - first, n)
    ids, found = pd.factorize(code[at])
    where = np.empty(len(found), np.int64)
    where[ids[::-1]] = at[::-1]
    piece = np.searchsorted(end, where, side="right")
    upto = np.minimum(where + k, start[piece] + size[piece])
    return ids, [padded[x:y] for x, y in zip(where.tolist(), upto.tolist(), strict=True)], first


def _signatures(batches: Iterator[pa.RecordBatch], cfg: MinHash) -> Iterator[pa.RecordBatch]:
    a, b = coefficients(cfg)
    hashes = _Hashes(cfg)
    for batch in batches:
        rows = np.full((batch.num_rows, cfg.perms), PRIME, np.int32)
        pieces: list[str] = []
        of: list[int] = []

        def take() -> None:
            if not pieces:
                return
            ids, shingles, first = _shingle_ids(pieces, cfg.k)
            h = np.array([hashes[s] for s in shingles], np.int64)
            slots = np.empty((len(h), cfg.perms), np.int32)
            for i in range(0, len(h), 4096):
                slots[i : i + 4096] = (h[i : i + 4096, None] * a + b) % PRIME
            bounds = [*first.tolist(), len(ids)]
            for i, x, y in zip(of, bounds, bounds[1:], strict=False):
                np.minimum(rows[i], np.minimum.reduce(slots.take(ids[x:y], axis=0), axis=0), out=rows[i])
            pieces.clear()
            of.clear()

        held = 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            for j in range(0, max(1, len(text) - cfg.k + 1), STEP):  # a line is one piece; a whole text may be several
                piece = text[j : j + STEP + cfg.k - 1]
                if held + len(piece) > CACHE:
                    take()
                    held = 0
                pieces.append(piece)
                of.append(i)
                held += len(piece) + cfg.k
        take()
        flat = pa.array(rows.ravel())
        sig = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, cfg.perms), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), sig], names=["line_id", "sig"])


def signatures(lines: DataFrame, cfg: MinHash, text: str = "clean") -> DataFrame:
    """``(line_id, sig)``: slot i is the least (a_i h + b_i) mod p over the hashes of a text's shingles.

    A null text counts as empty, which like any short text is one shingle.
    """
    rows = lines.select("line_id", F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _signatures(it, cfg), f"line_id {lines.schema['line_id'].dataType.simpleString()}, sig array<int>")


def bands(sigs: DataFrame, cfg: MinHash) -> DataFrame:
    """``(line_id, band, key)``: the key of a band is its slice of the signature."""
    slices = F.array(*[F.slice("sig", i * cfg.rows + 1, cfg.rows) for i in range(cfg.bands)])
    return sigs.select("line_id", F.posexplode(slices).alias("band", "key"))


def similarity(a: Column, b: Column, perms: int) -> Column:
    """Share of equal slots."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(perms))
