"""Numpy kernels over Arrow batches: words, word hashes and hashes of word windows.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``. All texts of a batch are
hashed at once from their UTF-8 buffer with prefix sums of polynomials modulo 2**64, so
the cost is a few array passes whatever the lengths; memory follows a fixed block size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once; only a longer single word makes a block larger.
BLOCK = 1 << 20
#: Bytes of text in the slices that `slices` makes of Arrow batches.
SLICE = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = (1 << 64) - 1
#: Numbers of the bytes, twice, as there are two hashes of a word.
_TABLES = np.random.Generator(np.random.PCG64(20_240_501)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
#: Odd bases: of the bytes in a word, and of the words in a window; then both again, for 128 bits.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        base = _BASES[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        have = (both[0], both[1])
        if size <= 4 * BLOCK:
            _powers[which] = have
    return have


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values, out=out[1:])
    return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts: byte spans, 64-bit hashes, and each text's range of words.

    A second hash of each word, from other numbers and another base, is made when first asked for.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.lower = lower
        self.raw, self.offsets = text_buffer(texts)
        raw, offsets = self.raw, self.offsets
        word = ~_SPACE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | first[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        del word, first, starts, ends
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = self._hashed(0)
        self._second: np.ndarray | None = None

    def _hashed(self, which: int) -> np.ndarray:
        raw, table, base = self.raw, _TABLES[which], (0, 3)[which]
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            # A block ends with a word; at least one word is in it.
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + BLOCK, side="right")))
            lo, hi = self.starts[i], self.ends[j - 1]
            block = raw[lo:hi]
            up, down = _pow(base, len(block) + 1)
            sums = _prefix(table[_LOWER[block] if self.lower else block] * up[: len(block)])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_BASES[1]))
            i = j
        return out

    @property
    def second(self) -> np.ndarray:
        if self._second is None:
            self._second = self._hashed(1)
        return self._second

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, lo: int, hi: int, at: np.ndarray, length: np.ndarray | int, which: int = 1) -> np.ndarray:
        """Hashes of the windows of ``length`` words that start at ``at``, all within words ``lo`` to ``hi``.

        ``which``: 1 or 2, of the first or of the second hashes of the words.
        """
        hashes = self.hashes if which == 1 else self.second
        out = np.empty(len(at), np.uint64)
        size = np.broadcast_to(np.asarray(length, np.int64), at.shape)
        i = 0
        while i < len(at):
            base = at[i]
            j = max(i + 1, int(np.searchsorted(at, base + BLOCK)))
            top = int((at[i:j] + size[i:j]).max())
            up, down = _pow(which, top - base + 1)
            seed = np.uint64((_BASES[which] * 31) & _MASK)
            sums = _prefix(mix(hashes[base:top] ^ seed) * up[: top - base])
            s = at[i:j] - base
            out[i:j] = mix((sums[s + size[i:j]] - sums[s]) * down[s] + size[i:j].astype(np.uint64))
            i = j
        return out


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about SLICE bytes of text or a single row."""
    for batch in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        sums = np.cumsum(sizes, dtype=np.int64)
        while at < batch.num_rows:
            base = sums[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sums, base + SLICE, side="right")))
            yield batch.slice(at, to - at)
            at = to


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
