"""Packing of documents into token sequences by the sum-of-squares rule.

Each piece goes where the sum, over residual gaps, of the squared number of open
sequences with that gap becomes smallest: into an open sequence or a new one. The rule
keeps gaps varied, so that later pieces find one they fill. Pieces are dealt into chunks
of bounded size and packed chunk by chunk; the few sequences that a chunk leaves
half empty or emptier are then packed as wholes in a further round.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolophon.llm.kernels import slices
from kolophon.runtime import Scratch

CAPACITY, END = 1024, 2
#: Pieces in a chunk, about.
CHUNK = 40_000
#: Words whose ids a worker remembers.
CACHE = 500_000
#: The special token's string, which the tokenizer takes as one id wherever it stands.
SPECIAL = "<|endoftext|>"
#: White space beside a space, as any notion of it has it; and spaces that have none beside them.
_RUN = re.compile(r"\s | \s")
_SINGLE = re.compile(r"(?<!\s) (?!\s)")

_PIECES = pa.schema([(c, pa.int64()) for c in ("row", "doc_id", "piece", "start", "length", "ids_crc32")])
_PIECES_SQL = "row long, doc_id long, piece long, start long, length long, ids_crc32 long"


class Encoder(dict):
    """Token ids of texts, as little-endian 32-bit bytes, by words that were met before.

    A byte-level BPE never merges across pretokens, and a pretoken starts at each space that
    has no white space on either side. So a text has the ids of its parts between such spaces
    in turn, each with its space. New parts are encoded by the same vocabulary as ranks, which
    gives the tokenizer's ids several times faster; a text with the special token's string,
    which only the tokenizer takes as one id, goes to the tokenizer.
    """

    def __init__(self, path: str | None = None):
        import base64
        from pathlib import Path

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(str(path))
        lines = Path(path).with_suffix(".tiktoken").read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ordinary, self.single = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece
        self.marks = {c: self._ids(c) for c in ".,;:!?"}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        return array("I", self.ordinary(text)).tobytes()

    def __missing__(self, part: str) -> bytes:
        letters = part.isascii() and part.isalpha()
        if not letters and part[-1:] in self.marks and part.isascii() and part[:-1].isalpha():  # letters are a pretoken, and the mark another
            return self[part[:-1]] + self.marks[part[-1]]
        if len(self) >= CACHE:
            self.clear()
        ids = array("I", self.single(f" {part}".encode())).tobytes() if letters else self._ids(" " + part)
        if len(part) < 64:
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.direct(text)
        head, *parts = _SINGLE.split(text) if _RUN.search(text) else text.split(" ")
        return self._ids(head) + b"".join(map(self.__getitem__, parts))


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    tail = np.array([end], "<u4").tobytes()
    for batch in slices(batches):
        rows: list[tuple] = []
        for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
            ids = encoder.encode(text or "") + tail
            n = len(ids) // 4
            first = n % capacity or capacity
            cuts = [0, *range(first, n + 1, capacity)]
            rows += [(row, doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, schema=_PIECES)


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given, by the sum-of-squares rule.

    A bin is opened only where none has room: that costs nothing here, as all sizes are known
    beforehand and come largest first, and left open it would make many more bins. Among equal
    sums the fullest bin wins; among bins with one gap, the last opened.
    """
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    made = 0
    full = np.iinfo(np.int64).max // 4
    for i, s in enumerate(sizes.tolist()):
        # Into a gap g >= s: n[g] falls by one and n[g - s] grows by one, so the sum changes by this.
        have = n[s:]
        cost = np.where(have > 0, 2 * (n[: capacity + 1 - s] - have) + 2, full)
        if have[0]:
            cost[0] = 1 - 2 * have[0]  # filled: no gap stays
        g = int(cost.argmin())
        if cost[g] < full:
            g += s
            b = open_at[g].pop()
            n[g] -= 1
        else:
            g, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            open_at[g - s].append(b)
            n[g - s] += 1
    return bins, offsets


def _pack_chunk(key: tuple, table: pa.Table, capacity: int) -> pa.Table:
    """Largest first; equal sizes in the order of their keys, so that reruns agree."""
    table = table.sort_by([("length", "descending"), ("a", "ascending"), ("b", "ascending")])
    bins, offsets = pack(table.column("length").to_numpy(), capacity)
    seq = bins + (np.int64(key[0].as_py()) << np.int64(24))
    return pa.table({"a": table.column("a"), "b": table.column("b"), "length": table.column("length"), "seq": seq, "offset": offsets})


def _packed(items: DataFrame, n: int, capacity: int) -> DataFrame:
    chunk = F.pmod(F.xxhash64("a", "b"), F.lit(max(1, -(-n // CHUNK))))
    return items.withColumn("chunk", chunk).groupBy("chunk").applyInArrow(lambda k, t: _pack_chunk(k, t, capacity), "a long, b long, length long, seq long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored. A document is its
    token ids and then ``end``; a null text is empty, so it is the one token. Only documents
    longer than a sequence are cut: into pieces of ``capacity`` tokens, the first of which
    takes the remainder. Returns a row per piece: doc_id, piece (from 0), start (its
    document's ids before it), length, ids_crc32, sequence_id, offset. Rows that repeat a
    doc_id, or have none, are documents of their own. An empty table gives an empty result.

    Two documents may get sequence ids that are far apart; nothing follows from their order.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = scratch.save(rows.mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end), _PIECES_SQL), "pieces")

    whole = pieces.where(F.col("length") == capacity)
    part = pieces.where(F.col("length") < capacity)  # the first piece of its document at most
    items = part.select(F.col("row").alias("a"), F.lit(0).cast("long").alias("b"), "length")
    first = scratch.save(_packed(items, items.count(), capacity), "packed")

    # Sequences left at most half full become items of a second round; fewer than one in each
    # chunk and size are left after it, whatever the number of documents.
    fill = first.groupBy("seq").agg(F.sum("length").alias("fill"))
    loose = fill.where(F.col("fill") <= capacity // 2).select(F.col("seq").alias("a"), F.lit(1).cast("long").alias("b"), F.col("fill").alias("length"))
    n = loose.count()
    again = scratch.save(_packed(loose, n, capacity), "repacked").select(F.col("a").alias("seq"), F.col("seq").alias("into"), F.col("offset").alias("shift"))
    placed = first.join(again, "seq", "left").select(
        F.col("a").alias("row"),
        # Three kinds of sequence, told apart by the last two bits: of whole pieces, of round 1, of round 2.
        F.coalesce(F.col("into") * 4 + 2, F.col("seq") * 4 + 1).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
    cols = ["doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = whole.withColumn("sequence_id", F.monotonically_increasing_id() * 4).withColumn("offset", F.lit(0).cast("long")).select(*cols)
    return alone.unionByName(part.join(placed, "row").select(*cols))
