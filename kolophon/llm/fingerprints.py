"""Homomorphic multiset fingerprints of documents, in DataFrame functions alone.

A paragraph (line) is hashed to a wide vector of integers; a document's vector is the sum of
its paragraphs', each number modulo 2**32. So the order of paragraphs does not matter, and a
paragraph is inserted or deleted by adding or subtracting its vector. A vector has two parts:

* four numbers, the halves of two 64-bit hashes of the paragraph: their sums tell multisets
  of paragraphs apart;
* the number of the paragraph's features (each word with the two after it) and, for each
  of 256 bits, how many of the features' hashes have it set. These are sums as well, and the
  cosine of two such vectors, centred, estimates that of the multisets of features, with a
  standard error of 1/16 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANES = 256
#: Hashes of 64 bits of a feature; features whose bits are counted in one byte each (a long has a sign).
_HASHES, _BYTE = LANES // 64, 127
#: Documents in a block, about, and most blocks; a block is what is sorted together.
BLOCK, MOST_BLOCKS = 512, 16_384
#: Each word of a line with up to two words after it, found without consuming them.
FEATURE = r"(?<![^\x09-\x0D ])(?=([^\x09-\x0D ]+(?:[\x09\x0B-\x0D ]+[^\x09-\x0D ]+){0,2}))"
_LOW = (1 << 32) - 1
_KEYS = ["b", "rn", "kind", "ghost", "doc_id", "n_chars", "edited_sha256"]


def _sums(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The vectors of ``texts(*keys, t)``: keys, n, eq (4 numbers), ones (256 numbers)."""
    lines = F.transform(F.split("t", "\n"), lambda p: F.concat(F.lit("\n"), p))
    feature = F.posexplode(F.concat(lines, F.regexp_extract_all(F.col("t"), F.lit(FEATURE), F.lit(1)))).alias("p", "f")
    rows = texts.select(*keys, feature).select(*keys, (F.col("p") / _BYTE).cast("int").alias("chunk"), "f", F.startswith("f", F.lit("\n")).alias("line"), F.xxhash64("f").alias("h"))
    zero = F.lit(0).cast("long")
    # The second hash is of other bytes, as the seeds of one hash are chained.
    halves = [y for c in (F.col("h"), F.xxhash64(F.concat(F.lit("\x01"), F.col("f")))) for y in (c.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(c, 32))]
    rows = rows.select(
        *keys,
        "chunk",
        F.when(F.col("line"), 0).otherwise(1).alias("one"),
        *[F.when(F.col("line"), zero).otherwise(F.xxhash64("h", F.lit(j)) if j else F.col("h")).alias(f"w{j}") for j in range(_HASHES)],
        *[F.when(F.col("line"), x).otherwise(zero).alias(f"e{i}") for i, x in enumerate(halves)],
    )
    # Eight counters in one sum, a byte each, over no more rows than a byte counts; then two counters in one.
    bytes_ = [F.sum(F.shiftrightunsigned(f"w{j}", i).bitwiseAND(F.lit(0x0101010101010101))).alias(f"c{8 * j + i}") for j in range(_HASHES) for i in range(8)]
    part = rows.groupBy(*keys, "chunk").agg(F.sum("one").alias("n"), *[F.sum(f"e{i}").alias(f"e{i}") for i in range(4)], *bytes_)
    two = [F.sum(F.shiftrightunsigned(f"c{j}", 8 * i).bitwiseAND(F.lit(0x000000FF000000FF))) for j in range(8 * _HASHES) for i in range(4)]
    done = part.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"e{i}").alias(f"e{i}") for i in range(4)], *[x.alias(f"s{i}") for i, x in enumerate(two)])
    packed = F.array(*[f"s{i}" for i in range(len(two))])
    ones = F.concat(F.transform(packed, lambda x: x.bitwiseAND(F.lit(_LOW))), F.transform(packed, lambda x: F.shiftrightunsigned(x, 32)))
    return done.select(*keys, "n", F.array(*[F.col(f"e{i}").bitwiseAND(F.lit(_LOW)) for i in range(4)]).alias("eq"), ones.alias("ones"))


def _text(eq: Column, n: Column, ones: Column) -> Column:
    """The fingerprint in hexadecimal: equality numbers, number of features, 256 counts."""
    numbers = F.concat(eq, F.array(n.bitwiseAND(F.lit(_LOW))), ones)
    return F.array_join(F.transform(numbers, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two vectors (structs of eq, n and ones): 1 if equal, else the cosine, 0 at least."""

    def centred(v: Column) -> Column:
        return F.transform(v["ones"], lambda x: 2.0 * x - v["n"])

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    x, y = centred(a), centred(b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def _blocks(docs: DataFrame) -> tuple[Column, DataFrame]:
    """The block of a doc_id, counted from the largest, and the blocks' largest doc_ids."""
    ids = docs.select("doc_id").dropna()
    n = ids.count()
    m = min(MOST_BLOCKS, n // BLOCK)
    cuts: list[int] = []
    if m > 1:
        found = ids.agg(F.percentile_approx("doc_id", [i / m for i in range(1, m)], max(10_000, 20 * m))).first()[0]
        cuts = sorted(set(found), reverse=True)
    step = max(1, round(len(cuts) ** 0.5))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<bigint>")
    # How many cuts are not below: whole groups of them first, then within one.
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    coarse = longs([g[-1] for g in groups if len(g) == step])
    at = F.size(F.filter(coarse, lambda c: c >= F.col("doc_id")))
    own = F.coalesce(F.get(F.array(*[longs(g) for g in groups]), at), longs([]))
    return (at * step + F.size(F.filter(own, lambda c: c >= F.col("doc_id")))).cast("int"), ids


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents, of an edited text of each, and their likeness.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored. A null text is empty.
    The edited text has its last floor(n_chars / 2) code points replaced by the first as many,
    or all, of the next document's: in descending doc_id, equal ones by text, and the first after
    the last. Returns a row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next, the likeness from 0 to 1 of its fingerprint
    to the edited text's and the next document's.

    A document with a null doc_id has no next: its edited text only loses its end, and the
    next one's fingerprint is that of an empty text. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    block, ids = _blocks(docs)
    # A row for each block: its largest doc_id, and the block before it (the last, before the first).
    heads = ids.groupBy(block.alias("b")).agg(F.max("doc_id").alias("m")).orderBy("b").collect()
    if not heads:
        head, before = F.lit(None).cast("long"), F.lit(0)
    else:
        n = heads[-1].b + 1
        ms: list = [None] * n
        ps: list = [None] * n
        for i, r in enumerate(heads):
            ms[r.b], ps[r.b] = r.m, heads[i - 1].b
        head, before = (F.get(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("b")) for xs in (ms, ps))
    dealt = docs.where("doc_id IS NOT NULL").withColumn("b", block)
    # The first document of a block also goes, as a ghost, to the end of the block before it.
    place = lambda b, ghost: F.struct(b.cast("int").alias("b"), F.lit(ghost).alias("ghost"))
    places = F.when(F.col("doc_id") == head, F.array(place(F.col("b"), False), place(before, True))).otherwise(F.array(place(F.col("b"), False)))
    dealt = dealt.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.*")
    order = W.partitionBy("b").orderBy("ghost", F.desc("doc_id"), "text")
    placed = dealt.select("b", "ghost", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next"))

    # Documents without a doc_id: a block of their own for each, which ends with an empty ghost.
    lost = docs.where("doc_id IS NULL").withColumn("b", F.pmod(F.xxhash64("text"), F.lit(1 << 20)).cast("int"))
    h = (F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - h), F.substring(F.coalesce("next", F.lit("")), F.lit(1), h))

    def vectors(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("edited", F.when(~F.col("ghost"), edited))
        both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
        rows = rows.select("b", "rn", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(both).alias("x"))
        return _sums(rows.select("b", "rn", "ghost", "doc_id", "n_chars", "edited_sha256", "x.*").where("t IS NOT NULL"), _KEYS).withColumn("v", F.struct("eq", "n", "ones"))

    def finished(rows: DataFrame, other: Column, after: Column) -> DataFrame:
        rows = rows.select("doc_id", "n_chars", "edited_sha256", "v", other.alias("e"), after.alias("a"), "kind", "ghost").where("kind = 0 AND NOT ghost")
        return rows.select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            _text(F.col("v.eq"), F.col("v.n"), F.col("v.ones")).alias("fingerprint"),
            _text(F.col("e.eq"), F.col("e.n"), F.col("e.ones")).alias("edited_fingerprint"),
            likeness(F.col("v"), F.col("e")).alias("near_edited"),
            likeness(F.col("v"), F.col("a")).alias("near_next"),
        )

    by_rank = W.partitionBy("b").orderBy("rn", "kind")
    out = finished(vectors(placed), F.lead("v", 1).over(by_rank), F.lead("v", 2).over(by_rank))
    alone = lost.select("b", F.lit(False).alias("ghost"), "doc_id", "text", F.monotonically_increasing_id().alias("rn"), F.lit(None).cast("string").alias("next"))
    pair = W.partitionBy("b", "rn").orderBy("kind")
    empty = F.xxhash64(F.lit("\n")), F.xxhash64(F.lit("\x01\n"))
    nothing = F.struct(
        F.array(*[y for c in empty for y in (c.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(c, 32))]).alias("eq"),
        F.lit(0).cast("long").alias("n"),
        F.array_repeat(F.lit(0).cast("long"), LANES).alias("ones"),
    )
    return out.unionByName(finished(vectors(alone), F.lead("v", 1).over(pair), nothing))
