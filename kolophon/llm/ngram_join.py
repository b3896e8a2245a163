"""N-gram Jaccard join by vertical partitioning.

A document's set holds the hashes of its distinct word shingles. Copies are one class: equal
sets are compared once. All shingles have one global order, by the number of classes that hold
them. A class that links with another of Jaccard similarity t lacks at most n - ceil(t n)
shingles of it, so classes with more shingles that no other has are left out first: by the
shingles of a window of the order by hash, then by all of those that remain.

The global order is cut into fragments, ranges of hashes. A pair's overlap is counted in each
fragment separately, over the shingles that any other class has too, and the partial overlaps
are summed per pair. Pairs are those that share a shingle of their prefixes, the first
n - ceil(t n) + 1 of the global order, as every pair of similarity t does.

Within a bucket, the classes with one shingle in their prefixes, a few hubs are compared with all
others first. What these links join needs no further comparison with each other, so a large group
of near copies costs a few comparisons for each of its members. Afterwards every pair of a bucket
that is in different components, and whose positions in the order and bitmaps leave enough to
share, is compared too, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kolophon.llm import repeats
from kolophon.llm.kernels import Words, mix, signed, slices
from kolophon.operators.graph import connected_components
from kolophon.runtime import Scratch

#: Words in a shingle, and the least similarity of a link in hundredths.
SHINGLE, PERCENT = 5, 80
#: Fragments of the global order, a power of two.
FRAGMENTS = 8
#: A shingle found so often in what one mapper holds is counted; so many of the counted ones are ordered last.
LOCAL_OFTEN, OFTEN = 6, 1 << 17
#: Hundredths of a set, beyond what a link may lack, in which shingles of one class alone are looked for first.
WINDOW = 12
#: Documents of a bucket with which all others are compared first.
HUBS = 3
#: Added to the count of an often one, so that it is ordered after all others.
_LAST = 1 << 40

_SIG = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "n", "s1", "s2"))])
_SIG_SQL = "kind int, doc_id long, n long, s1 long, s2 long"


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles, words lower-cased in A-Z."""
    w = Words(texts, lower=True)
    count = w.counts()
    windows = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    ends = np.cumsum(windows)
    begin = ends - windows
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(begin, windows) + np.repeat(w.bounds[:-1], windows)
    hashes = w.windows(0, len(w.hashes), at, np.repeat(np.minimum(count, k), windows))
    out = []
    for b, e in zip(begin.tolist(), ends.tolist(), strict=True):
        h = np.sort(hashes[b:e])
        if len(h) > 1:
            h = h[np.concatenate(([True], h[1:] != h[:-1]))]
        out.append(h)
    return out


def _signature(h: np.ndarray) -> tuple[int, int]:
    if not len(h):
        return 0, 0
    return int(signed(mix(h).sum(keepdims=True))[0]), int(signed(np.bitwise_xor.reduce(mix(h ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True))[0])


def _often(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Shingles that are frequent in what a mapper has gathered, with their counts."""
    if gathered:
        h = np.sort(np.concatenate(gathered))
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.append(at, len(h)))
        keep = n >= LOCAL_OFTEN
        z = np.zeros(int(keep.sum()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (z.astype(np.int32) + 1, signed(h[at][keep]), n[keep], z, z)], schema=_SIG)


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    gathered: list[np.ndarray] = []
    held = 0
    for batch in slices(batches):
        sets = shingle_sets(batch.column("text"), k)
        sig = [_signature(h) for h in sets]
        rows = [np.zeros(len(sets), np.int32), None, np.array([len(h) for h in sets], np.int64), np.array([x for x, _ in sig], np.int64), np.array([y for _, y in sig], np.int64)]
        rows[1] = batch.column("doc_id")
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in rows], schema=_SIG)
        gathered += sets
        held += sum(map(len, sets))
        if held >= 4_000_000:
            yield from _often(gathered)
            gathered, held = [], 0
    yield from _often(gathered)


def _lacking(n, percent: int):
    """How many shingles of a set of ``n`` a linked one may lack at most."""
    return n - -(-percent * n // 100)


def _windows(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The first shingles by hash of each text, a class's under its signature."""
    parts, held = [], 0
    for batch in slices(batches):
        for h in shingle_sets(batch.column("text"), k):
            if len(h):
                first = h[: _window(len(h), percent)]
                parts.append((signed(first), _signature(h)[0], len(h)))
                held += len(first)
        if held >= repeats.FLUSH:
            yield from _flush(parts)
            parts, held = [], 0
    yield from _flush(parts)


def _window(n: int, percent: int) -> int:
    return min(n, _lacking(n, percent) + 1 + WINDOW * n // 100)


def _flush(parts) -> Iterator[pa.RecordBatch]:
    if parts:
        sizes = [len(h) for h, _, _ in parts]
        k = np.concatenate([h for h, _, _ in parts])
        doc, n = (np.repeat(np.array([p[i] for p in parts], np.int64), sizes) for i in (1, 2))
        z = np.zeros(len(k), np.int64)
        yield from repeats.flush([(k, z, doc, z, n)])


_POST = pa.schema([(c, pa.int64()) for c in ("part", "k", "cid", "n", "c")])
_POST_SQL = "part long, k long, cid long, n long, c long"


def _postings(batches: Iterator[pa.RecordBatch], k: int, often) -> Iterator[pa.RecordBatch]:
    """All shingles of the classes; one of ``often`` with its count, and not brought together with its like."""
    hashes, counts = often.value
    by = np.argsort(hashes)
    hashes, counts = np.append(hashes[by], np.uint64((1 << 64) - 1)), np.append(counts[by], 0)
    for batch in slices(batches):
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "n", "s1", "s2")]
        # A doc_id that repeats may have other texts too.
        own = [(cid, h) for cid, n, s1, s2, h in zip(*cols, shingle_sets(batch.column("text"), k), strict=True) if len(h) == n and _signature(h) == (s1, s2)]
        if not own:
            continue
        h = np.concatenate([x for _, x in own])
        sizes = [len(x) for _, x in own]
        cid, n = np.repeat(np.array([c for c, _ in own], np.int64), sizes), np.repeat(np.array(sizes, np.int64), sizes)
        at = np.searchsorted(hashes[:-1], h)
        c = np.where(hashes[at] == h, counts[at], 0)
        part = np.where(c > 0, cid, signed(h))
        for i in range(0, len(h), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (part, signed(h), cid, n, c)], schema=_POST)


#: Columns of 64 bits each that hold a bitmap of the shingles that others have too.
MAP = [f"b{i}" for i in range(16)]
_SETS = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("ks", pa.list_(pa.int64())), *((b, pa.int64()) for b in MAP)])
_SETS_SQL = "cid long, n long, alone long, ks array<long>, " + ", ".join(f"{b} long" for b in MAP)


def _arranged(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each class the shingles that others have too, in the global order, if they are enough for a link."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        pairs = batch.column("pairs")
        row = np.repeat(np.arange(len(n)), pc.list_value_length(pairs).to_numpy(zero_copy_only=False))
        flat = pairs.flatten()
        df, k = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        order = np.lexsort((k, df, row))
        row, df, k = row[order], df[order], k[order]
        again = np.zeros(len(k), bool)  # of a row that is there twice
        again[1:] = (k[1:] == k[:-1]) & (row[1:] == row[:-1])
        row, k = row[~again], k[~again]
        have = np.bincount(row, minlength=len(n))
        stay = n - have <= _lacking(n, percent)
        ks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(have[stay])), pa.int32()), pa.array(k[stay[row]]))
        bits = np.zeros((len(n), 64 * len(MAP)), bool)
        bits[row, (k.view(np.uint64) >> np.uint64(20)).astype(np.int64) % bits.shape[1]] = True
        maps = np.packbits(bits[stay], axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("cid").filter(pa.array(stay)), pa.array(n[stay]), pa.array((n - have)[stay]), ks, *(pa.array(maps[:, i].copy()) for i in range(len(MAP)))], schema=_SETS)


_SEG = pa.schema([("cid", pa.int64()), ("frag", pa.int32()), ("seg", pa.list_(pa.int64()))])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each class by fragments."""
    for batch in batches:
        ks = batch.column("ks")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(ks).to_numpy(zero_copy_only=False))
        flat = ks.flatten().to_numpy(zero_copy_only=False)
        frag = (flat.view(np.uint64) >> np.uint64(65 - FRAGMENTS.bit_length())).astype(np.int64)
        order = np.lexsort((flat, frag, row))
        cell, flat = (row * FRAGMENTS + frag)[order], flat[order]
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
        seg = pa.ListArray.from_arrays(pa.array(np.append(at, len(cell)), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(cell[at] // FRAGMENTS)), pa.array((cell[at] % FRAGMENTS).astype(np.int32)), seg], schema=_SEG)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of ``pairs(a, b, na, nb)`` the links: partial overlaps by fragment, summed per pair."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    segments = scratch.save(sets.join(used, "cid", "left_semi").select("cid", "ks").mapInArrow(_segments, "cid long, frag int, seg array<long>"), "segments")
    b = segments.select(F.col("cid").alias("b"), "frag", F.col("seg").alias("seg_b"))
    a = segments.select(F.col("cid").alias("a"), "frag", F.col("seg").alias("seg_a"))
    partial = pairs.join(b, "b").join(a, ["a", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("seg_a", "seg_b")).alias("o"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    links = scratch.save(whole.where(F.expr(f"100 * o >= {percent} * (na + nb - o)")).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    scratch.drop(segments)
    return links


def ngram_join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Link documents whose shingle sets have Jaccard similarity of ``percent`` hundredths or more.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored. Returns a row per
    row of ``docs``: doc_id, n_shingles (set size), component_id (least doc_id reachable).

    A null or blank text has an empty set and links with nothing. Fewer than ``k`` words are
    one shingle. Rows with a null doc_id get a null component. Rows that repeat a doc_id with
    other texts are one document in the graph, and each of its sets is compared.
    An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "ngram_join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = scratch.save(docs.mapInArrow(lambda it: _signatures(it, k), _SIG_SQL), "signatures")
    sig = first.where("kind = 0").select("doc_id", "n", "s1", "s2")

    # Bounded by OFTEN rows: an order, not a filter.
    top = (
        first.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "doc_id").limit(OFTEN).collect()
    )
    often = spark.sparkContext.broadcast((np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)))

    same = ["n", "s1", "s2"]
    classes = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("doc_id"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # What no other class has can not be shared: too much of it in the window, and there is no link.
    windows = repeats.repeated(docs.where("doc_id IS NOT NULL").mapInArrow(lambda it: _windows(it, k, percent), repeats.COLUMNS), firsts_too=True)
    found = windows.groupBy(F.col("doc").alias("s1"), "n").agg(F.count(F.lit(1)).alias("others"))  # or more, by copies
    most = F.expr(f"n - ceil({percent} * n / 100)")
    wide = F.least(F.col("n"), most + 1 + F.floor(F.col("n") * WINDOW / 100))
    left = scratch.save(classes.join(found.where(wide - F.col("others") <= most).select("s1", "n"), ["s1", "n"]), "left")

    # The classes left grow with the table, so they are dealt out by their documents at every size.
    posts = docs.join(left.hint("merge"), "doc_id").mapInArrow(lambda it: _postings(it, k, often), _POST_SQL)
    counted = posts.withColumn("df", F.when(F.col("c") > 0, F.col("c") + _LAST).otherwise(F.count(F.lit(1)).over(W.partitionBy("part", "k"))))
    held = counted.where("df > 1").groupBy("cid", "n").agg(F.collect_list(F.struct("df", "k")).alias("pairs"))
    sets = scratch.save(held.mapInArrow(lambda it: _arranged(it, percent), _SETS_SQL), "sets")

    prefix = sets.select("cid", "n", "alone", F.posexplode(F.slice("ks", F.lit(1), F.greatest(most + 1 - F.col("alone"), F.lit(0)).cast("int"))).alias("i", "k"))
    prefix = scratch.save(prefix.select("k", F.col("cid").alias("doc"), (F.col("alone") + F.col("i")).alias("pos"), "n"), "prefix")
    size = prefix.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = scratch.save(prefix.join(size, "k"), "shared")
    scratch.drop(prefix)

    # Hubs of a bucket: the most central class, whose shingles are the most common in buckets on
    # average, as are those of the text that near copies were made from; and some by hashes.
    central = shared.groupBy("doc").agg((F.sum("m") / F.max("n")).alias("central"))
    shared = scratch.save(shared.join(central, "doc"), "central")
    rank = [F.struct((-F.col("central")).alias("r"), "doc", "pos", "n")] + [F.struct(F.xxhash64("doc", F.lit(i)).alias("r"), "doc", "pos", "n") for i in range(1, HUBS)]
    hubs = shared.groupBy("k").agg(*[F.min(r).alias(f"h{i}") for i, r in enumerate(rank)])
    hubs = hubs.select("k", F.explode(F.array_distinct(F.array(*[F.struct(f"h{i}.doc", f"h{i}.pos", f"h{i}.n") for i in range(HUBS)]))).alias("h"))
    tested = scratch.save(_hub_pairs(hubs.select("k", "h.*"), shared, percent), "pairs")
    links = _verified(tested, sets, percent, scratch)
    comps = connected_components(links, scratch)

    labelled = shared.join(comps.select(F.col("node").alias("doc"), "component"), "doc", "left").select("k", "doc", "pos", "n", F.coalesce("component", "doc").alias("comp"))
    open_k = labelled.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("k")
    maps = sets.select(F.col("cid").alias("doc"), (F.col("n") - F.col("alone")).alias("held"), *MAP)
    rest = _pairs_across(scratch.save(labelled.join(open_k, "k", "left_semi").join(maps, "doc"), "open"), percent)
    rest = scratch.save(rest.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        comps = connected_components(links.unionByName(_verified(rest, sets, percent, scratch)), scratch)

    # A class stands for its least document, and a component for that of its classes.
    joined = scratch.save(comps.join(classes.select(F.col("cid").alias("node"), *same, "doc_id"), "node"), "joined")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("least"))
    alone = classes.join(joined.select(F.col("node").alias("cid")), "cid", "left_anti").select(*same, F.col("doc_id").alias("least"))
    to_comp = joined.join(least, "component").select(*same, "least").unionByName(alone)
    # A blank one is its own, and not brought together with its like.
    out = sig.where("n > 0").join(to_comp, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))
    out = out.unionByName(sig.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return _unify(out, scratch)


def _unify(out: DataFrame, scratch: Scratch) -> DataFrame:
    """Give the rows of a repeated doc_id, which may be in several components, one component."""
    several = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi")
    edges = scratch.save(out.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst")), "repeated_ids")
    if edges.isEmpty():
        return out
    comps = connected_components(edges, scratch).select(F.col("node").alias("component_id"), "component")
    return out.join(comps, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))


def _hub_pairs(hubs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, na, nb), a < b, of hubs and others with equal k, that may link.

    What two sets share up to the last shingle that both prefixes hold is counted here; beyond
    it they share at most what remains of either.
    """
    a = hubs.select("k", *[F.col(c).alias(f"{c}_1") for c in ("doc", "pos", "n")])
    b = shared.select("k", *[F.col(c).alias(f"{c}_2") for c in ("doc", "pos", "n")])
    j = a.join(b, "k").where("doc_1 != doc_2").where(f"{percent} * greatest(n_1, n_2) <= 100 * least(n_1, n_2)")
    # Two hubs of a bucket meet in both directions, so more is counted, which leaves the bound one.
    swap = F.col("doc_1") > F.col("doc_2")
    j = j.select("k", *[F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}{to}") for c in ("doc", "pos", "n") for x, y, to in ((1, 2, "a"), (2, 1, "b"))])
    met = j.groupBy(F.col("doca").alias("a"), F.col("docb").alias("b"), "na", "nb").agg(F.count(F.lit(1)).alias("c"), F.max("posa").alias("pa"), F.max("posb").alias("pb"))
    return met.where(f"(100 + {percent}) * (c + least(na - pa, nb - pb) - 1) >= {percent} * (na + nb)").select("a", "b", "na", "nb")


def _pairs_across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs as above of one bucket, but of different components, that may link.

    If k is the first shingle that both have, they share at most it and what remains of either. And
    a bit that one set alone has stands for a shingle, or more, that the other lacks.
    """
    a, b = (rows.select("k", *[F.col(c).alias(f"{c}_{i}") for c in ("doc", "pos", "n", "comp", "held", *MAP)]) for i in (1, 2))
    j = a.join(b, "k").where("doc_1 < doc_2 AND comp_1 != comp_2").where(f"{percent} * greatest(n_1, n_2) <= 100 * least(n_1, n_2)")
    j = j.where(f"(100 + {percent}) * least(n_1 - pos_1, n_2 - pos_2) >= {percent} * (n_1 + n_2)")
    for x, y in (("1", "2"), ("2", "1")):
        lacks = " + ".join(f"bit_count({b}_{x} & ~{b}_{y})" for b in MAP)
        j = j.where(f"(100 + {percent}) * (held_{x} - ({lacks})) >= {percent} * (n_1 + n_2)")
    return j.select(F.col("doc_1").alias("a"), F.col("doc_2").alias("b"), F.col("n_1").alias("na"), F.col("n_2").alias("nb")).distinct()
