"""Near-duplicate embeddings by tiled comparison in principal-axis order.

Vectors are scaled to length one, turned onto the principal axes of the whole table, and
cut into tiles of vectors that lie close along the leading axes. Two tiles are compared
only if their boxes along those axes are near enough. Within a pair of tiles the products
of the leading coordinates are accumulated first; what the rest can add is bounded by the
product of the suffix norms, and pairs that cannot reach the threshold go no further.
Those that remain are judged by their cosine in the input's own coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolophon.operators.graph import connected_components
from kolophon.runtime import Scratch, with_global_index

THRESHOLD = 0.98
#: Vectors in a tile, and leading axes whose extent in a tile is kept.
TILE, BOX = 1024, 6
#: Where the accumulation stops to drop pairs: numbers of leading axes.
STOPS = (4, 8, 16, 32)
#: Slack of the bounds against rounding; far above it, far below any step of interest.
SLACK = 1e-9


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, batch.filter(pa.array(dims == d))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of coordinates, by number of dimensions."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, own in _by_dim(batch):
            u = _units(_matrix(own.column("vec")))
            sums[d] = sums.get(d, 0) + u.T @ u
    for d, m in sums.items():
        at = np.arange(d * d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(at), pa.array(m.ravel())], names=["dim", "at", "v"])


def _axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for each number of dimensions, leading first, of all vectors.

    What comes to the driver is a square matrix for each number of dimensions.
    """
    rows = classes.select("dim", "vec").mapInArrow(_moments, "dim long, at long, v double").groupBy("dim", "at").agg(F.sum("v").alias("v")).collect()
    axes = {}
    for d in {r.dim for r in rows}:
        m = np.zeros(d * d)
        for r in rows:
            if r.dim == d:
                m[r.at] = r.v
        axes[d] = np.linalg.eigh(m.reshape(d, d))[1][:, ::-1]
    return axes


def _lead(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], cell: float) -> Iterator[pa.RecordBatch]:
    """The order of tiles: strips along the first axis, cells along the second, then the third."""
    for batch in batches:
        for d, own in _by_dim(batch):
            y = _units(_matrix(own.column("vec"))) @ axes[d][:, :3]
            y = np.pad(y, ((0, 0), (0, 3 - y.shape[1])))
            keys = [np.floor(y[:, 0] / cell).astype(np.int32), np.floor(y[:, 1] / cell).astype(np.int32), y[:, 2]]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("g", "cid", "m", "dim", "vec")), *map(pa.array, keys)], names=["g", "cid", "m", "dim", "vec", "c1", "c2", "y3"])


def _tile(table: pa.Table, axes: dict[int, np.ndarray]) -> pa.Table:
    """One row that holds a tile; g tells label and number of dimensions."""
    table = table.sort_by("cid").combine_chunks()
    x = _matrix(table.column("vec").combine_chunks() if isinstance(table.column("vec"), pa.ChunkedArray) else table.column("vec"))
    y = _units(x) @ axes[x.shape[1]][:, :BOX]
    y = np.pad(y, ((0, 0), (0, BOX - y.shape[1])))
    return pa.table(
        {
            "g": table.column("g").slice(0, 1),
            "tile": table.column("tile").slice(0, 1),
            "dim": pa.array([x.shape[1]], pa.int64()),
            "lo": pa.array([y.min(axis=0).tolist()], pa.list_(pa.float64())),
            "hi": pa.array([y.max(axis=0).tolist()], pa.list_(pa.float64())),
            "cids": pa.array([table.column("cid").to_numpy().tobytes()], pa.binary()),
            "ms": pa.array([table.column("m").to_numpy().tobytes()], pa.binary()),
            "xs": pa.array([x.tobytes()], pa.binary()),
        }
    )


def near_pairs(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` with cosine >= threshold; ``ua`` and ``ub`` are their units on principal axes."""
    d = a.shape[1]
    stops = [s for s in STOPS if s < d] + [d]
    s = stops[0]
    tail = lambda u, s: np.sqrt((u[:, s:] ** 2).sum(axis=1))
    dots = ua[:, :s] @ ub[:, :s].T
    i, j = np.nonzero(dots + tail(ua, s)[:, None] * tail(ub, s) >= threshold - SLACK)
    part = dots[i, j]
    for s, t in zip(stops, stops[1:], strict=False):
        if not len(i):
            break
        step = 1 << 18  # pairs at a time
        part = part + np.concatenate([np.einsum("ij,ij->i", ua[i[k : k + step], s:t], ub[j[k : k + step], s:t]) for k in range(0, len(i), step)])
        keep = part + tail(ua, t)[i] * tail(ub, t)[j] >= threshold - SLACK
        i, j, part = i[keep], j[keep], part[keep]
    if len(i):
        norm = lambda x: np.sqrt((x * x).sum(axis=1))
        step = 1 << 18
        dot = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)])
        keep = dot / (norm(a)[i] * norm(b)[j]) >= threshold
        i, j = i[keep], j[keep]
    return i, j


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index that links reach, for each of n."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each pair of tiles: what it adds to numbers of links, and edges that join what it links."""

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / np.abs(x).max(axis=1, keepdims=True)

    for batch in batches:
        for row in range(batch.num_rows):
            d = batch.column("dim")[row].as_py()
            get = lambda c, t: np.frombuffer(batch.column(c)[row].as_buffer(), t)  # noqa: B023, E731
            same = batch.column("i")[row].as_py() == batch.column("j")[row].as_py()
            a, b = scaled(get("xs_i", np.float64).reshape(-1, d)), scaled(get("xs_j", np.float64).reshape(-1, d))
            ca, cb, ma, mb = get("cids_i", np.int64), get("cids_j", np.int64), get("ms_i", np.int64), get("ms_j", np.int64)
            i, j = near_pairs(a, b, _units(a) @ axes[d], _units(b) @ axes[d], threshold)
            if same:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            off = 0 if same else len(ca)
            ids = ca if same else np.concatenate([ca, cb])
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, i, mb[j])
            np.add.at(links, off + j, ma[i])
            root = _forest(i, off + j, len(ids))
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(links[at])], names=["src", "dst", "links"])


def embedding_near_dedup(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Link vectors with equal labels and cosine >= threshold, in double precision.

    ``rows`` has ``vec_id`` (long), ``embedding`` (array of float or double) and ``label``;
    other columns are ignored. Returns a row per row: vec_id, n_links (other rows linked
    directly), component_id (least vec_id reachable, its own included), kept.

    A vector that is null, empty or zero, or has a null or non-finite component, or a null
    label, links with nothing; nor do vectors of different lengths. Equal vectors with one
    label are compared once and counted as often as they occur. Rows that repeat a vec_id
    are vectors of their own. A null vec_id counts as a link, but names no component unless
    the component has no other; ``kept`` is then null. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "embeddings")
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    vec = F.col("embedding").cast("array<double>")
    good = F.expr("label IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vec, x -> x != 0)")
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vec.alias("vec"))
    base = base.withColumn("good", F.coalesce(good, F.lit(False)))
    base = base.withColumn("vec", F.when(F.col("good"), F.col("vec")))
    # A class holds equal vectors of one label, told by two 64-bit hashes; 0.0 makes -0.0 equal to it.
    plus = F.transform("vec", lambda x: x + F.lit(0.0))
    base = base.withColumns({"cid": F.xxhash64("label", plus), "c2": F.xxhash64(F.lit(7), plus, "label")})
    found = (
        base.where("good").groupBy("label", "cid", "c2").agg(F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec"), F.min("vec_id").alias("low"))
        .withColumn("dim", F.size("vec").cast("long")).withColumn("g", F.concat_ws("|", F.col("dim").cast("string"), "label"))
    )
    # A number of its own for each class: a node.
    numbered = scratch.save(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    names = numbered.select("label", "cid", "c2", "node", "m", "low")
    classes = numbered.select("g", F.col("node").alias("cid"), "m", "dim", "vec")
    axes = _axes(classes)
    side = float(np.sqrt(2 - 2 * threshold)) or 1e-3
    lead = classes.mapInArrow(lambda it: _lead(it, axes, side), "g string, cid long, m long, dim long, vec array<double>, c1 int, c2 int, y3 double")
    ranked = with_global_index(scratch, lead, [F.col(c) for c in ("c1", "c2", "y3", "cid")], group="g")
    tiles = scratch.save(
        ranked.select("g", (F.col("idx") / TILE).cast("long").alias("tile"), "cid", "m", "vec").groupBy("g", "tile").applyInArrow(lambda t: _tile(t, axes), "g string, tile long, dim long, lo array<double>, hi array<double>, cids binary, ms binary, xs binary"),
        "tiles",
    )
    box = tiles.select("g", "tile", "lo", "hi")
    one, two = (box.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "lo", "hi")]) for s in "ij")
    gap = "aggregate(zip_with(zip_with(lo_i, hi_j, (x, y) -> x - y), zip_with(lo_j, hi_i, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)), 0D, (s, x) -> s + x * x)"
    # Only tiles that meet in a cell of the two leading axes, or in cells next to each other, can be near enough.
    cell = lambda c, a: F.floor(F.col(c)[a] / side).cast("int")
    span = lambda s, a, more: F.explode(F.sequence(cell(f"lo_{s}", a) - more, cell(f"hi_{s}", a) + more)).alias(f"s{a}")
    one, two = (t.select("*", span(s, 0, more)).select("*", span(s, 1, more)) for t, s, more in ((one, "i", 0), (two, "j", 1)))
    near = one.join(two, ["g", "s0", "s1"]).where(f"tile_i <= tile_j AND {gap} <= {2 - 2 * threshold + SLACK}")
    pairs = near.select("g", F.col("tile_i").alias("i"), F.col("tile_j").alias("j")).distinct()
    held = lambda s: tiles.select("g", F.col("tile").alias(s), *([F.col("dim")] if s == "i" else []), *[F.col(c).alias(f"{c}_{s}") for c in ("cids", "ms", "xs")])
    work = pairs.repartition("g", "i", "j").join(held("i"), ["g", "i"]).join(held("j"), ["g", "j"])
    linked = scratch.save(work.mapInArrow(lambda it: _compare(it, axes, threshold), "src long, dst long, links long"), "linked")

    counts = linked.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    comps = connected_components(linked.select("src", "dst"), scratch)
    named = comps.join(names.select("node", "low"), "node")
    lows = named.groupBy("component").agg(F.min("low").alias("least"))
    of_class = (
        names.join(named.join(lows, "component").select("node", "least"), "node", "left")
        .join(counts, "node", "left")
        .select("label", "cid", "c2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("least", "low").alias("least"))
    )
    out = base.select("vec_id", F.when(F.col("good"), F.col("label")).alias("label"), "cid", "c2").join(of_class, ["label", "cid", "c2"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
