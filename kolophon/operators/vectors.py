"""Unit vectors, removal of dominant directions, and nearest-neighbour graphs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType

#: Vectors that a part of a search meets at once, of its own in a product, and candidates that wait to be ranked.
BLOCK, TILE, HELD = 2048, 256, 1 << 20
#: Parts of a search and most vectors of one; most cells of the one by cells: the centres are on the driver.
PARTS, MOST_OWN, MOST_CELLS = 24, 1 << 16, 16_384


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str, least: float = 1e-8) -> Column:
    """The vector over its length, which counts as ``least`` at least."""
    v = F.col(v) if isinstance(v, str) else v
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(least))
    return F.transform(v, lambda x: x.cast("double") / n)


def mean_vector(df: DataFrame, column: str) -> DataFrame:
    """``(dim, mean)`` with dim from 0: one partial aggregate over exploded coordinates."""
    return df.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def embed(lines: DataFrame, encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], text: str = "clean", batch_size: int = 256) -> DataFrame:
    """Add ``embedding`` by an encoder, which each worker makes once: texts to a matrix."""
    from pyspark.ml.functions import predict_batch_udf

    run = predict_batch_udf(encoder, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return lines.withColumn("embedding", run(F.coalesce(text, F.lit(""))))


def _moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance, by sums of each partition; a square matrix comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        if n:
            flat = np.concatenate([[n], s, p.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    rows = df.select(F.col(column).cast("array<double>")).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r.i] = r.v
    d = int((np.sqrt(4 * len(rows) - 3) - 1) / 2) if len(rows) else 0
    n = int(flat[0]) if d else 0
    mean = flat[1 : d + 1] / max(n, 1)
    return n, mean, flat[d + 1 :].reshape(d, d) / max(n, 1) - np.outer(mean, mean)


def _without(x: np.ndarray, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
    y = x - mean
    y = y - (y @ top) @ top.T
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-8)


def all_but_the_top(df: DataFrame, k: int, column: str = "embedding") -> DataFrame:
    """Centre, remove the k leading directions, and scale to length one again.

    The directions are eigenvectors of the covariance, which are the right singular vectors of the
    centred matrix. k stays below the number of dimensions.
    """
    n, mean, cov = _moments(df, column)
    k = max(0, min(k, len(mean) - 1))
    top = np.linalg.eigh(cov)[1][:, ::-1][:, :k] if n else np.zeros((len(mean), 0))

    @F.pandas_udf(ArrayType(DoubleType()))
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(_without(np.stack(v.to_list()).astype(float), mean, top))) if len(v) else v

    return df.withColumn(column, apply(F.col(column)))


def all_but_the_top_per_source(df: DataFrame, k: int, column: str = "embedding", source: str = "source") -> DataFrame:
    """The same within each source; one with fewer than k + 2 rows stays as it is.

    The moments of all sources are partial sums, so no source is gathered in one place.
    """
    d = df.select(F.size(column).alias("d")).first()
    d = d.d if d else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            if b.num_rows:
                names = b.column(0).to_pylist()
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                for s in set(names):
                    y = x[[n == s for n in names]]
                    sums[s] = sums.get(s, 0) + np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])
        for s, flat in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(flat), pa.string()), pa.array(np.arange(len(flat))), pa.array(flat)], names=["s", "i", "v"])

    name = F.col(source).cast("string")
    parts = df.select(name.alias("s"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "s string, i long, v double")
    moments = parts.groupBy("s", "i").agg(F.sum("v").alias("v")).groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("_moments"))

    @F.pandas_udf(ArrayType(DoubleType()))
    def apply(v: pd.Series, m: pd.Series) -> pd.Series:
        tops: dict[bytes, tuple] = {}
        out = []
        for x, flat in zip(v, m, strict=True):
            flat = np.asarray(flat)
            key = flat[: d + 1].tobytes()
            if key not in tops:
                mean = flat[1 : d + 1] / flat[0]
                cov = flat[d + 1 :].reshape(d, d) / flat[0] - np.outer(mean, mean)
                tops[key] = (mean, np.linalg.eigh(cov)[1][:, ::-1][:, : min(k, d - 1)])
            x = np.asarray(x, float)
            out.append(x if flat[0] < k + 2 else _without(x[None], *tops[key])[0])
        return pd.Series(out)

    joined = df.join(moments, name.eqNullSafe(moments["s"]))
    return joined.withColumn(column, apply(F.col(column), F.col("_moments"))).drop("s", "_moments")


class _Nearest:
    """The k nearest of each of some vectors among those met so far; ties go to the lesser id.

    A product of matrices tells which can be among them; their similarities are then summed in one
    order, so that equal vectors are equally near wherever they stand.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.sim, self.dst = np.full((len(x), k), -np.inf), np.zeros((len(x), k), ids.dtype)
        self.length = np.linalg.norm(x, axis=1)
        self.waiting: list[tuple] = []
        self.held = 0

    def meet(self, rows: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        if not len(y):
            return
        slack = 1e-12 * np.linalg.norm(y, axis=1).max()
        for t in range(0, len(rows), TILE):
            r = rows[t : t + TILE]
            g = self.x[r] @ y.T
            least = self.sim[r, -1]
            new = np.flatnonzero(np.isneginf(least))
            if len(new) and y.shape[0] > self.k + 1:  # one of them may be the vector itself
                least[new] = np.partition(g[new], -self.k - 1, axis=1)[:, -self.k - 1]
            i, j = np.nonzero(g >= (least - slack * self.length[r])[:, None])
            other = self.ids[r[i]] != ids[j]
            i, j = i[other], j[other]
            for c in range(0, len(i), HELD):
                at = r[i[c : c + HELD]]
                self.waiting.append((at, ids[j[c : c + HELD]], (self.x[at] * y[j[c : c + HELD]]).sum(axis=1)))
                self.held += len(at)
                if self.held >= HELD:
                    self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        at, dst, sim = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        old = np.unique(at)
        at, dst, sim = np.concatenate([np.repeat(old, self.k), at]), np.concatenate([self.dst[old].ravel(), dst]), np.concatenate([self.sim[old].ravel(), sim])
        order = np.lexsort((dst, -sim, at))
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        keep = order[(first[:, None] + np.arange(self.k)).ravel()]  # each has k rows at least
        self.dst[old], self.sim[old] = dst[keep].reshape(-1, self.k), sim[keep].reshape(-1, self.k)

    def result(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for t in range(0, len(self.x), 1024):
            sim, dst = self.sim[t : t + 1024], self.dst[t : t + 1024]
            keep = np.isfinite(sim)
            rank = np.broadcast_to(np.arange(1, self.k + 1, dtype=np.int32), sim.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids[t : t + 1024], keep.sum(axis=1))), pa.array(dst[keep]), pa.array(sim[keep]), pa.array(rank[keep])], names=["src", "dst", "sim", "rank"])


def _search(rows: DataFrame, k: int, id_type: str, centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """``(src, dst, sim, rank)`` of ``rows(id, v, cell)``, within the ``probes`` nearest cells if there are ``centres``.

    The vectors that ask are dealt over PARTS tasks, each of which sees all vectors once, a batch at
    a time. So PARTS copies of the table are moved, whatever its size, and a task holds its own part
    and the best k of each; only beyond PARTS * MOST_OWN vectors there are more parts.
    """
    n = rows.count()
    parts = max(1, min(n, PARTS), -(-n // MOST_OWN))
    # Numbers that the hash of a shuffle deals to one partition each.
    found = rows.sparkSession.range(64 * parts + 64).select(F.pmod(F.hash("id"), F.lit(parts)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id")).collect()
    places = sorted(r.id for r in found)
    own = F.element_at(F.array(*[F.lit(p) for p in places]), (F.pmod(F.xxhash64("id"), F.lit(len(places))) + 1).cast("int"))
    dealt = rows.withColumn("own", own).withColumn("part", F.explode(F.array(*[F.lit(p) for p in places])))
    # The vectors that ask come first, then all others and these again.
    dealt = dealt.withColumn("asks", F.explode(F.when(F.col("own") == F.col("part"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    dealt = dealt.select("part", "asks", "cell", "id", "v").repartition(parts, "part").sortWithinPartitions("part", F.desc("asks"), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asking, near, asked = None, [], None, None

        def begin() -> None:
            nonlocal near, asked
            ids, x = (np.concatenate(c) for c in zip(*asking, strict=True))
            asking.clear()
            near = _Nearest(ids, x, k)
            if centres is not None:
                asked = np.zeros((len(ids), len(centres)), bool)
                np.put_along_axis(asked, _nearest_cells(x, centres, probes), True, axis=1)

        for b in batches:
            if not b.num_rows:
                continue
            places, asks, cells = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "asks", "cell"))
            ids, v = b.column("id").to_numpy(), b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            new = (places[1:] != places[:-1]) | (asks[1:] != asks[:-1]) | (cells[1:] != cells[:-1]) & (centres is not None)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if places[i] != part:
                    if near is not None:
                        yield from near.result()
                    part, near = places[i], None
                if asks[i]:
                    asking.append((ids[i:j], v[i:j]))
                    continue
                if asking:
                    begin()
                if near is not None:
                    rows = np.arange(len(near.ids)) if centres is None else np.flatnonzero(asked[:, cells[i]])
                    for y in range(i, j, BLOCK):
                        near.meet(rows, ids[y : min(y + BLOCK, j)], v[y : min(y + BLOCK, j)])
        if near is not None:
            yield from near.result()

    return dealt.mapInArrow(run, f"src {id_type}, dst {id_type}, sim double, rank int")


def _nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the ``n`` centres nearest to each vector, the nearest first."""
    out = np.empty((len(x), min(n, len(centres))), np.int32)
    for t in range(0, len(x), 1024):
        out[t : t + 1024] = ((centres**2).sum(axis=1) - 2 * (x[t : t + 1024] @ centres.T)).argsort(axis=1, kind="stable")[:, :n]
    return out


def knn_exact(df: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(src, dst, sim, rank)``: the k nearest of each vector by inner product, itself left out by id.

    All vectors are compared, as exact search does, but what is moved and written grows with
    the vectors alone; nothing is broadcast. Ties go to the lesser id.
    """
    rows = df.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"), F.lit(0).alias("cell"))
    return _search(rows, k, df.schema[key].dataType.simpleString())


def knn_ivf(df: DataFrame, k: int, cells: int, probes: int, key: str = "vec_id", column: str = "embedding", seed: int = 42) -> DataFrame:
    """As `knn_exact`, but within the cells of k-means nearest to a vector.

    There are ``cells`` of them, or the square root of the number of vectors if that is more, up to
    MOST_CELLS; but 40 vectors for each. Of them the part ``probes / cells`` is searched. A task sees
    the vectors cell by cell and compares each cell with those that ask for it.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    part = probes / cells
    cells = max(1, min(max(cells, math.isqrt(n)), MOST_CELLS, n // 40 or 1))
    probes = max(1, math.ceil(part * cells))
    points = df.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).withColumn("features", array_to_vector("v"))
    centres = np.array(KMeans(k=cells, seed=seed, featuresCol="features").fit(points).clusterCenters()) if n else np.zeros((1, 1))

    @F.pandas_udf(IntegerType())
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest_cells(np.stack(v.to_list()), centres, 1)[:, 0] if len(v) else np.zeros(0, np.int32))

    return _search(points.select("id", "v", cell("v").alias("cell")), k, df.schema[key].dataType.simpleString(), centres, probes)


def knn_edges(knn: DataFrame, mutual: bool = False) -> DataFrame:
    """``(src, dst, sim)``, src < dst, of neighbours in either direction, or in both if ``mutual``."""
    both = knn.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("sim").alias("sim"), F.count(F.lit(1)).alias("n"))
    return (both.where("n = 2") if mutual else both).drop("n")
