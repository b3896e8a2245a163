"""Shared scratch tables and distributed ranks.

Iterative operators cut their lineage by writing a table to the folder that all
machines share (``spark.checkpoint.dir``) and reading it back, so a lost executor
costs a re-read, not a recomputation.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this application.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset and all runs in
    one process, as in tests, a temporary folder of the machine is chosen and recorded.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="kolophon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/kolophon-{sc.applicationId}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers that would not find it themselves."""
    home = Path(__file__).resolve().parent
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and Path(p, home.name).resolve() == home for p in paths) or getattr(spark.sparkContext, "_kolophon_shipped", False):
        return
    # The driver serves the file from this place until the application ends.
    target = Path(tempfile.mkdtemp(prefix="kolophon-"), f"{home.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in home.rglob("*.py"):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._kolophon_shipped = True


class Scratch:
    """Tables that one operator call writes; superseded ones are dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df``, forget its lineage and its shuffle files, and read it back."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._kolophon_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._kolophon_path)
            path.getFileSystem(conf).delete(path, True)


def with_global_index(
    scratch: Scratch,
    df: DataFrame,
    order: Sequence[Column],
    group: str | None = None,
    index: str = "idx",
    weight: str | None = None,
    before: str = "weight_before",
) -> DataFrame:
    """Add a gapless 0-based index in ``order`` (within ``group`` if given).

    No single-task window: rows are range partitioned and sorted, each partition counts
    its own rows per group, and the small table of partition totals gives every partition
    its start. With ``weight``, ``before`` is the sum of that column over earlier rows.
    """
    keys = ([F.col(group).asc()] if group else []) + list(order)
    part = scratch.save(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()),
        "ranged",
    )
    part = part.withColumn("_p", F.shiftright("_m", 33))
    by = ["_p"] + ([group] if group else [])
    from pyspark.sql import Window as W

    w = F.col(weight) if weight else F.lit(0).cast("long")
    totals = part.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"), F.min("_m").alias("_m0"))
    # A row per partition and group: few rows, so one ordered window over them is cheap.
    run = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    if group:
        run = W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *by, "_m0", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_start"), F.coalesce(F.sum("_w").over(run), F.lit(0)).alias("_w_start")
    )
    cond = part["_p"] == starts["_p"]
    if group:
        cond = cond & part[group].eqNullSafe(starts[group])
    out = part.join(starts, cond).drop(starts["_p"])
    if group:
        out = out.drop(starts[group])
    out = out.withColumn(index, (F.col("_start") + F.col("_m") - F.col("_m0")).cast("long"))
    if weight:
        local = W.partitionBy(*by).orderBy("_m").rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn(before, (F.col("_w_start") + F.coalesce(F.sum(w).over(local), F.lit(0))).cast("long"))
    return out.drop("_m", "_p", "_m0", "_start", "_w_start")
