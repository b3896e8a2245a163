"""Readers, caches and sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolophon.runtime import Scratch, scratch_root, with_global_index

LABELLED = "id string, verse string, idgroup string, idoriginal_poem string, type_id string"
CORPUS = "verse string, idoriginal_poem string, source_dataset string"
#: No text has more lines than it may have bytes, so line numbers are unique; one beyond a long is an error.
LINES_PER_DOCUMENT = 1 << 31


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_verses(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A verse table from CSV, with all ids as strings; nulls stay nulls. Columns go by their cleaned names."""
    raw = clean_names(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    wanted = T.StructType.fromDDL(schema)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*[F.trim((F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType)).alias(f.name) for f in wanted.fields])


def verse_lines(verses: DataFrame, scratch: Scratch) -> DataFrame:
    """``(line_id, doc_id, source, text, ...)`` of a verse table, as the pipelines want it: a row is a line.

    ``line_id`` is a gapless number in the order of id, if there is one, then poem and verse; ``doc_id``
    is the poem's id, a string. ``source`` is null where the table has none; idgroup and type_id stay.
    """
    has = lambda c: F.col(c) if c in verses.columns else F.lit(None).cast("string")
    rows = verses.select(has("id").alias("id"), F.col("idoriginal_poem").alias("doc_id"), has("source_dataset").alias("source"), F.col("verse").alias("text"), has("idgroup").alias("idgroup"), has("type_id").alias("type_id"))
    order = [F.length("id"), F.col("id"), F.col("doc_id"), F.col("text")]
    return scratch.save(with_global_index(scratch, rows, order, index="line_id"), "lines").drop("id")


def source_identity(spark: SparkSession, path: str) -> str:
    """What changes when the files below a path are written anew: their names, lengths and times."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return "none"
    found = fs.listFiles(place, True)
    files = []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(files)).encode()).hexdigest()


def document_lines(docs: DataFrame) -> DataFrame:
    """``(line_id, doc_id, pos, source, text)``: a row for each line of ``documents``; null texts have none."""
    rows = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.select((F.col("doc_id") * LINES_PER_DOCUMENT + F.col("pos")).alias("line_id"), "doc_id", "pos", "source", "text")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class TableCache:
    """Results by what they depend on: a configuration and the identity of the input, never a name alone."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{scratch_root(spark)}/cache"
        self._here: dict[str, DataFrame] = {}

    @staticmethod
    def fingerprint(df: DataFrame) -> str:
        """An order-independent hash of all rows."""
        row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns)), F.bit_xor(F.xxhash64(F.lit(1), *df.columns))).first()
        return "-".join(map(str, row))

    def get(self, key: tuple, compute: Callable[[], DataFrame]) -> DataFrame:
        name = hashlib.sha256(repr(key).encode()).hexdigest()[:24]
        if name not in self._here:
            path = f"{self.folder}/{name}"
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
            if not there:
                compute().write.mode("overwrite").parquet(path)
            self._here[name] = self.spark.read.parquet(path)
        return self._here[name]


def write_pairs(pairs: DataFrame, path: str) -> None:
    """doc_a, doc_b, jaccard as CSV, most similar first."""
    pairs.select("doc_a", "doc_b", "jaccard").orderBy(F.desc("jaccard"), "doc_a", "doc_b").write.mode("overwrite").option("header", True).csv(path)


def write_groups(groups: DataFrame, path: str) -> None:
    groups.orderBy(F.desc("size"), "group_id").write.mode("overwrite").parquet(path)


def pivot_heatmap(sweep: DataFrame, metric: str) -> DataFrame:
    """The table behind a heat map: thresholds by shingle sizes."""
    return sweep.groupBy("threshold").pivot("k").agg(F.first(metric)).orderBy("threshold")
