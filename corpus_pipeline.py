"""A corpus pipeline: language ID, line dedup, n-gram join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kolophon.llm.language_id import UNKNOWN, fit, identify_language
from kolophon.llm.line_dedup import line_dedup
from kolophon.llm.mixing import mix_sources
from kolophon.llm.ngram_join import ngram_join
from kolophon.llm.packing import best_fit_packing
from kolophon.runtime import Scratch, ship_package

#: A text is rejected if less than this share of its letters is labelled with any language.
LEAST_SCORE = 0.05


def _aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns renamed that have one of ``names``, and the columns to select in the end."""
    new = {c: f"_aside{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(new), [F.col(new.get(c, c)).alias(c) for c in docs.columns]


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart: doc_id if it does, else a number that is written with them."""
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs, "doc_id"
    return Scratch(docs.sparkSession, "numbered").save(docs.withColumn("_row_number", F.monotonically_increasing_id())), "_row_number"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those that none of the languages of labelled rows fits.

    A text in several languages is kept. A document kept without a language gets the one found.
    Null and repeated doc_ids do not matter; of an empty table, or one without a labelled row,
    nothing is left.
    """
    docs, columns = _aside(docs, {"lang_pred", "score", "spans", "known"})
    found = identify_language(docs, fit(docs), spans=False, known=True)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are kept in another document; one left blank goes.

    A row without doc_id keeps its lines, as does an empty table its emptiness; rows that repeat
    a doc_id are one document.
    """
    docs, columns = _aside(docs, {"kept_text", "n_lines", "n_dropped", "_found", "_found_id"})
    done = line_dedup(docs).withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})
    return done.where("n_dropped = 0 OR kept_text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join one row, with the least doc_id; one without doc_id only if none has any.

    Where doc_ids are null or repeat, each row is a document of its own. A null or blank text
    links with nothing and stays. Of an empty table nothing is left.
    """
    docs, columns = _aside(docs, {"_row_number"})
    docs, row = _numbered(docs)
    found = ngram_join(docs.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    if row == "doc_id":
        stay = found.where("row = component_id").select("row")
    else:
        named = found.join(docs.select(F.col(row).alias("row"), "doc_id"), "row")
        stay = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")).select("least.row")
    return docs.join(stay, docs[row] == stay["row"], "left_semi").select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Each row is drawn for itself, with or without a doc_id. Of an empty table nothing is left.
    """
    docs, columns = _aside(docs, {"row", "copies", "_copy", "_row_number"})
    docs, row = _numbered(docs)
    drawn = mix_sources(docs, row=row).where("copies > 0").select("row", "copies")
    taken = docs.join(drawn, docs[row] == drawn["row"])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in token sequences.

    Each row is a document of its own, with or without a doc_id; a null text is empty. An empty
    table has no pieces.
    """
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("ngram_join", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Language scores, draws and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before it wrote."""
    ship_package(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
