"""The thin ``opN_<name>`` queries and, where SQL can say the same, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kolophon.llm import oracles
from kolophon.llm.embedding_dedup import embedding_near_dedup
from kolophon.llm.fingerprints import fingerprint_documents
from kolophon.llm.html_extraction import extract_main_text
from kolophon.llm.language_id import fit, identify_language
from kolophon.llm.line_dedup import line_dedup
from kolophon.llm.mixing import mix_sources
from kolophon.llm.ngram_join import ngram_join
from kolophon.llm.packing import best_fit_packing
from kolophon.llm.sharding import shard_documents
from kolophon.llm.substrings import substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document, by the CRC of its number as text; no number, not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(docs.where("NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL"))
    return identify_language(docs.select("doc_id", "held_out", "text"), model, spans=False).select("doc_id", "held_out", "lang_pred", "score")


def op2_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix_sources(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "source_size", "target", "taken")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_cube_mixing": op2_cube_mixing,
    "op3_sharding": op3_sharding,
    "op4_ngram_join": op4_ngram_join,
    "op5_html_extraction": op5_html_extraction,
    "op6_line_dedup": op6_line_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_join": oracles.NGRAM_JOIN,
    "op6_line_dedup": oracles.LINE_DEDUP,
    "op9_substring_dedup": oracles.SUBSTRINGS,
    "op10_embedding_near_dedup": oracles.EMBEDDINGS,
}
