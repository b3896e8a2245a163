"""Row filters, deduplication and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kolophon.config import LineFilter, Quality
from kolophon.functions import text as T


def line_predicate(clean: Column, rule: LineFilter) -> Column:
    """Native, so that it goes below hashing and shuffles."""
    words = T.once(T.word_count(clean), lambda n: n.between(rule.min_words, rule.max_words))
    keep = (F.length(clean) >= rule.min_chars) & words
    return keep & T.is_script(clean, rule.script) if rule.script else keep


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys the first; a partial aggregate, so a hot key is no hot task."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    on = [df[k].eqNullSafe(first[k]) for k in keys] + [F.struct(*[df[o] for o in order]) == first["_first"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(first, cond, "left_semi")


def sized_documents(lines: DataFrame, low: int, high: int) -> DataFrame:
    """``(doc_id, source, n_lines)`` of documents with so many lines; null documents have none."""
    return lines.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines").between(low, high))


def degenerate(n_clusters: Column, nsr: Column, max_size: Column, n: Column, q: Quality | None = None) -> Column:
    q = q or Quality()
    return (n_clusters < q.min_clusters) | (nsr > q.max_nsr) | (max_size > q.max_share * n)


def without_degenerate(sweep: DataFrame) -> DataFrame:
    """Rows that are not degenerate; all, if all are."""
    n = F.sum(F.when(~F.col("degenerate"), 1).otherwise(0)).over(W.partitionBy())
    return sweep.withColumn("_good", n).where(~F.col("degenerate") | (F.col("_good") == 0)).drop("_good")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
