"""Fusion of ranked lists, diversity, reranking and hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60


def rrf(lists: list[DataFrame], constant: int = RRF_K) -> DataFrame:
    """(query_id, id, score): the sum of 1 / (constant + rank) over lists(query_id, id, rank), ranks from 1."""
    both = lists[0].select("query_id", "id", "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select("query_id", "id", "rank"))
    return both.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scores.withColumn("rank", F.row_number().over(order))


def cap_per_group(hits: DataFrame, group: str, cap: int, k: int) -> DataFrame:
    """The first k of hits(query_id, rank, group) by rank, of each group the first `cap` only; 0 caps nothing."""
    kept = hits
    if cap:
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))).filter(F.col("_n") <= cap).drop("_n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("position") <= k)


def rerank(hits: DataFrame, pool: int, score) -> DataFrame:
    """hits(query_id, id, rank, score, ...) with the first `pool` of each query reordered by a score column; the rest follow as they were."""
    new = hits.withColumn("_pool", F.col("rank") <= pool).withColumn("score", F.when(F.col("_pool"), score).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.col("_pool").desc(), F.when(F.col("_pool"), F.round("score", 9)).desc(), "rank")
    return new.withColumn("new_rank", F.row_number().over(order)).drop("_pool")


def overlap_score(query_words, text_words):
    """The offline reranker: the share of the query's distinct words that the text holds."""
    asked = F.array_distinct(query_words)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, text_words)) / F.size(asked)).otherwise(F.lit(0.0))


def hydrate(hits: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the hits, late: only the hits' columns were carried until here. Hits without a row are left out."""
    return rows.join(hits, key)
