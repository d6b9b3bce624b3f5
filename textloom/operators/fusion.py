"""Rank fusion, candidate merging and pruning over (query_id, id, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.lexical import top

RRF_K = 60
RELATIVE = 0.5
CANDIDATES = 40
HOP_CREDIT = 0.5


def reciprocal_rank(lists: DataFrame) -> DataFrame:
    """(query_id, id, score): the sum of 1 / (60 + rank) over the lists (query_id, id, rank from 1) that hold an id."""
    return lists.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))


def merge_variants(scored: DataFrame) -> DataFrame:
    """The best score of an id over a query's variants."""
    return scored.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def merge_graph(hybrid: DataFrame, graph: DataFrame) -> DataFrame:
    """Graph scores times the query's best hybrid score join the hybrid ones by maximum; none for a query without any."""
    best = hybrid.groupBy("query_id").agg(F.max("score").alias("best"))
    scaled = graph.join(best, "query_id").select("query_id", "id", (F.col("score") * F.col("best")).alias("score"))
    return merge_variants(hybrid.select("query_id", "id", "score").union(scaled))


def relative_threshold(scored: DataFrame, share: float = RELATIVE) -> DataFrame:
    """Rows with at least ``share`` of their query's best score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("_best", best).filter(F.col("score") >= share * F.col("_best")).drop("_best")


def cap(scored: DataFrame, texts: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The best ``n`` rows of a query that have a text in ``texts`` (id, text)."""
    return top(scored, n).join(texts, "id")
