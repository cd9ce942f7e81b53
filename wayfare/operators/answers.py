"""Orders, limits and set operations on answers (query_id, node, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.plans.ordered import in_ranges, running


def greatest_first() -> list[Column]:
    return [F.desc("p"), F.desc("node")]


def ranked(answer: DataFrame) -> DataFrame:
    """answer with rank: 1 for the greatest (p, node) of each query.

    Ranks are counted inside ranges of the order and carried from range to range, so an answer may have any number of
    nodes.
    """
    placed = in_ranges(answer, [F.col("query_id"), *greatest_first()], "ranked")
    return running(placed, ["query_id"], F.col("__range"), greatest_first(), {"rank": F.lit(1).cast("long")}).drop("__range")


def top_k(answer: DataFrame, k: int) -> DataFrame:
    """The k greatest of each query, with rank; each task passes on k of a query at most."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*greatest_first()))
    return answer.withColumn("rank", rank).filter(F.col("rank") <= k)


def support_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("query_id", "node").union(b.select("query_id", "node")).distinct()


def support_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that a has and b doesn't."""
    return a.select("query_id", "node").join(b.select("query_id", "node"), ["query_id", "node"], "left_anti")


def topk_intersection(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    return top_k(a, k).select("query_id", "node").join(top_k(b, k).select("query_id", "node"), ["query_id", "node"], "left_semi")


def reached_count(answer: DataFrame) -> DataFrame:
    return answer.groupBy("query_id").agg(F.count("*").alias("reached"))
