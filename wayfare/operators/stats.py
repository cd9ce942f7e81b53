"""Statistics of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import weight_bucket


def attribute(edges: DataFrame) -> DataFrame:
    """n (one more than the greatest id), m, and a third of the average degree."""
    n, m = F.max(F.greatest("src", "dst")) + 1, F.count("*")
    return edges.agg(n.alias("n"), m.alias("m"), (m / n / F.lit(3.0)).alias("avg_degree_div3"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("deg"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("deg"))


def out_weight(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("w").alias("total"))


def max_out_weight(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.max("w").alias("max_w"))


def total_volume(edges: DataFrame) -> DataFrame:
    return edges.agg(F.sum("w").alias("volume"))


def dangling_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that edges lead to and none leaves."""
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def bucket_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", weight_bucket(F.col("w")).alias("bucket")).agg(F.count("*").alias("cnt"))


def max_bucket(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.max(weight_bucket(F.col("w"))).alias("max_bucket"))


def bucket_bitmap(edges: DataFrame) -> DataFrame:
    """For each source, the sum of 2**bucket over its buckets, which are 0 to 31."""
    one = F.expr("bit_or(shiftleft(1L, __b))")
    return edges.select("src", weight_bucket(F.col("w")).alias("__b")).groupBy("src").agg(one.alias("bitmap"))


def bucket_capacity(edges: DataFrame) -> DataFrame:
    """The room that a fixed-size layout keeps for a bucket: half as many again as it has, or a fifth over the mean."""
    histogram = bucket_histogram(edges)
    per_source = histogram.groupBy("src").agg(F.sum("cnt").alias("deg"), F.count("*").alias("n"))
    even = F.floor(F.ceil(F.col("deg") / F.col("n")) * F.lit(1.2)).cast("long")
    room = F.greatest(F.ceil(F.lit(1.5) * F.col("cnt")).cast("long"), even)
    return histogram.join(per_source, "src").select("src", "bucket", "cnt", room.alias("capacity"))


def validate(edges: DataFrame) -> DataFrame:
    """Edges that bucketed indexes with buckets 0 to 31 cannot hold: weights outside (0.5, 2**31], or nulls."""
    return edges.filter("src is null or dst is null or w is null or w <= 0.5 or w > 2147483648")
