"""A graph written in parts by a hash of the source, so that a step reads the edges of its frontier alone."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a graph, and the nodes of a frontier that are named one by one to the scan.
PARTS, FEW = 256, 10


def part_of(node: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(node.cast("long"), F.lit("part")), F.lit(parts)).cast("int")


@dataclass
class PartedGraph:
    """edges (src, dst, w, part) and totals (src, total, part), one folder for each part."""

    edges: DataFrame
    totals: DataFrame
    parts: int

    def at(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """edges (src, dst, w) and totals (src, total) of the parts that nodes (node) fall into; others are not read.

        What comes to the driver are the numbers of these parts.  A frontier of FEW nodes is handed to the scan besides,
        which then skips the row groups of its parts that have none of them, as parts are sorted by src.  More rows than
        the nodes' own can come back, never fewer; nodes is read twice and so should be a written table.
        """
        met = [r.part for r in nodes.select(part_of(F.col("node"), self.parts).alias("part")).distinct().collect()]
        inside = F.col("part").isin(met)
        few = [r.node for r in nodes.select("node").distinct().limit(FEW + 1).collect()]
        if len(few) <= FEW:
            inside = inside & F.col("src").isin(few)
        return self.edges.filter(inside).drop("part"), self.totals.filter(inside).drop("part")


def write_parts(edges: DataFrame, path: str, parts: int = PARTS) -> None:
    """edges (src, dst, w), with the weight that leaves each source, in parts at path, replacing what is there.

    Tasks hold ranges of (part, src, dst), so a hub's edges are cut over several of them, and a task writes a few files.
    The number of parts is written last.
    """
    for name, rows, order in (
        ("edges", edges.select("src", "dst", "w"), ["src", "dst"]), ("totals", edges.groupBy("src").agg(F.sum("w").alias("total")), ["src"]),
    ):
        dealt = rows.withColumn("part", part_of(F.col("src"), parts)).repartitionByRange("part", *order)
        dealt.sortWithinPartitions("part", *order).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")
    line = edges.sparkSession.createDataFrame([(json.dumps({"parts": parts}),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/about")


def open_parts(spark: SparkSession, path: str) -> PartedGraph:
    """What write_parts wrote at path."""
    parts = json.loads(spark.read.text(f"{path}/about").first().value)["parts"]
    read = lambda name, schema: spark.read.schema(f"{schema}, part int").parquet(f"{path}/{name}")
    return PartedGraph(read("edges", "src long, dst long, w double"), read("totals", "src long, total double"), parts)
