"""The exact distribution of a walk's endpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.plans.storage import bucketed, materialize
from wayfare.sources.parts import PartedGraph


def power_step(state: DataFrame, edges: DataFrame, totals: DataFrame) -> DataFrame:
    """One step of state (query_id, node, p): all mass moves along edges (src, dst, w); at dangling nodes it is lost.

    totals (src, total) has the weight that leaves each source.  Parallel edges need no merging, as masses add up.
    """
    shared = state.join(totals, F.col("node") == F.col("src")).select("query_id", "src", (F.col("p") / F.col("total")).alias("__unit"))
    moved = shared.join(edges.select("src", "dst", "w"), "src")
    return moved.groupBy("query_id", F.col("dst").alias("node")).agg(F.sum(F.col("__unit") * F.col("w")).alias("p"))


def power_method(edges: DataFrame, queries: DataFrame, length: int, cut_every: int = 8, written: bool = False) -> DataFrame:
    """answer (query_id, node, p) of queries (query_id, u) after exactly `length` steps; all queries in one plan.

    For more than one step the edges are written once, in buckets by src, so that a step moves the state alone: totals
    and edges are where it moves to.  A single step writes the edges of its sources alone.  The lineage is cut every
    cut_every steps by a written table.  written says that edges are in buckets already.
    """
    edges = edges.select("src", "dst", "w")
    if length > 1 and not written:
        edges = bucketed(edges, ["src"], "edges")
    elif length == 1:
        edges = materialize(edges.join(queries.select(F.col("u").alias("src")).distinct(), "src", "left_semi"), "edges-at-hand")
    totals = edges.groupBy("src").agg(F.sum("w").alias("total"))
    if length > 1:
        totals = bucketed(totals, ["src"], "totals")
    state = queries.select("query_id", F.col("u").alias("node"), F.lit(1.0).alias("p"))
    for k in range(1, length + 1):
        state = power_step(state, edges, totals)
        if k % cut_every == 0 and k < length:
            state = materialize(state, "power")
    return state.filter("p > 0")


def parted_power(graph: PartedGraph, queries: DataFrame, length: int) -> DataFrame:
    """As power_method, over a graph in parts: a step reads the parts that its nodes fall into, and nothing is built.

    The state is written down before each step, as it says what the step reads.
    """
    state = queries.select("query_id", F.col("u").alias("node"), F.lit(1.0).alias("p"))
    for _ in range(length):
        state = materialize(state, "frontier")
        state = power_step(state, *graph.at(state))
    return state.filter("p > 0")
