"""Updates of a graph and of its indexes, workloads of updates and queries.

An update is a batch: deletes are an anti-join by key and occurrence, inserts a union; index rows are recomputed for
the touched sources and joined with the others' rows as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.columns import rng
from wayfare.operators.indexes import cell
from wayfare.plans.ordered import in_ranges, spread
from wayfare.plans.storage import materialize


class MissingEdges(ValueError):
    """Edges to be deleted do not exist."""


def missing_keys(edges: DataFrame, deletes: DataFrame) -> DataFrame:
    """src, dst of deletes for which edges has no edge, or fewer than are to go."""
    asked = deletes.groupBy("src", "dst").agg(F.count("*").alias("asked"))
    there = edges.join(asked.select("src", "dst"), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.count("*").alias("there"))
    return asked.join(there, ["src", "dst"], "left").filter(F.coalesce("there", F.lit(0)) < F.col("asked")).select("src", "dst")


def delete(edges: DataFrame, deletes: DataFrame) -> DataFrame:
    """edges without one edge for each row of deletes (src, dst); of parallel edges the heaviest go first.

    Only edges that deletes name are numbered; the others stay where they are.
    """
    asked = deletes.groupBy("src", "dst").agg(F.count("*").alias("__asked"))
    named = edges.join(asked, ["src", "dst"])
    nth = F.row_number().over(W.partitionBy("src", "dst").orderBy(F.desc("w")))
    left = named.withColumn("__nth", nth).filter(F.col("__nth") > F.col("__asked")).select(*edges.columns)
    return edges.join(asked, ["src", "dst"], "left_anti").unionByName(left)


def insert(edges: DataFrame, inserts: DataFrame) -> DataFrame:
    return edges.unionByName(inserts.select(*edges.columns))


def apply(edges: DataFrame, deletes: DataFrame, inserts: DataFrame, check: bool = True) -> DataFrame:
    """edges after the deletes and then the inserts; with check, deletes of edges that don't exist are an error."""
    if check:
        absent = missing_keys(edges, deletes).limit(10).collect()
        if absent:
            raise MissingEdges(f"no such edges: {[(r.src, r.dst) for r in absent]}")
    return insert(delete(edges, deletes), inserts)


def touched(*ops: DataFrame) -> DataFrame:
    """The sources that ops change."""
    out = ops[0].select("src")
    for other in ops[1:]:
        out = out.union(other.select("src"))
    return out.distinct()


def refresh(index: DataFrame, edges: DataFrame, sources: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """index, of which the rows of sources (src) are built anew from edges."""
    return index.join(sources, "src", "left_anti").unionByName(build(edges.join(sources, "src", "left_semi")))


def generate_ops(edges: DataFrame, num: int, seed: str = "ops") -> DataFrame:
    """seq, src, dst, w: num edges, different by (src, dst), of sources with more than one edge.

    A source drawn by degree and a uniform neighbour of it are a uniform edge; so the first num edges in a random
    order are what drawing and leaving out repetitions gives.  Of parallel edges the heaviest stands for all, which is
    the one that delete takes.  With fewer eligible edges, all of them.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("deg")).filter("deg > 1").select("src")
    once = edges.join(degree, "src", "left_semi").groupBy("src", "dst").agg(F.max("w").alias("w"))
    chosen = once.withColumn("r", rng(seed, F.col("src"), F.col("dst"))).orderBy("r", "src", "dst").limit(num)
    return chosen.select((F.row_number().over(W.orderBy("r", "src", "dst")) - 1).cast("long").alias("seq"), "src", "dst", "w")


def generate_queries(edges: DataFrame, num: int, seed: str = "queries") -> DataFrame:
    """query_id, u: num sources drawn by out-degree, with replacement: the sources of uniform edges.

    A draw is a place among all edges in order of source.  It falls into a range of sources by the ranges' totals, then
    to a source by the sources' running degrees inside the range.  Both are found by equal cells: what owns a stretch of
    places is listed in the cells that it reaches into, at most twice as many as there are owners, and a draw looks
    into its own.  No edge is numbered, and draws move to the sources that they fall to.
    """
    degree = in_ranges(edges.groupBy("src").agg(F.count("*").alias("deg")), [F.col("src")], "degrees")
    totals = degree.groupBy("__range").agg(F.sum("deg").alias("size"), F.count("*").alias("owners"))
    upper = F.sum("size").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, 0))
    totals = materialize(totals.select("__range", "owners", upper.alias("hi"), (upper - F.col("size")).alias("lo")), "range-totals")
    whole = totals.agg(F.max("hi").alias("m"), F.count("*").alias("n")).first()
    if not whole.m:
        return edges.sparkSession.range(0).select(F.col("id").alias("query_id"), F.col("id").alias("u"))
    ranges = _guided(totals, F.lit(whole.m), F.lit(whole.n), "cell")
    draws = edges.sparkSession.range(num).select(F.col("id").alias("query_id"), F.floor(rng(seed, F.col("id")) * whole.m).alias("at"))
    draws = draws.withColumn("cell", cell(F.col("at"), F.lit(whole.m), F.lit(whole.n))).join(ranges, "cell").filter("at >= lo and at < hi")
    size = F.col("size")
    draws = draws.select("query_id", "__range", (F.col("at") - F.col("lo")).alias("at"), (F.col("hi") - F.col("lo")).alias("size"), "owners").withColumn("cell", cell(F.col("at"), size, F.col("owners")))
    run = W.partitionBy("__range").orderBy("src").rowsBetween(W.unboundedPreceding, 0)
    sources = degree.withColumn("hi", F.sum("deg").over(run)).withColumn("lo", F.col("hi") - F.col("deg"))
    sources = sources.join(totals.select("__range", "owners", (F.col("hi") - F.col("lo")).alias("size")), "__range")
    owners = _guided(sources, size, F.col("owners"), "cell").select("__range", "cell", "src", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    met = draws.join(owners, ["__range", "cell"]).filter("at >= __lo and at < __hi")
    return met.select("query_id", F.col("src").alias("u"))


def _guided(owners: DataFrame, whole: Column, many: Column, name: str) -> DataFrame:
    """owners (lo, hi, ...) in each of `many` equal cells of [0, whole) that they reach into."""
    return spread(owners, cell(F.col("lo"), whole, many), cell(F.col("hi"), whole, many), name)


def max_queries(edges: DataFrame, num: int) -> DataFrame:
    """query_id, u: the sources of greatest degree; of ties the smaller ids."""
    degree = edges.groupBy("src").agg(F.count("*").alias("deg")).orderBy(F.desc("deg"), "src").limit(num)
    return degree.select((F.row_number().over(W.orderBy(F.desc("deg"), "src")) - 1).cast("long").alias("query_id"), F.col("src").alias("u"), "deg")


def update_overhead(values: DataFrame, baseline: str) -> DataFrame:
    """label, algo, seconds, overhead, memory, memory_overhead of (label, algo, kind, value).

    seconds is the mean of the delete and insert times, memory that of the memory lines; overheads are what they have
    over those of the algorithm `baseline` on the same label.
    """
    mean = values.groupBy("label", "algo").agg(
        F.avg(F.when(F.col("kind").isin("delete", "insert"), F.col("value"))).alias("seconds"),
        F.avg(F.when(F.col("kind") == "memory", F.col("value"))).alias("memory"),
    )
    base = mean.filter(F.col("algo") == baseline).select("label", F.col("seconds").alias("__s"), F.col("memory").alias("__m"))
    return mean.join(base, "label").select(
        "label", "algo", "seconds", (F.col("seconds") - F.col("__s")).alias("overhead"), "memory", (F.col("memory") - F.col("__m")).alias("memory_overhead")
    )


#: The metrics that a series can show.
METRICS = ("precision", "conductance", "max_ae")


def metric_series(runtimes: DataFrame, errors: DataFrame, first: int = 5, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """algo, label, L, eps_idx, avg_sec, metric, value: each metric against run time, for the first few values of eps."""
    key = ["algo", "label", "L", "eps_idx"]
    joined = runtimes.join(errors, key).filter(F.col("eps_idx") < first)
    pairs = F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value")
    return joined.select(*key, "avg_sec", pairs)


def precision_points(runtimes: DataFrame, errors: DataFrame, overheads: DataFrame, eps: DataFrame) -> DataFrame:
    """algo, label, query_sec, update_overhead, precision at the eps_idx that eps (label, eps_idx) chooses for each label."""
    chosen = runtimes.join(errors, ["algo", "label", "L", "eps_idx"]).join(eps, ["label", "eps_idx"])
    return chosen.join(overheads.select("algo", "label", "overhead"), ["algo", "label"]).select(
        "algo", "label", F.col("avg_sec").alias("query_sec"), F.col("overhead").alias("update_overhead"), "precision"
    )
