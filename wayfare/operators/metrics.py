"""How good an approximate answer is: all queries at once, by joins and windows in each query.

answer and truth are (query_id, node, p); nodes that one of them lacks have p = 0 there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.operators.answers import ranked, top_k
from wayfare.plans.ordered import running
from wayfare.plans.storage import materialize


#: Ranks that one task sums up.
RANKS = 1 << 16


def _matched(answer: DataFrame, truth: DataFrame) -> DataFrame:
    mine = answer.select("query_id", "node", F.col("p").alias("a"))
    exact = truth.select("query_id", "node", F.col("p").alias("t"))
    both = mine.join(exact, ["query_id", "node"], "full").fillna(0.0, ["a", "t"])
    return both.withColumn("off", F.abs(F.col("a") - F.col("t")))


def l1_error(answer: DataFrame, truth: DataFrame) -> DataFrame:
    return _matched(answer, truth).groupBy("query_id").agg(F.sum("off").alias("l1"))


def max_additive_error(answer: DataFrame, truth: DataFrame, decimals: int = 12) -> DataFrame:
    """query_id, max_ae, node, a, t: the greatest difference, to some decimals, and where it is.

    Of ties the first counts, in the order: answered nodes by (p, node) falling, then nodes of the truth alone by node
    rising.  Without any difference there is no node.
    """
    mine = answer.select("query_id", "node", F.col("p").alias("a"), F.lit(True).alias("answered"))
    both = mine.join(truth.select("query_id", "node", F.col("p").alias("t")), ["query_id", "node"], "full").fillna(0.0, ["a", "t"]).fillna(False, ["answered"])
    off = F.round(F.abs(F.col("a") - F.col("t")), decimals).alias("off")
    order = F.when(F.col("answered"), F.col("node")).otherwise(-F.col("node")).alias("order")
    best = both.groupBy("query_id").agg(F.max(F.struct(off, "answered", "a", order, "node", "t")).alias("m"))
    of_most = lambda c: F.when(F.col("m.off") > 0, F.col(f"m.{c}")).alias(c)
    return best.select("query_id", F.col("m.off").alias("max_ae"), *map(of_most, ("node", "a", "t")))


def precision_at_k(answer: DataFrame, truth: DataFrame, n: int, k: int = 50) -> DataFrame:
    """query_id, precision: how many of the answer's top k are among the truth's, of k.

    With fewer than k true nodes it is 1.  Ties at the truth's k-th place all count.  Nodes are 0 to n - 1; an answer
    of fewer than k of them is filled up with the smallest ids that it lacks.
    """
    positive = truth.filter("p > 0")
    size = positive.groupBy("query_id").agg(F.count("*").alias("n"))
    best = positive.withColumn("r", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("p")))).filter(F.col("r") <= k).select("query_id", "node")
    mine = top_k(answer.filter("p > 0"), k).select("query_id", "node")
    have = mine.groupBy("query_id").agg(F.count("*").alias("have"))
    # where an answer needs filling it has fewer than k nodes, so the first 2k ids suffice
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(min(2 * k, n), 1) - 1).cast("long"))).alias("node")
    lacking = size.select("query_id").join(have, "query_id", "left").filter(F.coalesce("have", F.lit(0)) < k)
    fill = lacking.select("query_id", "have", first).join(mine, ["query_id", "node"], "left_anti")
    fill = fill.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("node"))).filter(F.col("r") <= k - F.coalesce("have", F.lit(0))).select("query_id", "node")
    hits = mine.unionByName(fill).join(best, ["query_id", "node"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return size.join(hits, "query_id", "left").select("query_id", F.when(F.col("n") < k, F.lit(1.0)).otherwise(F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"))


def conductance(answer: DataFrame, edges: DataFrame, whole: float | None = None) -> DataFrame:
    """query_id, conductance: the least conductance of the sweep over nodes in order of (p, node), greatest first.

    Nodes without out-edges are never in the cut.  An edge to a node of the cut, the own one included, takes its weight
    off the cut, any other adds it; a cut below 0 begins anew at 0.  As a sum that restarts at 0 is the running sum
    less its least value so far (if that is below 0), the sweep is a matter of running sums.

    Of the graph the edges of the answer's nodes alone are summed and ranked, and the rest adds to the whole weight; an
    answer of few nodes goes to where the edges are.  Where the whole weight is given, edges need be those of the
    answer's nodes alone.
    """
    weight = edges.agg(F.sum("w").alias("whole")) if whole is None else edges.sparkSession.range(1).select(F.lit(whole).alias("whole"))
    reached = answer.filter("p > 0").select(F.col("node").alias("src")).distinct()
    edges = edges.select("src", "dst", "w").join(reached, "src", "left_semi")
    sources = edges.groupBy("src").agg(F.sum("w").alias("vol"))
    # positions by mass alone keep their order when nodes without out-edges are taken out
    swept = answer.filter("p > 0").join(sources, F.col("node") == F.col("src")).select("query_id", "node", "p", "vol")
    swept = materialize(ranked(swept), "swept")
    out = swept.select("query_id", "rank", F.col("node").alias("src")).join(edges, "src")
    inside = swept.select("query_id", F.col("node").alias("dst"), F.col("rank").alias("dst_rank"))
    signed = out.join(inside, ["query_id", "dst"], "left").withColumn("signed", F.when(F.col("dst_rank") <= F.col("rank"), -F.col("w")).otherwise(F.col("w")))
    step = signed.groupBy("query_id", "rank").agg(F.sum("signed").alias("delta"))
    # ranks in steps of RANKS are summed together
    fine = F.floor(F.col("rank") / RANKS)
    sums = running(swept.join(step, ["query_id", "rank"]).select("query_id", "rank", "delta", "vol"), ["query_id"], fine, ["rank"], {"s": F.col("delta"), "v": F.col("vol")})
    sums = running(sums, ["query_id"], fine, ["rank"], {}, least={"low": F.col("s")})
    cut = F.col("s") - F.least(F.lit(0.0), F.col("low"))
    cuts = sums.select("query_id", "v", cut.alias("cut")).join(F.broadcast(weight)).withColumn("small", F.least("v", F.col("whole") - F.col("v")))
    phi = cuts.filter("cut > 0 and small > 0").groupBy("query_id").agg(F.min(F.col("cut") / F.col("small")).alias("phi"))
    return answer.select("query_id").distinct().join(phi, "query_id", "left").select("query_id", F.least(F.lit(1.0), F.coalesce("phi", F.lit(1.0))).alias("conductance"))


def errors(answer: DataFrame, truth: DataFrame, decimals: int = 12) -> DataFrame:
    """query_id, l1 and max_ae, from one meeting of answer and truth."""
    return _matched(answer, truth).groupBy("query_id").agg(F.sum("off").alias("l1"), F.max(F.round("off", decimals)).alias("max_ae"))


def by_query(answer: DataFrame, truth: DataFrame, edges: DataFrame, n: int, k: int = 50, whole: float | None = None) -> DataFrame:
    """query_id, l1, precision, conductance and max_ae."""
    return errors(answer, truth).join(precision_at_k(answer, truth, n, k), "query_id").join(conductance(answer, edges, whole), "query_id")


def report(answer: DataFrame, truth: DataFrame, edges: DataFrame, n: int, k: int = 50, whole: float | None = None) -> DataFrame:
    """l1, precision, conductance and max_ae, each averaged over queries."""
    return by_query(answer, truth, edges, n, k, whole).agg(*[F.avg(c).alias(c) for c in ("l1", "precision", "conductance", "max_ae")])
