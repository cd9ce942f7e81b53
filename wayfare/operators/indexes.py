"""Indexes for sampling: transition probabilities, guided prefix sums, alias slots and weight buckets.

All go by each source's adjacency, so a rebuild for some sources is a rebuild of their rows alone.  Positions, running
sums and alias slots of a source with few edges come from windows over them; those of a hub from ranges of its edges,
cut where these lie, and from what the ranges before come to, so a hub is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import weight_bucket
from wayfare.plans.ordered import Running, by_size, spread

#: The adjacency's order; parallel edges follow each other by weight.
ORDER = ["dst", "w"]
#: Edges that a task makes alias slots of, about: it sorts them five times, with rows that grow.
ALIAS_EDGES = 1 << 17


def with_totals(edges: DataFrame) -> DataFrame:
    """edges with total, the weight that leaves their source.

    By an aggregation and a join, not a window: the edges of a hub are summed where they are and may be split among
    tasks when they are joined.
    """
    return edges.join(edges.groupBy("src").agg(F.sum("w").alias("total")), "src")


def transition_matrix(edges: DataFrame) -> DataFrame:
    """src, dst, p: the chance of each step; parallel edges add up."""
    merged = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return with_totals(merged).select("src", "dst", (F.col("w") / F.col("total")).alias("p"))


def numbered(edges: DataFrame, keys: list[str], running: Running) -> DataFrame:
    """edges with nth (from 1), hi (the running weight), deg and total of their group of keys."""
    return running(edges, keys, ORDER, {"nth": F.lit(1).cast("long"), "hi": F.col("w")}, {"nth": "deg", "hi": "total"})


def _placed(edges: DataFrame) -> DataFrame:
    """edges with nth, hi, deg and total of their source."""
    return by_size(edges.select("src", "dst", "w"), ["src"], lambda rows, running: numbered(rows, ["src"], running))


def positions(edges: DataFrame) -> DataFrame:
    """edges with pos (from 0), deg and total of their source."""
    return _placed(edges).select("src", "dst", "w", (F.col("nth") - 1).cast("int").alias("pos"), "deg", "total")


def prefix_index(edges: DataFrame) -> DataFrame:
    """src, pos, dst, lo, hi, total, deg: an edge owns [lo, hi) of [0, total)."""
    return _placed(edges).select("src", (F.col("nth") - 1).cast("int").alias("pos"), "dst", (F.col("hi") - F.col("w")).alias("lo"), "hi", "total", "deg")


def cell(x: Column, total: Column, deg: Column) -> Column:
    """Which of deg equal cells of [0, total) x lies in."""
    return F.least(F.floor(x / total * deg), deg - 1)


def guided_prefix_index(edges: DataFrame) -> DataFrame:
    """prefix_index with a row for each cell that an edge reaches into.

    At most twice as many rows as edges.  A draw looks into its own cell alone, so what a walk meets does not
    grow with the degree.
    """
    index = prefix_index(edges)
    first, last = cell(F.col("lo"), F.col("total"), F.col("deg")), cell(F.col("hi"), F.col("total"), F.col("deg"))
    return spread(index, first, last, "cell")


def alias_slots(edges: DataFrame, keys: list[str], running: Running) -> DataFrame:
    """edges (keys, dst, w, ...) with slot, p, alias_dst and deg: the alias slots of each group of keys.

    Light neighbours (below the mean weight) lack something, heavy ones have a surplus.  In order of position, the
    heavy ones' surpluses fill up what the light ones lack, so whose alias is whose is decided by where running sums
    of the two meet: a merge of two sorted sequences, done by running values.  A heavy neighbour whose surplus is used
    up within a light one's need becomes light itself and has the next heavy one as alias.  All sums are in units of
    weight times degree, hence exact for integer weights.

    Going down the sums, the heavy neighbour met last is the one of least end so far; so what a range of them carries
    on to the next is the giver that is open there, and a large group can be merged range by range.
    """
    surplus = F.col("w") * F.col("deg") - F.col("total")
    items = numbered(edges, keys, running).withColumn("surplus", surplus).withColumn("heavy", F.col("surplus") > 0)
    items = running(items, [*keys, "heavy"], ["nth"], {"end": F.abs("surplus")}).withColumn("begin", F.col("end") - F.abs("surplus"))
    items = running(items, [*keys, "heavy"], [F.desc("nth")], {}, earlier={"next_heavy": F.struct("nth", "dst")})
    # light items look, from where their need begins, for the first heavy one whose surplus reaches that far
    reach = items.withColumn("at", F.when(F.col("heavy"), F.col("end")).otherwise(F.col("begin")))
    giver = F.when(F.col("heavy"), F.struct("end", "nth", "dst"))
    found = running(reach, keys, [F.desc("at"), F.desc("heavy"), F.desc("nth")], {}, least={"giver": giver})
    # heavy items look for the first light one whose need ends behind their surplus
    need = F.when(~F.col("heavy") & (F.col("surplus") < 0), F.col("end"))
    found = running(found, keys, [F.desc("end"), F.desc("heavy"), F.desc("nth")], {}, least={"used_by": need})
    light = ~F.col("heavy") & (F.col("surplus") < 0) & F.col("giver").isNotNull()
    spent = F.col("heavy") & F.col("used_by").isNotNull() & F.col("next_heavy").isNotNull()
    p = F.when(light, (F.col("total") + F.col("surplus")) / F.col("total")).when(spent, (F.col("total") + F.col("end") - F.col("used_by")) / F.col("total")).otherwise(F.lit(1.0))
    alias = F.when(light, F.col("giver.dst")).when(spent, F.col("next_heavy.dst")).otherwise(F.col("dst"))
    return found.select(*edges.columns, (F.col("nth") - 1).cast("int").alias("slot"), p.alias("p"), alias.alias("alias_dst"), "hi", "deg")


def alias_index(edges: DataFrame) -> DataFrame:
    """src, slot, dst, p, alias_dst, deg: slot keeps its own neighbour with chance p, else it gives alias_dst."""
    built = by_size(edges.select("src", "dst", "w"), ["src"], lambda rows, running: alias_slots(rows, ["src"], running), ALIAS_EDGES)
    return built.select("src", "slot", "dst", "p", "alias_dst", "deg")


def alias_distribution(index: DataFrame) -> DataFrame:
    """src, dst, p: the distribution that alias slots imply; the index is read once."""
    kept = F.struct("dst", (F.col("p") / F.col("deg")).alias("p"))
    given = F.struct(F.col("alias_dst").alias("dst"), ((F.lit(1.0) - F.col("p")) / F.col("deg")).alias("p"))
    return index.select("src", F.inline(F.array(kept, given))).groupBy("src", "dst").agg(F.sum("p").alias("p"))


def bucket_index(edges: DataFrame) -> DataFrame:
    """src, bucket, bpos, dst, w, maxw: edges by weight bucket, numbered within it; maxw bounds a bucket's weights."""
    marked = edges.select("src", "dst", "w", weight_bucket(F.col("w")).alias("bucket"))
    placed = by_size(marked, ["src", "bucket"], lambda rows, running: running(rows, ["src", "bucket"], ORDER, {"nth": F.lit(1).cast("long")}))
    return placed.select("src", "bucket", (F.col("nth") - 1).cast("int").alias("bpos"), "dst", "w", F.pow(F.lit(2.0), "bucket").alias("maxw"))


def bucket_totals(edges: DataFrame) -> DataFrame:
    """src, bucket, cnt, maxw, total: how many edges each bucket has, the bound of their weights, the source's weight."""
    counted = edges.groupBy("src", weight_bucket(F.col("w")).alias("bucket")).agg(F.count("*").alias("cnt"), F.sum("w").alias("__w"))
    whole = counted.groupBy("src").agg(F.sum("__w").alias("total"))
    return counted.join(whole, "src").select("src", "bucket", "cnt", F.pow(F.lit(2.0), "bucket").alias("maxw"), "total")


def rejection_index(edges: DataFrame) -> DataFrame:
    """src, pos, dst, accept (the chance to accept the neighbour once drawn), deg."""
    bound = edges.groupBy("src").agg(F.pow(F.lit(2.0), F.max(weight_bucket(F.col("w")))).alias("bound"))
    return positions(edges).join(bound, "src").select("src", "pos", "dst", (F.col("w") / F.col("bound")).alias("accept"), "deg")
