"""Monte-Carlo walks: all walks of all queries at once, one equi-join with an index for each step.

The index is written in buckets by the join's keys, so a step moves the walks alone; and it tells the degree and weight
of the node that an edge leads to, so the next step needs no other table.  Prefix walks whose steps are fewer than the
edges need no index of the whole graph: each step makes that of the nodes where walks are.

A draw depends on (seed, query, walk, step, draw number) alone, so results are the same on any cluster.
`dangling` says what happens to a walk at a node without out-edges before its last step: drop it, or let it stay there.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import rng
from wayfare.operators.indexes import alias_index, cell, guided_prefix_index, rejection_index
from wayfare.plans.storage import bucketed, materialize

#: What a walk carries about its node: out-degree and out-weight, null at dangling nodes.
ABOUT = ("deg", "total")
#: Attempts of all walks in a later round of a rejection step, at most; but `attempts` for each walk are always made.
ROUND = 1 << 20


def about(edges: DataFrame) -> DataFrame:
    """node, deg, total of all nodes with out-edges."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"), F.sum("w").alias("total"))


def carrying(index: DataFrame, nodes: DataFrame, target: str) -> DataFrame:
    """index with what a walk must know of the node that column `target` leads to, so that a step is one join."""
    facts = nodes.select(F.col("node").alias(target), *[F.col(c).alias(f"{target}_{c}") for c in ABOUT])
    return index.join(facts, target, "left")


def numbers(name: str, begin: int, many: int) -> Column:
    """A row for each of so many numbers from begin on; none at all are no row."""
    found = F.sequence(F.lit(begin).cast("long"), F.lit(begin + many - 1).cast("long")) if many > 0 else F.array().cast("array<bigint>")
    return F.explode(found).alias(name)


def begin(queries: DataFrame, walks: int) -> DataFrame:
    """query_id, walk, node: `walks` walks for each of queries (query_id, u), at its source."""
    return queries.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(walks - 1).cast("long"))).alias("walk"), F.col("u").alias("node"))


def start(queries: DataFrame, nodes: DataFrame, walks: int) -> DataFrame:
    """state (query_id, walk, node, deg, total): `walks` walks for each of queries (query_id, u)."""
    return begin(queries, walks).join(nodes, "node", "left").select("query_id", "walk", "node", *ABOUT)


def finish(state: DataFrame, walks: int) -> DataFrame:
    """answer (query_id, node, cnt, p): how many walks end at a node, and their share."""
    counted = state.groupBy("query_id", "node").agg(F.count("*").alias("cnt"))
    return counted.withColumn("p", F.col("cnt") / F.lit(float(walks)))


def finish_nested(state: DataFrame, counts: list[int]) -> DataFrame:
    """answers (eps_idx, query_id, node, cnt, p) of several numbers of walks at once: the k-th counts the first counts[k] walks of state.

    A walk's number says in which it counts, so all answers come from one run of the greatest number, and each is what a
    run of its own would give.  Rows are added up once, whatever the number of answers.
    """
    added = [F.count_if(F.col("walk") < n).alias(f"__{k}") for k, n in enumerate(counts)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("eps_idx"), F.col(f"__{k}").alias("cnt"), F.lit(float(n)).alias("n")) for k, n in enumerate(counts)]))
    found = state.groupBy("query_id", "node").agg(*added).select("query_id", "node", each.alias("e")).filter("e.cnt > 0")
    return found.select("e.eps_idx", "query_id", "node", "e.cnt", (F.col("e.cnt") / F.col("e.n")).alias("p"))


def _draw(seed: str, step: int, number: int) -> Column:
    return rng(seed, F.col("query_id"), F.col("walk"), step, number)


#: A step makes moves (query_id, walk, to, to_deg, to_total) of state; walks without a move are missing.
Step = Callable[[DataFrame, int], DataFrame]


def _policy(dangling: str) -> None:
    if dangling not in ("drop", "stay"):
        raise ValueError(f"unknown policy {dangling}")


def _walk(queries: DataFrame, nodes: DataFrame, walks: int | list[int], length: int, step: Step, dangling: str, cut_every: int = 8) -> DataFrame:
    """The answer of so many walks; the answers of several numbers of walks, from the walks of the greatest."""
    _policy(dangling)
    state = start(queries, nodes, walks if isinstance(walks, int) else max(walks))
    for k in range(1, length + 1):
        moves = step(state.filter("deg is not null"), k)
        moved = moves.select("query_id", "walk", F.col("to").alias("node"), *[F.col(f"to_{c}").alias(c) for c in ABOUT])
        if dangling == "stay":
            moved = moved.unionByName(state.join(moves.select("query_id", "walk"), ["query_id", "walk"], "left_anti"))
        state = materialize(moved, "walks") if k % cut_every == 0 and k < length else moved
    return finish(state, walks) if isinstance(walks, int) else finish_nested(state, walks)


def prefix_step(state: DataFrame, index: DataFrame, seed: str, k: int, about: tuple[str, ...] = ("to_deg", "to_total")) -> DataFrame:
    """Draw a number in the range of the node's weights, look into its cell, take the edge that owns it."""
    at = state.withColumn("x", _draw(seed, k, 0) * F.col("total"))
    at = at.withColumn("at", cell(F.col("x"), F.col("total"), F.col("deg")))
    met = at.join(index, (F.col("node") == F.col("src")) & (F.col("at") == F.col("cell")) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    return met.select("query_id", "walk", "to", *about)


def prefix_walk_near(edges: DataFrame, queries: DataFrame, walks: int | list[int], length: int, seed: str, dangling: str) -> DataFrame:
    """prefix_walk by indexes of whole adjacencies, of the nodes where walks are before each step, over written edges.

    The walks are written down before each step, so that few of them are told to all tasks and edges stay where they are.
    """
    _policy(dangling)
    state = begin(queries, walks if isinstance(walks, int) else max(walks))
    for k in range(1, length + 1):
        state = materialize(state, "walks")
        here = materialize(edges.join(state.select(F.col("node").alias("src")).distinct(), "src", "left_semi"), "edges-at-hand")
        index = guided_prefix_index(here).select("src", "cell", "lo", "hi", F.col("dst").alias("to"))
        moves = prefix_step(state.join(about(here), "node"), index, seed, k, about=())
        moved = moves.select("query_id", "walk", F.col("to").alias("node"))
        if dangling == "stay":
            moved = moved.unionByName(state.join(moves.select("query_id", "walk"), ["query_id", "walk"], "left_anti"))
        state = moved
    return finish(state, walks) if isinstance(walks, int) else finish_nested(state, walks)


def prefix_walk(edges: DataFrame, queries: DataFrame, walks: int | list[int], length: int, seed: str = "prefix", dangling: str = "drop", written: bool = False) -> DataFrame:
    """Walks that draw by prefix sums of weights; written says that edges are a table already.

    Where all walks take fewer steps than there are edges, each step indexes the nodes at hand; else the whole graph is
    indexed, once.  A node's index is that of all its edges either way, and so is the answer.
    """
    if not written:
        edges = materialize(edges.select("src", "dst", "w"), "edges")
    if queries.count() * (walks if isinstance(walks, int) else max(walks)) * length < edges.count():
        return prefix_walk_near(edges, queries, walks, length, seed, dangling)
    nodes = materialize(about(edges), "nodes")
    index = guided_prefix_index(edges).select("src", "cell", "lo", "hi", F.col("dst").alias("to"))
    index = bucketed(carrying(index, nodes, "to"), ["src", "cell"], "prefix-index")
    return _walk(queries, nodes, walks, length, lambda state, k: prefix_step(state, index, seed, k), dangling)


def alias_step(state: DataFrame, index: DataFrame, seed: str, k: int) -> DataFrame:
    """Draw a slot, then its own neighbour or its alias."""
    at = state.withColumn("at", F.floor(_draw(seed, k, 0) * F.col("deg")))
    met = at.join(index, (F.col("node") == F.col("src")) & (F.col("at") == F.col("slot")))
    own = _draw(seed, k, 1) < F.col("p")
    return met.select("query_id", "walk", *[F.when(own, F.col(f"own{c}")).otherwise(F.col(f"other{c}")).alias(f"to{c}") for c in ("", "_deg", "_total")])


def alias_walk(edges: DataFrame, queries: DataFrame, walks: int | list[int], length: int, seed: str = "alias", dangling: str = "drop") -> DataFrame:
    """Walks that draw by alias slots."""
    edges = materialize(edges.select("src", "dst", "w"), "edges")
    nodes = materialize(about(edges), "nodes")
    index = alias_index(edges).select("src", F.col("slot").cast("long").alias("slot"), "p", F.col("dst").alias("own"), F.col("alias_dst").alias("other"))
    index = bucketed(carrying(carrying(index, nodes, "own"), nodes, "other"), ["src", "slot"], "alias-index")
    return _walk(queries, nodes, walks, length, lambda state, k: alias_step(state, index, seed, k), dangling)


def _attempted(pending: DataFrame, index: DataFrame, seed: str, k: int, begin: int, size: int) -> DataFrame:
    """pending with `first`: the first accepted of a walk's attempts from begin to begin + size - 1, null where none is."""
    at = pending.withColumn("attempt", F.explode(F.sequence(F.lit(begin).cast("long"), F.lit(begin + size - 1).cast("long"))))
    at = at.withColumn("at", F.floor(rng(seed, F.col("query_id"), F.col("walk"), k, F.col("attempt") * 2) * F.col("deg")))
    met = at.join(index, (F.col("node") == F.col("src")) & (F.col("at") == F.col("pos")))
    taken = met.filter(rng(seed, F.col("query_id"), F.col("walk"), k, F.col("attempt") * 2 + 1) < F.col("accept"))
    first = taken.groupBy("query_id", "walk").agg(F.min(F.struct("attempt", "to", "to_deg", "to_total")).alias("first"))
    return pending.join(first, ["query_id", "walk"], "left")


def until_accepted(pending: DataFrame, attempted: Callable[[DataFrame, int, int], DataFrame], attempts: int, found: list[str]) -> DataFrame:
    """query_id, walk and the columns `found` of the first attempt of each pending walk that is accepted.

    attempted(pending, begin, size) adds `first`, what the first accepted of the attempts from begin on gives, or null.
    Goes in rounds, each over the walks still pending and written down.  The first makes `attempts` attempts for each
    walk, a later one up to twice as many as the one before, as far as ROUND allows.
    """
    rounds, begin, size = [], 0, attempts
    while True:
        tried = materialize(attempted(pending, begin, size), "rejection-round")
        rounds.append(tried.filter("first is not null").select("query_id", "walk", *[f"first.{c}" for c in found]))
        pending = tried.filter("first is null").select(*pending.columns)
        left = pending.count()
        if left == 0:
            return functools.reduce(DataFrame.unionByName, rounds)
        begin, size = begin + size, max(attempts, min(2 * size, ROUND // left))


def rejection_step(state: DataFrame, index: DataFrame, seed: str, k: int, attempts: int) -> DataFrame:
    """Draw uniform neighbours until one is accepted, and take that one.

    The greatest edge of a node is accepted with a chance above one half, so no walk is pending forever; nodes without
    weight are left out.
    """
    attempted = lambda pending, begin, size: _attempted(pending, index, seed, k, begin, size)
    return until_accepted(state.filter("total > 0"), attempted, attempts, ["to", "to_deg", "to_total"])


def least_acceptance(edges: DataFrame) -> DataFrame:
    """The least chance, over all sources, that one attempt of a rejection walk is accepted; one in it is the mean number of attempts."""
    mean = rejection_index(edges).groupBy("src").agg(F.avg("accept").alias("a"))
    return mean.agg(F.min("a").alias("acceptance"))


def rejection_walk(edges: DataFrame, queries: DataFrame, walks: int | list[int], length: int, seed: str = "reject", dangling: str = "drop", attempts: int = 8) -> DataFrame:
    """Walks that draw uniform neighbours and accept them by weight, each step until one is accepted.

    `attempts` is how many neighbours the first round of a step tries for each walk; the answer doesn't depend on it.
    """
    if attempts < 1:
        raise ValueError(f"attempts must be at least 1, not {attempts}")
    edges = materialize(edges.select("src", "dst", "w"), "edges")
    nodes = materialize(about(edges), "nodes")
    index = rejection_index(edges).select("src", F.col("pos").cast("long").alias("pos"), F.col("dst").alias("to"), "accept")
    index = bucketed(carrying(index, nodes, "to"), ["src", "pos"], "rejection-index")
    return _walk(queries, nodes, walks, length, lambda state, k: rejection_step(state, index, seed, k, attempts), dangling)
