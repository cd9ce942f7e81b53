"""Walks of a store by their numbers: all walks of a query that are at one node are one row.

A step splits the number of walks at a node among its edges, as independent draws would.  Think of the walks as points,
uniform on the node's weights: an edge gets those that fall on its stretch.  How many lie below a place is found without
drawing them: going down a tree of halves, the left half of c points has a binomial number of them.  What a half gets is
a hash of the query, the node, the step and the half, so every block of a source finds its own share by itself, and the
shares fit each other.  So work follows the nodes and edges that are met, not the walks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import stored
from wayfare.plans.ordered import spread
from wayfare.plans.storage import materialize
from wayfare.sources.store import Store

#: So many points, or fewer, are drawn one by one; halves are no smaller than 2**-DEEPEST.
FEW, DEEPEST = 32, 48


def below(count: int, bounds: np.ndarray, key: int) -> np.ndarray:
    """How many of count points, uniform on [0, 1), lie below each of rising bounds; the same points for the same key."""
    out = np.zeros(len(bounds), dtype=np.int64)
    todo = [(0.0, 0, 1, count, 0, 0, len(bounds))]
    while todo:
        low, depth, half, c, base, i, j = todo.pop()
        if i == j:
            continue
        width, draw = 0.5**depth, np.random.Generator(np.random.Philox(key=key, counter=half << 64))
        if c <= FEW or depth == DEEPEST:
            out[i:j] = base + np.searchsorted(np.sort(low + width * draw.random(c)), bounds[i:j])
            continue
        left, middle = int(draw.binomial(c, 0.5)), low + width / 2
        m = int(np.searchsorted(bounds[i:j], middle)) + i
        todo += [(low, depth + 1, 2 * half, left, base, i, m), (middle, depth + 1, 2 * half + 1, c - left, base + left, m, j)]
    # a bound of 1 or more is above all points
    out[bounds >= 1] = count
    return out


def _split(met: DataFrame, seed: str, k: int) -> DataFrame:
    """query_id, node, cnt: the shares that the edges of blocks (query_id, src, cnt, total, lo, dst, hi) get; hi rises from lo."""
    names = ["query_id", "node", "cnt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            for query, src, cnt, total, lo, dst, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = int(hashlib.md5(f"{seed}|{query}|{src}|{k}".encode()).hexdigest(), 16)
                share = np.diff(below(cnt, np.array([lo, *hi]) / total, key))
                some = np.flatnonzero(share)
                found.append((query, np.array(dst, dtype=np.int64)[some], share[some]))
            queries = np.repeat(np.array([q for q, _, _ in found], dtype=np.int64), [len(d) for _, d, _ in found])
            node, cnt = (np.concatenate([x[c] for x in found]) if found else np.empty(0, dtype=np.int64) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(node), pa.array(cnt)], names=names)

    return met.mapInArrow(run, "query_id long, node long, cnt long")


def _moved(state: DataFrame, store: Store, seed: str, k: int) -> DataFrame:
    """state (query_id, node, cnt) after a step, nodes possibly several times; walks at nodes without edges are lost."""
    known = store.table("nodes").meet(state.select("query_id", F.col("node").alias("src"), "cnt"), ["src"]).drop("buckets")
    known = materialize(known, "counted")
    single = known.filter("blocks = 1").select("query_id", "src", "cnt", "total", F.lit(0).cast("long").alias("block"), F.lit(0.0).alias("lo"), F.col("total").alias("end"))
    # at a source of more blocks than walks, these draw their blocks one by one
    many = known.filter("blocks > 1 and cnt >= blocks").select("query_id", "src", "cnt", "total")
    guided = store.table("guide").meet(many, ["src"]).filter("first").select("query_id", "src", "cnt", "total", "block", "lo", F.col("hi").alias("end"))
    met = store.table("blocks").meet(single.unionByName(guided), ["src", "block"])
    # the block's last edge ends where the next block begins
    inner = F.transform(F.slice("cells", F.lit(1), F.greatest(F.col("n").cast("int") - 1, F.lit(0))), lambda c: c.hi + F.col("lo"))
    met = met.select("query_id", "src", "cnt", "total", "lo", F.transform("cells", lambda c: c.dst).alias("dst"), F.concat(inner, F.array("end")).alias("hi"))
    few = spread(known.filter("blocks > 1 and cnt < blocks").select("query_id", F.col("src").alias("node"), "cnt"), F.lit(1).cast("long"), F.col("cnt"), "number")
    few = stored.prefix_moves(few.select("query_id", F.xxhash64("node", "number").alias("walk"), "node"), store, seed, k)
    return _split(met, seed, k).unionByName(few.select("query_id", F.col("to").alias("node"), F.lit(1).cast("long").alias("cnt")))


def walk(store: Store, queries: DataFrame, count: int, length: int, seed: str = "counted") -> DataFrame:
    """answer (query_id, node, cnt, p) of `count` walks for each of queries (query_id, u): where they end, and their share.

    Walks at a node without out-edges before the last step are lost.  A step is written down, a row for each node of a
    query.
    """
    state = queries.select("query_id", F.col("u").alias("node"), F.lit(count).cast("long").alias("cnt")).filter("cnt > 0")
    for k in range(1, length + 1):
        state = materialize(_moved(state, store, seed, k).groupBy("query_id", "node").agg(F.sum("cnt").alias("cnt")), "counted-walks")
    return state.withColumn("p", F.col("cnt") / F.lit(float(max(count, 1))))
