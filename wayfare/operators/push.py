"""Sampled push: the flagship approximate query.

A sample starts with mass 1 at the source.  At each level a node of mass p offers p * w / total to every out-edge.  In a
weight bucket with p * 2**bucket / total >= 1 that mass is handed on as it is, to at most 2p edges.  In the others each
edge gets a mass of 1 with that chance: positions in the bucket are met by geometric skips with the chance of the
bucket's bound, and a position that is met is accepted with the chance w / 2**bucket.  So a level looks at the buckets
of its nodes and at the edges it meets, about twice as many as it hands mass to, and never at all edges of a hub.  A
sample's mass stays on few nodes, and the mean over samples is the exact distribution.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import LATTICE, rng
from wayfare.operators.indexes import bucket_index, bucket_totals
from wayfare.plans.storage import bucketed, materialize

#: Decimals that masses keep between levels, so that coins fall alike whatever the order of summation.
DECIMALS = 12


def start(queries: DataFrame, samples: int) -> DataFrame:
    if samples < 1:
        return queries.select("query_id", F.lit(0).cast("long").alias("sample"), F.col("u").alias("node"), F.lit(1.0).alias("p")).limit(0)
    return queries.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("sample"), F.col("u").alias("node"), F.lit(1.0).alias("p"))


def hits(met: DataFrame, seed: str, level: int) -> DataFrame:
    """The positions that each row of met (query_id, sample, src, bucket, cnt, unit, q) meets in its bucket.

    query_id, sample, src, bucket, bpos and unit, the mass for each unit of weight: all positions where q is 1 or more;
    else those that geometric skips of chance q come by, and unit is null.  A batch's rows skip together, round by
    round, until all have passed their last position.
    """
    names = ["query_id", "sample", "src", "bucket", "bpos", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(4)]
            cnt, unit, q = (batch.column(k).to_numpy() for k in range(4, 7))
            sure = np.flatnonzero(q >= 1)
            which = np.repeat(sure, cnt[sure])
            rows, places = [which], [np.arange(len(which)) - np.repeat(np.cumsum(cnt[sure]) - cnt[sure], cnt[sure])]
            left = np.flatnonzero(q < 1)
            # what is hashed of a row's draws but for their numbers
            begun = {k: hashlib.md5("|".join(map(str, (seed, *(x[k] for x in keys[:2]), level, *(x[k] for x in keys[2:]), ""))).encode()) for k in left.tolist()}
            scale, at, i = {k: math.log1p(-q[k]) for k in begun}, np.full(len(q), -1, dtype=np.int64), 0
            while len(left):
                number, skips = str(i).encode(), []
                for k in left.tolist():
                    digest = begun[k].copy()
                    digest.update(number)
                    skips.append(math.floor(math.log(1 - int(digest.hexdigest()[:8], 16) % LATTICE / LATTICE) / scale[k]))
                at[left] += 1 + np.array(skips, dtype=np.int64)
                left = left[at[left] < cnt[left]]
                rows.append(left)
                places.append(at[left])
                i += 1
            row, place = np.concatenate(rows), np.concatenate(places)
            masses = pa.array(unit[row], mask=q[row] < 1)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[row]) for x in keys), pa.array(place.astype(np.int32)), masses], names=names)

    return met.mapInArrow(run, "query_id long, sample long, src long, bucket int, bpos int, unit double")


#: Adds to rows what an index knows of them.
Lookup = Callable[[DataFrame], DataFrame]


def offers(state: DataFrame, buckets: Lookup, located: Lookup, seed: str, level: int) -> DataFrame:
    """What state (query_id, sample, node, p) hands on at a level: query_id, sample, dst, mass.

    buckets adds bucket, cnt, maxw and total for each bucket of a row's src, located adds dst, w and maxw of the edge at
    (src, bucket, bpos); positions that are met move to where the index has them.
    """
    unit = F.col("p") / F.col("total")
    asked = buckets(state.select("query_id", "sample", F.col("node").alias("src"), "p"))
    met = asked.select("query_id", "sample", "src", "bucket", F.col("cnt").cast("long").alias("cnt"), unit.alias("unit"), (unit * F.col("maxw")).alias("q")).filter("q > 0")
    found = located(hits(met, seed, level))
    coin = rng(seed, F.col("query_id"), F.col("sample"), level, "accept", F.col("src"), F.col("bucket"), F.col("bpos"))
    mass = F.when(F.col("unit").isNotNull(), F.col("unit") * F.col("w")).when(coin < F.col("w") / F.col("maxw"), F.lit(1.0))
    return found.select("query_id", "sample", "dst", mass.alias("mass")).filter("mass is not null")


def gathered(masses: DataFrame) -> DataFrame:
    """state of the next level, from what one hands on."""
    return masses.groupBy("query_id", "sample", F.col("dst").alias("node")).agg(F.round(F.sum("mass"), DECIMALS).alias("p"))


def finish(masses: DataFrame, samples: int | list[int]) -> DataFrame:
    """answer (query_id, node, p) of so many samples; the answers of several numbers of them."""
    if not isinstance(samples, int):
        return finish_nested(masses, samples)
    return masses.groupBy("query_id", F.col("dst").alias("node")).agg((F.sum("mass") / F.lit(float(max(samples, 1)))).alias("p"))


def finish_nested(masses: DataFrame, counts: list[int]) -> DataFrame:
    """answers (eps_idx, query_id, node, p) of several numbers of samples at once, the k-th of the first counts[k] samples of masses."""
    added = [F.sum(F.when(F.col("sample") < n, F.col("mass"))).alias(f"__{k}") for k, n in enumerate(counts)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("eps_idx"), (F.col(f"__{k}") / F.lit(float(max(n, 1)))).alias("p")) for k, n in enumerate(counts)]))
    found = masses.groupBy("query_id", F.col("dst").alias("node")).agg(*added).select("query_id", "node", each.alias("e"))
    return found.select("e.eps_idx", "query_id", "node", "e.p").filter("p is not null")


def levels(queries: DataFrame, samples: int | list[int], length: int, buckets: Lookup, located: Lookup, seed: str, cut_every: int) -> DataFrame:
    """answer (query_id, node, p): the mean over samples of the mass at each node after `length` levels.

    The last level is not summed by sample first: its masses go straight into the mean.  Several numbers of samples give
    several answers, from the samples of the greatest.
    """
    state = start(queries, samples if isinstance(samples, int) else max(samples))
    for level in range(1, length):
        state = gathered(offers(state, buckets, located, seed, level))
        if level % cut_every == 0:
            state = materialize(state, "push")
    last = offers(state, buckets, located, seed, length) if length else state.select("query_id", "sample", F.col("node").alias("dst"), F.col("p").alias("mass"))
    return finish(last, samples)


def lookups(totals: DataFrame, index: DataFrame) -> tuple[Lookup, Lookup]:
    """buckets and located of bucket totals and a bucket index."""
    return lambda rows: rows.join(totals, "src"), lambda rows: rows.join(index, ["src", "bucket", "bpos"])


def sampled_push_near(edges: DataFrame, queries: DataFrame, samples: int | list[int], length: int, seed: str) -> DataFrame:
    """sampled_push by indexes of whole adjacencies, of the nodes that have mass before each level, over written edges.

    The state is written down before each level, so that few nodes are told to all tasks and edges stay where they are.
    """
    masses = start(queries, samples if isinstance(samples, int) else max(samples)).withColumnsRenamed({"node": "dst", "p": "mass"})
    for level in range(1, length + 1):
        state = materialize(gathered(masses), "push")
        here = materialize(edges.join(state.select(F.col("node").alias("src")).distinct(), "src", "left_semi"), "edges-at-hand")
        masses = offers(state, *lookups(bucket_totals(here), bucket_index(here)), seed, level)
    return finish(masses, samples)


def sampled_push(edges: DataFrame, queries: DataFrame, samples: int | list[int], length: int, seed: str = "push", cut_every: int = 6) -> DataFrame:
    """answer (query_id, node, p) of a sampled push over edges.

    A sample's mass is 1 in the mean, so it is on about one node.  Where all samples hand on less at their levels than
    there are edges, each level indexes the nodes at hand; else the whole graph is indexed, once.  A node's index is
    that of all its edges either way, and so is the answer.  Totals and index of a whole graph are written in buckets
    by what they are joined on, so that a level moves the state and the positions it meets alone.
    """
    edges = materialize(edges.select("src", "dst", "w"), "edges")
    if queries.count() * (samples if isinstance(samples, int) else max(samples)) * length < edges.count():
        return sampled_push_near(edges, queries, samples, length, seed)
    totals = bucketed(bucket_totals(edges), ["src"], "bucket-totals")
    index = bucketed(bucket_index(edges), ["src", "bucket", "bpos"], "bucket-index")
    return levels(queries, samples, length, *lookups(totals, index), seed, cut_every)
