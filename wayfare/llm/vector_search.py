"""Exact top-k search by inner product, block at a time.

1.  Vectors become integers and are put in an order in which neighbours are alike: by the nearest of a few sample
    vectors, which follow each other likewise, then by how near.  Ranges of that order are blocks.  A block has a forward index, its vectors as a matrix,
    and summaries, the greatest and least value of each component.
2.  A block's bound for a query is the sum over components of the most that any value in the block can add.
3.  Searches go in waves.  In a wave each query takes, of the blocks that it hasn't visited, those of the greatest
    bounds, a few at first, then more, at last all that are left; blocks whose bound falls below the query's k-th
    result so far are never visited.  Equal bounds count while a block has a smaller id than the k-th result.
4.  Queries meet summaries page by page, and blocks where the blocks are: both in parts of so many queries, so no task
    holds more than one block or page, and a batch of queries.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.llm.common import materialize

#: Results of a query, and the factor that components are multiplied with before they are floored.
K, SCALE = 20, 64.0
#: Vectors of a block; blocks of a page; queries that meet a page or block in one part; sample vectors of the order.
BLOCK, PAGE, PART, SAMPLE = 256, 1024, 4096, 256
#: How many blocks a query takes in each wave; the last wave takes all that can matter.
WAVES = (6, 48)
_EXACT = 2.0**53
_LEAST, _MOST = -(2**63), 2**63 - 1


def integers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id and v, the floored multiples, of the rows that have an id and a vector without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    found = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    found = found.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    return found.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(scale))).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as the rows of a matrix, short ones filled up with zeros."""
    size = column.value_lengths().fill_null(0).to_numpy()
    values = column.flatten().to_numpy()
    width = int(size.max(initial=0))
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = values
    return out


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """A matrix of integers in the smallest type that holds it."""
    least, most = int(x.min(initial=0)), int(x.max(initial=0))
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return kind, x.astype(kind).tobytes()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exact; what passes 64 bits is cut off there."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    size = width * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if size < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), _LEAST, _MOST).astype(np.int64)


def bounds(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query (row of v) and block (row of low and high): the most that a vector of the block can score."""
    width = max(v.shape[1], low.shape[1])
    v, low, high = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, low, high))
    return product(np.hstack([np.maximum(v, 0), np.minimum(v, 0)]), np.hstack([high, low]))


def chained(x: np.ndarray) -> np.ndarray:
    """The rows of a small matrix in an order in which each is followed by the nearest one left."""
    left, order = np.ones(len(x), dtype=bool), [0]
    for _ in range(1, len(x)):
        left[order[-1]] = False
        far = ((x - x[order[-1]]) ** 2).sum(axis=1)
        order.append(int(np.where(left, far, np.inf).argmin()))
    return x[order]


def blocks(vectors: DataFrame, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """The vectors (vec_id, v) in blocks: block, n, least_id, ids, kind and x (the forward index), low_high_kind and low_high.

    The order takes `sample` vectors, those of the smallest id hashes; all vectors are in blocks whatever the sample is.
    """
    chosen = vectors.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id", "v").limit(sample).toArrow()
    centres = chained(matrix(chosen["v"].combine_chunks()).astype(np.float64)) if chosen.num_rows else np.zeros((1, 0))
    half = (centres**2).sum(axis=1) / 2

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1)).astype(np.float64)
            width = min(x.shape[1], centres.shape[1])
            near = x[:, :width] @ centres[:, :width].T - half
            which = near.argmax(axis=1) if len(x) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(which), pa.array(near[np.arange(len(x)), which])], names=["vec_id", "v", "centre", "near"])

    names = ["block", "n", "least_id", "ids", "kind", "x", "low_high_kind", "low_high"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def made(rows: pa.Table) -> pa.RecordBatch:
            ids, x = rows["vec_id"].to_numpy(), matrix(rows["v"].combine_chunks())
            row = (number, len(ids), int(ids.min()), ids.astype("<i8").tobytes(), *packed(x), *packed(np.stack([x.min(axis=0), x.max(axis=0)])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            while rows.num_rows >= block:
                yield made(rows.slice(0, block))
                rows, number = rows.slice(block), number + 1
            held = rows.to_batches()
        if sum(b.num_rows for b in held):
            yield made(pa.Table.from_batches(held))

    ordered = vectors.mapInArrow(placed, "vec_id long, v array<bigint>, centre long, near double").withColumn("row", F.monotonically_increasing_id())
    # the row's number divides a vector and id that occur very often
    order = ["centre", "near", "vec_id", "row"]
    dealt = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v")
    return dealt.mapInArrow(cut, "block long, n long, least_id long, ids binary, kind string, x binary, low_high_kind string, low_high binary")


def array_of(data: bytes, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(rows, -1).astype(np.int64) if rows else np.zeros((0, 0), dtype=np.int64)


class Visitors:
    """Queries (query_id, v, kth_score, kth_id, ...) as arrays; no k-th result is null."""

    def __init__(self, batch: pa.RecordBatch):
        column = {n: batch.column(n) for n in batch.schema.names}
        self.v = matrix(column["v"])
        self.id = column["query_id"].to_numpy()
        self.full = column["kth_score"].is_valid().to_numpy(zero_copy_only=False)
        self.score = column["kth_score"].fill_null(_LEAST).to_numpy()
        self.kth_id = column["kth_id"].fill_null(_MOST).to_numpy()

    def wanted(self, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each query (row of score) and id: whether that score comes before the k-th result so far."""
        better = (score > self.score[:, None]) | (score == self.score[:, None]) & (ids[None, :] < self.kth_id[:, None])
        return better | ~self.full[:, None]


#: What queries and what they meet have in common: the key, and whether a row is a query.
_MEETING = "`__at` long, `__part` long, `__query` boolean"


def met(queries: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows of queries (key, __part, ...) and of held (key, ...) dealt by key and part, held's first in each."""
    parts = queries.groupBy(key, "__part").agg(F.count("*").alias("__n")).drop("__n")
    own = held.join(parts, key).select(F.col(key).alias("__at"), "__part", F.lit(False).alias("__query"), *[c for c in held.columns if c != key])
    asked = queries.select(F.col(key).alias("__at"), "__part", F.lit(True).alias("__query"), *[c for c in queries.columns if c not in (key, "__part")])
    both = own.unionByName(asked, allowMissingColumns=True)
    return both.repartition("__at", "__part").sortWithinPartitions("__at", "__part", "__query")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, pa.RecordBatch | None]]:
    """The rows of met in turn: (a held row, None), or (None, consecutive queries of one key and part)."""
    for batch in batches:
        at, part, query = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        change = np.flatnonzero((at[1:] != at[:-1]) | (part[1:] != part[:-1]) | ~query[1:] | ~query[:-1]) + 1
        cuts = [0, *change.tolist(), len(at)] if len(at) else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            rows = batch.slice(lo, hi - lo)
            yield (None, rows) if query[lo] else (rows.to_pylist()[0], None)


def routed(state: DataFrame, summaries: DataFrame, pages: int, width: int | None) -> DataFrame:
    """query_id, block, bound and least_id: the blocks that may have better results than a query's k-th, but for those it has visited.

    state: query_id, v, kth_score, kth_id, visited; summaries: page, block, n, least_id, low_high_kind, low_high in
    `pages` pages.  With a width only so many blocks of each query and page, those of the greatest bounds.
    """
    names = ["query_id", "block", "bound", "least_id"]
    page = summaries.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("block", "least_id", "low_high_kind", "low_high"))).alias("blocks"))
    part = F.pmod(F.xxhash64("query_id"), F.ceil(F.lit(state.count()) / PART)).alias("__part")
    asked = state.select("*", part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = least = low = high = None
        for held, rows in groups_of(batches):
            if held is not None:
                own = held["blocks"]
                block, least = (np.array([b[c] for b in own], dtype=np.int64) for c in ("block", "least_id"))
                ends = [array_of(b["low_high"], b["low_high_kind"], 2) for b in own]
                wide = max(e.shape[1] for e in ends)
                low, high = (np.stack([np.pad(e[k], (0, wide - e.shape[1])) for e in ends]) for k in (0, 1))
                continue
            asking = Visitors(rows)
            bound = bounds(asking.v, low, high)
            open_ = asking.wanted(bound, least)
            for k, visited in enumerate(rows.column("visited").to_pylist()):
                if visited:
                    open_[k] &= ~np.isin(block, visited)
            who, what = np.nonzero(open_)
            order = np.lexsort((least[what], -bound[who, what], who))
            who, what = who[order], what[order]
            if width:
                begin = np.searchsorted(who, who)
                near = np.arange(len(who)) - begin < width
                who, what = who[near], what[near]
            yield pa.RecordBatch.from_arrays([pa.array(asking.id[who]), pa.array(block[what]), pa.array(bound[who, what]), pa.array(least[what])], names=names)

    return met(asked, page, "page").mapInArrow(run, "query_id long, block long, bound long, least_id long")


def visited(visits: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of visits (query_id, v, kth_score, kth_id, block): at most k of a visit, none that the k-th result excludes."""
    names = ["query_id", "vec_id", "score"]
    parts = visits.groupBy("block").agg(F.ceil(F.count("*") / PART).alias("__parts"))
    dealt = visits.join(parts, "block").withColumn("__part", F.pmod(F.xxhash64("query_id"), F.col("__parts"))).drop("__parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = x = None
        for held, rows in groups_of(batches):
            if held is not None:
                ids, x = np.frombuffer(held["ids"], dtype="<i8"), array_of(held["x"], held["kind"], held["n"])
                continue
            asking = Visitors(rows)
            score = product(asking.v, x)
            good = asking.wanted(score, ids) & (ids[None, :] != asking.id[:, None])
            who, what = np.nonzero(good)
            order = np.lexsort((ids[what], -score[who, what], who))
            who, what = who[order], what[order]
            first = np.arange(len(who)) - np.searchsorted(who, who) < k
            who, what = who[first], what[first]
            yield pa.RecordBatch.from_arrays([pa.array(asking.id[who]), pa.array(ids[what]), pa.array(score[who, what])], names=names)

    return met(dealt, index.select("block", "n", "ids", "kind", "x"), "block").mapInArrow(run, "query_id long, vec_id long, score long")


def first_of(rows: DataFrame, most: int, *order: object) -> DataFrame:
    """The first `most` rows of each query, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= most)


def search(
    rows: DataFrame, every: int = 20, k: int = K, scale: float = SCALE, waves: tuple[int, ...] = WAVES, block: int = BLOCK,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best candidates of each query, or all if there are fewer.

    Queries are the rows whose id is divisible by `every`, candidates all rows of other ids; the score is the inner
    product of the components' floored multiples, ties go to smaller ids.  Exact: no block that could change a result
    is left out.  Rows without id, without a vector, or with null or non-finite components take no part; an empty
    vector does, and components that a shorter vector lacks count as zeros.  Rows that repeat an id are candidates each
    for itself; as a query an id is asked once, with its least vector, and none of its own rows answers.  Components and
    scores beyond 64 bits are cut off there.  An empty table gives no rows; other columns are not read.
    """
    vectors = integers(rows, id_col, vec_col, scale)
    index = materialize(blocks(vectors, block), "blocks")
    numbered = index.select("block", "n", "least_id", "low_high_kind", "low_high")
    pages = max(1, -(-index.count() // PAGE))
    summaries = materialize(numbered.withColumn("page", F.pmod(F.xxhash64("block"), F.lit(pages))), "summaries")
    asked = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    queries = materialize(asked, "queries")
    none = [F.lit(None).cast("long").alias(c) for c in ("kth_score", "kth_id")]
    state = queries.select("*", *none, F.array().cast("array<bigint>").alias("visited"))
    best, seen = None, []
    for width in [*waves, None]:
        paths = routed(state, summaries, pages, width)
        if width:
            paths = first_of(paths, width, F.desc("bound"), "least_id", "block")
        paths = materialize(paths.select("query_id", "block"), "visits")
        found = visited(paths.join(state.drop("visited"), "query_id"), index, k)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = materialize(first_of(found, k, F.desc("score"), "vec_id"), "best")
        if width:
            seen.append(paths)
            whole = functools.reduce(DataFrame.unionByName, seen).groupBy("query_id").agg(F.collect_list("block").alias("visited"))
            kth = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
            state = queries.join(kth, "query_id", "left").join(whole, "query_id", "left")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_sql(every: int = 20, k: int = K) -> str:
    """DuckDB SQL for search over embeddings: all pairs scored, on small tables."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= {k}"""
