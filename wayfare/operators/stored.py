"""Graphs with their sampling indexes in a store: built once, opened by walks and pushes, changed by batches.

A source's edges lie in blocks by a hash of the neighbour, about BLOCK of them in each, one row a block.  A block's row
has its edges with running weights and alias slots.  A source of several blocks has the blocks' running weights and
alias slots too, so a draw finds the block, then the edge; neither grows with the source.  Edges have places in weight
buckets besides, CHUNK places a row, for pushes.

A batch rewrites the blocks and chunks that it touches: places that deletes leave are filled, rank by rank, with the
last places of their bucket, and inserted edges follow at the end, so places stay dense.  All other rows stay as they
are.  A source keeps its number of blocks until the store is compacted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.columns import rng, weight_bucket
from wayfare.operators import push, walks
from wayfare.operators.indexes import alias_index, alias_slots, bucket_index, cell
from wayfare.operators.updates import MissingEdges
from wayfare.plans.ordered import by_size, spread, windowed
from wayfare.plans.storage import materialize
from wayfare.sources.store import Store

#: Edges of a block, on average, when it is built, and places of a chunk.
BLOCK, CHUNK = 64, 64
#: What a cell, one edge of a block, is known by.
CELL = ["bucket", "bpos", "dst", "w"]
PLACE = ["src", "bucket", "bpos"]


def blocks_for(deg: Column, block: int) -> Column:
    """The number of blocks of a source of so many edges: a power of two."""
    return F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(deg / F.lit(float(block)))), F.lit(0))).cast("long")


def block_of(dst: Column, blocks: Column) -> Column:
    return F.floor(rng("block", dst) * blocks)


def ranks(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the number, from 1, of each row in its group."""
    return by_size(df, keys, lambda rows, running: running(rows, keys, order, {name: F.lit(1).cast("long")}))


# ---- tables


def block_rows(cells: DataFrame) -> DataFrame:
    """src, block, n, sum, top (the greatest weight) and cells of cells (src, block, CELL)."""
    slots = alias_slots(cells.select("src", "block", *CELL), ["src", "block"], windowed)
    one = F.struct("slot", *CELL, "hi", "p", F.col("alias_dst").alias("other"))
    return slots.groupBy("src", "block").agg(F.count("*").alias("n"), F.sum("w").alias("sum"), F.max("w").alias("top"), F.sort_array(F.collect_list(one)).alias("cells"))


def chunk_rows(edges: DataFrame, chunk: int) -> DataFrame:
    """src, bucket, chunk and edges of edges (src, CELL)."""
    by = edges.withColumn("chunk", F.floor(F.col("bpos") / chunk).cast("long"))
    return by.groupBy("src", "bucket", "chunk").agg(F.sort_array(F.collect_list(F.struct("bpos", "dst", "w"))).alias("edges"))


def source_rows(sums: DataFrame, blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each source: its deg, total, top, cap (edges of its fullest block), slots (blocks with edges), blocks and buckets.

    sums (src, block, n, sum, top), blocks (src, blocks), counts (src, bucket, cnt).
    """
    about = sums.groupBy("src").agg(F.sum("n").alias("deg"), F.sum("sum").alias("total"), F.max("top").alias("top"), F.max("n").alias("cap"), F.count("*").alias("slots"))
    # a source has a few dozens of buckets at most
    buckets = counts.filter("cnt > 0").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("bucket", "cnt"))).alias("buckets"))
    return about.join(blocks, "src").join(buckets, "src")


def guide_rows(sums: DataFrame) -> DataFrame:
    """For sources of several blocks: a row for each cell of the source's weights that a block reaches into.

    There are as many equal cells as blocks; lo and hi are the block's running weights, first marks one row of each block.
    """
    whole = {"hi": "total", "nth": "slots"}
    placed = by_size(sums, ["src"], lambda rows, running: running(rows, ["src"], ["block"], {"hi": F.col("sum"), "nth": F.lit(1).cast("long")}, whole))
    placed = placed.withColumn("lo", F.col("hi") - F.col("sum"))
    begin, end = (cell(F.col(c), F.col("total"), F.col("slots")) for c in ("lo", "hi"))
    return spread(placed, begin, end, "cell").select("src", "cell", "block", "lo", "hi", "n", "sum", "top", (F.col("cell") == begin).alias("first"))


def choice_rows(sums: DataFrame) -> DataFrame:
    """For sources of several blocks: alias slots over these."""
    slots = alias_index(sums.select("src", F.col("block").alias("dst"), F.col("sum").alias("w")))
    return slots.select("src", F.col("slot").cast("long").alias("slot"), F.col("dst").alias("block"), "p", F.col("alias_dst").alias("other"))


#: Each table's key, and what it is looked up by.
TABLES = {
    "nodes": (["src"], ["src"]), "blocks": (["src", "block"], ["src", "block"]), "guide": (["src"], ["src", "cell"]),
    "choice": (["src"], ["src", "slot"]), "chunks": (["src", "bucket", "chunk"], ["src", "bucket", "chunk"]),
}


def _tables(edges: DataFrame, block: int, chunk: int) -> dict:
    edges = materialize(edges.select("src", "dst", "w"), "edges")
    many = materialize(edges.groupBy("src").agg(blocks_for(F.count("*"), block).alias("blocks")), "block-numbers")
    placed = bucket_index(edges).join(many, "src").withColumn("block", block_of(F.col("dst"), F.col("blocks")))
    cells = materialize(placed.select("src", "block", *CELL), "cells")
    rows = materialize(block_rows(cells), "block-rows")
    sums = rows.drop("cells")
    large = materialize(sums.join(many.filter("blocks > 1"), "src", "left_semi"), "block-sums")
    made = {
        "nodes": source_rows(sums, many, cells.groupBy("src", "bucket").agg(F.count("*").alias("cnt"))), "blocks": rows,
        "guide": guide_rows(large), "choice": choice_rows(large), "chunks": chunk_rows(cells, chunk),
    }
    return {name: (df, *TABLES[name]) for name, df in made.items()}


def create(edges: DataFrame, folder: str, block: int = BLOCK, chunk: int = CHUNK) -> Store:
    """A store of edges (src, dst, w) with all indexes, at folder."""
    return Store.create(edges.sparkSession, folder, _tables(edges, block, chunk), {"block": block, "chunk": chunk})


def edges_of(store: Store) -> DataFrame:
    """The graph as it is at the store's version."""
    return store.table("blocks").whole().select("src", F.explode("cells").alias("c")).select("src", "c.dst", "c.w")


def compact(store: Store, share: float = 0.25) -> Store:
    """The store with bases written anew, and blocks as many as the sources' degrees ask for, if its changes have grown.

    They have when they hold more than `share` of the blocks that the base has; else it is the store as it is.
    """
    blocks = store.table("blocks")
    if blocks.live is None or blocks.live.count() <= share * blocks.base.count():
        return store
    return store.rebased(_tables(edges_of(store), store.facts["block"], store.facts["chunk"]))


# ---- walks


def _at(state: DataFrame, store: Store) -> DataFrame:
    """state (query_id, walk, node) with what the store knows of the node, now src."""
    return store.table("nodes").meet(state.select("query_id", "walk", F.col("node").alias("src")), ["src"]).drop("buckets")


def _draw(seed: str, k: int, number: int | Column) -> Column:
    return rng(seed, F.col("query_id"), F.col("walk"), k, number)


def _single(at: DataFrame, *columns: Column) -> DataFrame:
    """Walks at sources of one block, which is block 0."""
    return at.filter("blocks = 1").select("*", F.lit(0).cast("long").alias("block"), *columns)


def prefix_moves(state: DataFrame, store: Store, seed: str, k: int) -> DataFrame:
    """query_id, walk, to: a number in the range of the node's weights finds the block, then the edge that owns it."""
    at = _at(state, store).withColumn("x", _draw(seed, k, 0) * F.col("total"))
    kept = ["query_id", "walk", "src", "x"]
    many = at.filter("blocks > 1").select(*kept, cell(F.col("x"), F.col("total"), F.col("slots")).alias("cell"))
    many = store.table("guide").meet(many, ["src", "cell"]).filter("x >= lo and x < hi")
    placed = _single(at, F.lit(0.0).alias("lo")).select(*kept, "block", "lo").unionByName(many.select(*kept, "block", "lo"))
    met = store.table("blocks").meet(placed, ["src", "block"])
    below = F.size(F.filter("cells", lambda c: c.hi + F.col("lo") <= F.col("x")))
    return met.select("query_id", "walk", F.element_at("cells", F.least(below + 1, F.col("n").cast("int"))).dst.alias("to"))


def alias_moves(state: DataFrame, store: Store, seed: str, k: int) -> DataFrame:
    """query_id, walk, to: alias slots give the block, then, inside it, the edge."""
    at = _at(state, store)
    kept = ["query_id", "walk", "src"]
    many = at.filter("blocks > 1").select(*kept, F.floor(_draw(seed, k, 0) * F.col("slots")).alias("slot"))
    many = store.table("choice").meet(many, ["src", "slot"])
    chosen = F.when(_draw(seed, k, 1) < F.col("p"), F.col("block")).otherwise(F.col("other")).alias("block")
    placed = _single(at).select(*kept, "block").unionByName(many.select(*kept, chosen))
    met = store.table("blocks").meet(placed, ["src", "block"])
    met = met.select("query_id", "walk", F.element_at("cells", (F.floor(_draw(seed, k, 2) * F.col("n")) + 1).cast("int")).alias("c"))
    return met.select("query_id", "walk", F.when(_draw(seed, k, 3) < F.col("c.p"), F.col("c.dst")).otherwise(F.col("c.other")).alias("to"))


def rejection_moves(state: DataFrame, store: Store, seed: str, k: int, attempts: int = 8) -> DataFrame:
    """query_id, walk, to: uniform blocks and places in them are drawn until there is an edge, and it is accepted by its weight."""

    def attempted(pending: DataFrame, begin: int, size: int) -> DataFrame:
        draw = lambda n: _draw(seed, k, F.col("attempt") * 3 + n)
        tried = pending.select("query_id", "walk", "src", "blocks", "cap", F.col("top").alias("bound"), walks.numbers("attempt", begin, size))
        tried = tried.select("query_id", "walk", "src", "attempt", "bound", F.floor(draw(0) * F.col("blocks")).alias("block"), F.floor(draw(1) * F.col("cap")).alias("place"))
        met = store.table("blocks").meet(tried, ["src", "block"]).filter("place < n").withColumn("c", F.element_at("cells", (F.col("place") + 1).cast("int")))
        taken = met.filter(draw(2) * F.col("bound") < F.col("c.w"))
        first = taken.groupBy("query_id", "walk").agg(F.min(F.struct("attempt", F.col("c.dst").alias("to"))).alias("first"))
        return pending.join(first, ["query_id", "walk"], "left")

    return walks.until_accepted(_at(state, store).filter("total > 0"), attempted, attempts, ["to"])


MOVES = {"prefix": prefix_moves, "alias": alias_moves, "rejection": rejection_moves}


def walk(store: Store, queries: DataFrame, count: int, length: int, how: str = "prefix", seed: str = "stored", dangling: str = "drop", cut_every: int = 2) -> DataFrame:
    """answer (query_id, node, cnt, p) of `count` walks for each of queries (query_id, u); how is prefix, alias or rejection.

    Nothing is built: a step looks up the walks' nodes, the blocks that they draw, and no other rows.  Walks are written
    down every cut_every steps.
    """
    if how not in MOVES:
        raise ValueError(f"unknown walk {how}")
    if dangling not in ("drop", "stay"):
        raise ValueError(f"unknown policy {dangling}")
    state = queries.select("query_id", walks.numbers("walk", 0, count), F.col("u").alias("node"))
    for k in range(1, length + 1):
        moves = MOVES[how](state, store, seed, k)
        moved = moves.select("query_id", "walk", F.col("to").alias("node"))
        if dangling == "stay":
            moves = materialize(moves, "moves")
            moved = moves.select("query_id", "walk", F.col("to").alias("node")).unionByName(state.join(moves, ["query_id", "walk"], "left_anti"))
        state = materialize(moved, "walks") if k % cut_every == 0 and k < length else moved
    return walks.finish(state, count)


def sampled_push(store: Store, queries: DataFrame, samples: int, length: int, seed: str = "push", cut_every: int = 2) -> DataFrame:
    """answer (query_id, node, p) of a sampled push; a level looks up the buckets of its nodes and the chunks that it meets."""
    chunk = store.facts["chunk"]

    def buckets(state: DataFrame) -> DataFrame:
        met = store.table("nodes").meet(state, ["src"]).select(*state.columns, "total", F.explode("buckets").alias("b"))
        return met.select(*state.columns, "total", "b.bucket", "b.cnt", F.pow(F.lit(2.0), "b.bucket").alias("maxw"))

    def located(found: DataFrame) -> DataFrame:
        met = store.table("chunks").meet(found.withColumn("chunk", F.floor(F.col("bpos") / chunk).cast("long")), ["src", "bucket", "chunk"])
        edge = F.element_at("edges", (F.col("bpos") % chunk + 1).cast("int"))
        return met.select(*found.columns, edge.dst.alias("dst"), edge.w.alias("w"), F.pow(F.lit(2.0), "bucket").alias("maxw"))

    return push.levels(queries, samples, length, buckets, located, seed, cut_every)


# ---- updates


def _cells(rows: DataFrame) -> DataFrame:
    """The cells (src, block, CELL) of block rows."""
    return rows.select("src", "block", F.explode("cells").alias("c")).select("src", "block", *[f"c.{x}" for x in CELL])


def _holes(store: Store, known: DataFrame, deletes: DataFrame) -> DataFrame:
    """The places (src, CELL) of the edges that go: of parallel ones the heaviest."""
    asked = deletes.groupBy("src", "dst").agg(F.count("*").alias("asked"))
    at = asked.join(known, "src").select("src", block_of(F.col("dst"), F.col("blocks")).alias("block")).distinct()
    there = _cells(store.table("blocks").meet(at, ["src", "block"])).join(asked, ["src", "dst"])
    nth = F.row_number().over(W.partitionBy("src", "dst").orderBy(F.desc("w"), "bpos"))
    holes = materialize(there.withColumn("nth", nth).filter("nth <= asked").select("src", *CELL), "holes")
    met = holes.groupBy("src", "dst").agg(F.count("*").alias("met"))
    absent = asked.join(met, ["src", "dst"], "left").filter(F.coalesce("met", F.lit(0)) < F.col("asked")).select("src", "dst").limit(10).collect()
    if absent:
        raise MissingEdges(f"no such edges: {[(r.src, r.dst) for r in absent]}")
    return holes


def update(store: Store, deletes: DataFrame, inserts: DataFrame, facts: dict | None = None) -> Store:
    """The store's next version, after deletes (src, dst) and then inserts (src, dst, w); deletes of edges that don't exist are an error.

    What is read and written follows the batch: blocks and chunks of the edges that go, move or come, and the rows of
    the sources that they belong to.
    """
    chunk = store.facts["chunk"]
    blocks, chunks = store.table("blocks"), store.table("chunks")
    deletes, inserts = deletes.select("src", "dst"), materialize(inserts.select("src", "dst", "w", weight_bucket(F.col("w")).alias("bucket")), "inserts")
    sources = deletes.select("src").union(inserts.select("src")).distinct()
    known = materialize(store.table("nodes").meet(sources, ["src"]).select("src", "blocks", "buckets"), "known")
    holes = _holes(store, known, deletes)

    # how many edges each bucket has, loses and gets
    before = known.select("src", F.explode("buckets").alias("b")).select("src", "b.bucket", "b.cnt", F.lit(0).alias("d"), F.lit(0).alias("i"))
    lost = holes.select("src", "bucket", F.lit(0).alias("cnt"), F.lit(1).alias("d"), F.lit(0).alias("i"))
    got = inserts.select("src", "bucket", F.lit(0).alias("cnt"), F.lit(0).alias("d"), F.lit(1).alias("i"))
    counts = before.union(lost).union(got).groupBy("src", "bucket").agg(*[F.sum(c).cast("long").alias(c) for c in ("cnt", "d", "i")])
    counts = materialize(counts.withColumn("keep", F.col("cnt") - F.col("d")), "counts")

    # the last places move into the holes before them, rank by rank
    tail = spread(counts.filter("d > 0").select("src", "bucket", "keep", "cnt"), F.col("keep"), F.col("cnt") - 1, "bpos").select(*PLACE)
    tail = ranks(tail.withColumn("bpos", F.col("bpos").cast("int")).join(holes.select(*PLACE), PLACE, "left_anti"), ["src", "bucket"], ["bpos"], "nth")
    empty = holes.join(counts, ["src", "bucket"]).filter("bpos < keep").select(*PLACE)
    empty = ranks(empty, ["src", "bucket"], ["bpos"], "nth").withColumnRenamed("bpos", "new")
    moves = tail.join(empty, ["src", "bucket", "nth"]).withColumn("chunk", F.floor(F.col("bpos") / chunk).cast("long"))
    edge = F.element_at("edges", (F.col("bpos") % chunk + 1).cast("int"))
    moves = materialize(chunks.meet(moves, ["src", "bucket", "chunk"]).select(*PLACE, "new", edge.dst.alias("dst"), edge.w.alias("w")), "moves")
    added = ranks(inserts, ["src", "bucket"], ["dst", "w"], "nth").join(counts, ["src", "bucket"])
    added = added.select("src", "bucket", (F.col("keep") + F.col("nth") - 1).cast("int").alias("bpos"), "dst", "w")
    out = materialize(holes.select("src", *CELL).unionByName(moves.select("src", *CELL)), "out")
    into = materialize(moves.select("src", "bucket", F.col("new").alias("bpos"), "dst", "w").unionByName(added), "into")

    # blocks and chunks that they touch
    fresh = inserts.groupBy("src").agg(blocks_for(F.count("*"), store.facts["block"]).alias("blocks")).join(known, "src", "left_anti")
    many = materialize(known.select("src", "blocks").unionByName(fresh), "block-numbers")
    blocked = lambda df: df.join(many, "src").withColumn("block", block_of(F.col("dst"), F.col("blocks"))).drop("blocks")
    met = materialize(blocked(out).select("src", "block").union(blocked(into).select("src", "block")).distinct(), "met-blocks")
    cells = _cells(blocks.meet(met, ["src", "block"])).join(out.select(*PLACE), PLACE, "left_anti")
    rows = materialize(block_rows(cells.unionByName(blocked(into).select("src", "block", *CELL))), "block-rows")
    in_chunk = lambda df: df.withColumn("chunk", F.floor(F.col("bpos") / chunk).cast("long"))
    met_chunks = in_chunk(out).select("src", "bucket", "chunk").union(in_chunk(into).select("src", "bucket", "chunk")).distinct()
    old = chunks.meet(met_chunks, ["src", "bucket", "chunk"]).select("src", "bucket", F.explode("edges").alias("e")).select("src", "bucket", "e.bpos", "e.dst", "e.w")
    places = old.join(out.select(*PLACE), PLACE, "left_anti").unionByName(into.select(*PLACE, "dst", "w"))

    # the sums of the sources' blocks: those of blocks that are not touched are in the guide
    other = store.table("guide").meet(sources, ["src"]).filter("first").select("src", "block", "n", "sum", "top").join(met, ["src", "block"], "left_anti")
    sums = materialize(other.unionByName(rows.drop("cells")), "block-sums")
    large = materialize(sums.join(many.filter("blocks > 1"), "src", "left_semi"), "large-sums")
    cnt = counts.select("src", "bucket", (F.col("keep") + F.col("i")).alias("cnt"))
    return store.commit(
        {
            "nodes": (sources, source_rows(sums, many, cnt)), "blocks": (met, rows), "guide": (sources, guide_rows(large)),
            "choice": (sources, choice_rows(large)), "chunks": (met_chunks, chunk_rows(places, chunk)),
        }, facts,
    )
