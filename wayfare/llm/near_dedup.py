"""Near duplicates by an LSH forest of MinHash signatures, confirmed on full shingle sets.

1.  Every text becomes the set of its word shingles and 128 MinHash values.  Rows of one set are a class and go on as
    one node, named by the set's digest.
2.  The forest has 32 trees; each is a sorted order of all nodes by twelve MinHash values of its own.  A region is what
    agrees in a prefix of d values; neighbours in an order with a common prefix of four values at least have mates.
    Two nodes of similarity 0.8 have a common prefix in no tree with a chance of (1 - 0.8^4)^32 < 5e-8.
3.  The depth adapts to each region: where more than CROWD nodes share a prefix, the region is divided by two more
    values at a time, down to twelve.  Every region has a middle, its node with most mates over all trees.
4.  Candidates come in two rounds, each confirmed on the full sets.  The first tries every node with one other, the
    greatest middle of its regions, which connects most groups; regions that it connects whole are done with.  The
    second tries, among nodes not yet connected, neighbours of longest common prefix, nodes with the middle of the
    deepest crowded region they are in, and all pairs of a leaf, a region of CROWD nodes at most.  So the pairs of a
    region grow with its nodes, not with their square.
5.  The connected components of the confirmed links are the groups.

A link is missed only if it meets in no tree, or in crowded regions alone, down to the deepest, where neither of its
nodes is the middle and no other links connect the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.llm.common import batched, join_groups, map_texts, materialize

TREES, PREFIX, DEEPEST = 32, 4, 12
HASHES = TREES * PREFIX
#: Bytes of an order key: the tree, then the low 16 bits of each value.
LENGTH = 1 + 2 * DEEPEST
#: Nodes of a region of which all pairs are tried, at most.
CROWD = 8
#: The least similarity, in percent, that TREES and PREFIX are made for.
LEAST_PERCENT = 80
#: Partners that are compared with one copy of a text.
PARTNERS = 256
#: Nodes whose order keys are made at once.
KEYED = 1024


def scrambled(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return np.array([xxhash.xxh64_intdigest(str(k), seed) | 1 for k in range(n)], dtype=np.uint64)


WORD_FACTORS, MIN_FACTORS = scrambled(64, 1), scrambled(HASHES, 2)


def mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    MOST = 1 << 16

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = WordHashes()


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of other characters than white space; A-Z in lower case."""
    return (text or b"").lower().split()


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles of a text, hashed and sorted; of a text of fewer words, the whole sequence as one."""
    found = words_of(text)
    if not found:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(words, len(ids))
    total = np.full(len(ids) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total += ids[k : len(ids) - n + 1 + k] * WORD_FACTORS[k]
    return np.unique(mixed(total))


def shingle_set(text: bytes | None, words: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, which links are confirmed on."""
    found = words_of(text)
    n = min(words, len(found))
    return set(zip(*(found[k:] for k in range(n)), strict=False)) if n else set()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    for k in range(0, len(shingles), 1024):
        least = np.minimum(least, ((shingles[k : k + 1024, None] * MIN_FACTORS) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32)


def signed(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, text_hash, n_shingles, set_id (a digest of the shingle set) and sig; null without words."""

    def make() -> Callable[[bytes | None], tuple]:
        def of_text(text: bytes | None) -> tuple:
            found = shingle_hashes(text, words)
            if not len(found):
                return 0, None, None
            return len(found), xxhash.xxh3_128_digest(found.tobytes()), signature(found).tobytes()

        return of_text

    return map_texts(named(docs, id_col, text_col), ["doc_id", "text_hash"], "text", make, "n_shingles long, set_id binary, sig binary")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and text_hash of docs, whatever else docs has."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def order_keys(nodes: DataFrame) -> DataFrame:
    """For each node and tree: place (the order key), node and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, KEYED) for b in batches for k in range(0, b.num_rows, KEYED)):
            rows = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4").reshape(rows, HASHES)
            key = np.empty((rows, TREES, LENGTH), dtype=np.uint8)
            key[:, :, 0] = np.arange(TREES)
            for t in range(TREES):
                own = np.take(sig, np.arange(t * PREFIX, t * PREFIX + DEEPEST) % HASHES, axis=1)
                key[:, t, 1::2], key[:, t, 2::2] = own & 0xFF, (own >> 8) & 0xFF
            places = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), rows * TREES, [None, pa.py_buffer(key.tobytes())])
            which = pa.array(np.repeat(np.arange(rows), TREES))
            yield pa.RecordBatch.from_arrays([places.cast(pa.binary()), batch.column(0).take(which), batch.column(1).take(which)], names=["place", "node", "n"])

    return nodes.select("node", "n", "sig").mapInArrow(run, "place binary, node binary, n long")


def common_prefixes(place: np.ndarray) -> np.ndarray:
    """For each row but the first of sorted places (rows by bytes): how many values it shares with the row before."""
    same = place[1:] == place[:-1]
    values = same[:, 1::2] & same[:, 2::2] & same[:, :1]
    return np.logical_and.accumulate(values, axis=1).sum(axis=1)


def members(keys: DataFrame) -> DataFrame:
    """The rows of the sorted orders that share four values or more with a neighbour: place, node, n, deep, mate, mate_n, end.

    deep is how many values are shared with the nearer neighbour; mate is the row before, if it shares four.  The
    orders are sorted by ranges, so a crowded region may lie across partitions: the first and the last row of each
    partition are kept, marked as its ends, as if they shared all values.
    """
    names = ["place", "node", "n", "deep", "mate", "mate_n", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row so far waits for the one after it: itself, the row before it, how many values those two share
        held: pa.RecordBatch | None = None
        mate, before, first = None, DEEPEST, True

        def made(rows: pa.Table, mates: pa.Table, before: np.ndarray, after: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
            deep = np.maximum(before, after).astype(np.int32)
            met = pa.array(np.arange(len(deep)), mask=(before < PREFIX) | end)
            columns = [rows[c] for c in ("place", "node", "n")] + [pa.array(deep)]
            columns += [mates[c].combine_chunks().take(met) for c in ("node", "n")] + [pa.array(end)]
            yield from pa.table(columns, names=names).filter(pa.array(deep >= PREFIX)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if rows.num_rows > 1:
                place = np.frombuffer(b"".join(rows["place"].to_pylist()), dtype=np.uint8).reshape(-1, LENGTH)
                shared = common_prefixes(place)
                mates = pa.concat_tables([rows.slice(0, 1) if mate is None else mate, rows.slice(0, rows.num_rows - 2)])
                end = np.zeros(len(shared), dtype=bool)
                end[0] = first
                yield from made(rows.slice(0, rows.num_rows - 1), mates, np.append(before, shared[:-1]), shared, end)
                mate, before, first = rows.slice(rows.num_rows - 2, 1), shared[-1], False
            held = rows.slice(rows.num_rows - 1).to_batches()[0]
        if held is not None:
            last = pa.Table.from_batches([held])
            yield from made(last, last if mate is None else mate, np.array([DEEPEST]), np.array([DEEPEST]), np.array([True]))
            # what the last row shares with the one before it
            if mate is not None and before >= PREFIX:
                yield from made(last, mate, np.array([before]), np.array([0]), np.array([False]))

    ordered = keys.repartitionByRange("place", "node").sortWithinPartitions("place", "node")
    return ordered.mapInArrow(run, "place binary, node binary, n long, deep int, mate binary, mate_n long, end boolean")


def prefix_of(depth: int) -> Column:
    return F.substring("place", 1, 1 + 2 * depth)


def regions(found: DataFrame) -> DataFrame:
    """The members by their regions of depth PREFIX: node, n, place, deep, mates, region, size and the region's middle.

    mates counts the rows that share the node's regions, over all trees; middle is a struct (mates, node, n), of the
    region's nodes the one with most mates.
    """
    known = materialize(found.groupBy("node", "n", "place").agg(F.max("deep").alias("deep")).withColumn("region", prefix_of(PREFIX)), "members")
    sizes = known.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
    mates = join_groups(known.select("node", "region"), sizes, ["region"], "size").groupBy("node").agg(F.sum(F.col("size") - 1).alias("mates"))
    return with_middles(materialize(known.join(mates, "node"), "with-mates"))


def with_middles(rows: DataFrame) -> DataFrame:
    """rows (node, n, mates, region, ...) of regions of more than one, with size and middle."""
    middle = F.max(F.struct("mates", "node", "n")).alias("middle")
    about = rows.groupBy("region").agg(F.count("*").alias("size"), middle).filter("size > 1")
    return join_groups(rows, about, ["region"], "size")


def leaves(undone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the depth adapted to each region comes to: leaves (region, node, n, is) and pairs (a, an, b, bn) with middles.

    Regions of more than CROWD of undone are divided by two more values at a time; a leaf has at most CROWD nodes, and
    a node is paired with the middle of the deepest crowded region that it is in.
    """
    depths = F.explode(F.sequence(F.lit(PREFIX), F.col("deep"), F.lit(2))).alias("depth")
    crowded = undone.filter(F.col("size") > CROWD).select("node", "n", "mates", "is", "place", depths)
    divided = with_middles(materialize(crowded.withColumn("region", F.expr("substring(place, 1, 1 + 2 * depth)")), "divided"))
    small, large = F.col("size") <= CROWD, F.col("size") > CROWD
    by_row = divided.groupBy("node", "n", "is", "place").agg(
        F.min_by("region", F.when(small, F.col("depth"))).alias("region"), F.max_by("middle", F.when(large, F.col("depth"))).alias("middle")
    )
    by_row = materialize(by_row, "leaves")
    found = undone.filter(small).select("region", "node", "n", "is").unionByName(by_row.filter(F.col("region").isNotNull()).select("region", "node", "n", "is"))
    central = by_row.filter(F.col("middle").isNotNull()).select(F.col("middle.node").alias("a"), F.col("middle.n").alias("an"), F.col("node").alias("b"), F.col("n").alias("bn"))
    return found, central.distinct()


def components(links: DataFrame) -> DataFrame:
    """For each node of links (a, b): node and component, the smallest node that it is connected with.

    By alternating large and small stars: every node's neighbours, or its smaller ones, are linked with the smallest
    of them, until nothing changes.  Each star is an aggregation by node and a join, and is written down, so no plan
    holds more than one of them; how many links there are, and what their hashes come to, is observed on the way.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = both.join(least, "a")
        if large:
            return met.filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()

    found = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        seen = Observation()
        state = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")]
        found = materialize(star(materialize(star(found, True), "large-stars"), False).observe(seen, *state), "stars")
        now = seen.get
        if now == before:
            break
        before = now
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose texts (node, text) are alike enough, on the shingles themselves.

    Pairs are dealt by a, in parts of about PARTNERS pairs; in each part a's text comes first and the others pass by
    it one at a time, so a task holds two texts, however many partners a has.
    """
    pairs = materialize(pairs.distinct(), "pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("times")).filter(F.col("times") > PARTNERS)
    dealt = join_groups(pairs, many, ["a"], "times", how="left")
    parts = F.coalesce(F.ceil(F.col("times") / PARTNERS), F.lit(1)).cast("long")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    left = dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("node"), F.lit(False).alias("other"))
    right = dealt.select("a", "part", F.col("b").alias("node"), F.lit(True).alias("other"))
    rows = left.unionByName(right).join(texts, "node").select("a", "part", "other", "node", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, set()
        for batch in batches:
            links = []
            for a, part, other, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not other:
                    key, own = (a, part), shingle_set(text, words)
                elif key == (a, part):
                    new = shingle_set(text, words)
                    common = len(own & new)
                    if 100 * common >= percent * (len(own) + len(new) - common):
                        links.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return batched(rows.repartition("a", "part").sortWithinPartitions("a", "part", "other")).mapInArrow(run, "a binary, b binary")


def fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of pairs (a, an, b, bn) whose sets are of sizes that can be alike enough."""
    fit = (F.col("a") != F.col("b")) & (F.lit(100) * F.least("an", "bn") >= F.lit(percent) * F.greatest("an", "bn"))
    return pairs.filter(fit).select("a", "b")


def apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are in different components."""
    of = lambda name: component.select(F.col("node").alias(name), F.col("component").alias(f"{name}_is"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("a_is", "a") != F.coalesce("b_is", "b")).select("a", "b")


def links_of(nodes: DataFrame, docs: DataFrame, words: int, percent: int, known: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of nodes (node, n, sig, doc_id, text_hash); docs (doc_id, text_hash, text) has their texts.

    known are links that hold anyway.
    """
    found = materialize(members(order_keys(nodes)), "forest")
    placed = materialize(regions(found), "placed")
    involved = placed.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node")
    texts = materialize(docs.join(involved, ["doc_id", "text_hash"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    top = placed.groupBy("node", "n").agg(F.max("middle").alias("m"))
    first = fitting(top.select(F.col("m.node").alias("a"), F.col("m.n").alias("an"), F.col("node").alias("b"), F.col("n").alias("bn")), percent)
    links = materialize(confirmed(first, texts, words, percent).unionByName(known), "first-links")
    component = materialize(components(links), "components")

    # a region whose nodes are all connected is done with
    of_node = placed.drop("middle").join(component, "node", "left").withColumn("is", F.coalesce("component", "node")).drop("component")
    spread = of_node.groupBy("region").agg(F.min("is").alias("lo"), F.max("is").alias("hi")).filter("lo <> hi").select("region")
    undone = materialize(of_node.join(spread, "region", "left_semi"), "undone")
    leaf, central = leaves(undone)
    own = [F.col("node").alias("b"), F.col("n").alias("bn")]
    beside = found.join(undone.select("node", "place"), ["node", "place"], "left_semi")
    # the ends of the orders' partitions meet
    order = W.orderBy("place", "node")
    ends = found.filter("end").select("place", *own, F.lead("node").over(order).alias("a"), F.lead("n").over(order).alias("an"), F.lead("place").over(order).alias("then"))
    ends = ends.filter(prefix_of(PREFIX) == F.substring("then", 1, 1 + 2 * PREFIX)).select("a", "an", "b", "bn")
    beside = beside.filter(F.col("mate").isNotNull()).select(F.col("mate").alias("a"), F.col("mate_n").alias("an"), *own).unionByName(ends)
    one, two = (leaf.select("region", F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("is").alias(f"{x}_is")) for x in "ab")
    within = one.join(two, "region").filter("a < b and a_is <> b_is").select("a", "an", "b", "bn")

    rest = fitting(central.unionByName(beside).unionByName(within), percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = apart(rest, component).join(tried, ["a", "b"], "left_anti")
    second = confirmed(rest, texts, words, percent)
    return component.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Linked are texts with 100 * intersection >= percent * union of their sets of word shingles.  component_id is
    the smallest doc_id reachable over links, itself included; kept tells that it is the row's own.  Null and
    empty texts have no shingles, are linked with nothing and stay.  Rows that repeat an id are one document, whose
    links are those of all its texts.  A row without id is put to an equal text that has one, else it stays with
    component_id null.  Texts of any length are read whole.  An empty table gives no rows; other columns of docs are
    not read, whatever they are called.  percent is at least 80.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be at least {LEAST_PERCENT}, not {percent}: less alike texts may meet in no tree")
    rows = materialize(signed(docs, words, id_col, text_col), "signed")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("least")
    classes = rows.filter(F.col("set_id").isNotNull()).groupBy(F.col("set_id").alias("node")).agg(
        least, F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count("*").alias("times")
    )
    nodes = materialize(classes.filter("least is not null").select("node", "least.doc_id", "least.text_hash", "sig", "n", "times"), "nodes")

    # an id of several texts links these
    having = rows.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "set_id")
    several = having.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), F.count("*").alias("times")).filter("lo <> hi")
    known = join_groups(having, several, ["doc_id"], "times").filter("set_id <> lo").select(F.col("set_id").alias("a"), F.col("lo").alias("b")).distinct()

    links = materialize(links_of(nodes, named(docs, id_col, text_col), words, percent, known), "links")
    member = nodes.select("node", "doc_id", "times").join(components(links), "node", "left").withColumn("is", F.coalesce("component", "node"))
    # a component is as large as its number of different sets
    smallest = member.groupBy("is").agg(F.min("doc_id").alias("__component"), F.count("*").alias("size"))
    together = smallest.filter("size > 1")
    member = join_groups(member.select("node", "doc_id", "times", "is"), together, ["is"], "size", how="left")
    names = member.select(F.col("node").alias("set_id"), "times", F.coalesce("__component", "doc_id").alias("__component"))
    found = join_groups(rows.select("doc_id", "n_shingles", "set_id"), names, ["set_id"], "times", how="left")
    own = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("__component"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one document of each group of near duplicates; all columns, whatever they are called.

    Rows that near_groups does not keep go, all others stay: null and empty texts, rows without id, all rows of an id
    that stays.  An empty table gives no rows.
    """
    gone = near_groups(docs, words, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone["__gone"], "left_anti")


def near_sql(words: int, percent: int) -> str:
    """DuckDB SQL for near_groups over documents of distinct ids: all pairs that share a shingle, for small tables."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.x, p.y FROM p JOIN n i ON i.doc_id = p.x JOIN n j ON j.doc_id = p.y WHERE 100 * p.c >= {percent} * (i.n + j.n - p.c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.reach) AS component_id, r.doc_id = min(r.reach) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
