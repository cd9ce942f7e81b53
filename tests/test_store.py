"""Stores: versions, walks and pushes that build nothing, updates that rewrite what they touch."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions import columns
from wayfare.operators import counted, stored
from wayfare.operators.updates import MissingEdges
from wayfare.sources.store import Store

MIXED4 = [(0, 1, 1), (0, 2, 6), (0, 3, 2), (1, 0, 3), (1, 2, 1), (2, 0, 2), (2, 3, 5)]


def as_edges(frame):
    return Counter((r.src, r.dst, r.w) for r in frame.select("src", "dst", "w").collect())


def plain(rows):
    return Counter((a, b, float(w)) for a, b, w in rows)


def power(rows, u, length):
    total = defaultdict(float)
    for a, _, w in rows:
        total[a] += w
    state = {u: 1.0}
    for _ in range(length):
        new = defaultdict(float)
        for a, b, w in rows:
            if a in state:
                new[b] += state[a] * w / total[a]
        state = new
    return dict(state)


def checked(store, rows):
    """The store's tables agree with the edges that they should stand for."""
    rows = [(a, b, float(w)) for a, b, w in rows]
    assert as_edges(stored.edges_of(store)) == Counter(rows)
    whole = lambda name: store.table(name).whole().collect()
    deg, total, bucket = Counter(a for a, _, _ in rows), Counter(), Counter()
    for a, _, w in rows:
        total[a] += w
        bucket[a, max(0, math.ceil(math.log2(w)))] += 1
    nodes = whole("nodes")
    assert {r.src: (r.deg, r.total) for r in nodes} == {a: (deg[a], total[a]) for a in deg} and len(nodes) == len(deg)
    assert {(r.src, b.bucket): b.cnt for r in nodes for b in r.buckets} == bucket
    # every edge has a place of its own, places are dense, and chunks and blocks tell the same
    cells = {(r.src, c.bucket, c.bpos): (c.dst, c.w) for r in whole("blocks") for c in r.cells}
    assert {(s, b, k) for (s, b), n in bucket.items() for k in range(n)} == set(cells) and len(cells) == len(rows)
    chunk = store.facts["chunk"]
    places = {(r.src, r.bucket, e.bpos): (e.dst, e.w) for r in whole("chunks") for e in r.edges if e.bpos // chunk == r.chunk}
    assert places == cells
    # what the alias slots of blocks, and of blocks in sources, imply
    implied, choice = Counter(), defaultdict(Counter)
    for r in whole("choice"):
        slots = next(n.slots for n in nodes if n.src == r.src)
        choice[r.src][r.block] += r.p / slots
        choice[r.src][r.other] += (1 - r.p) / slots
    for r in whole("blocks"):
        p = choice[r.src][r.block] if r.src in choice else 1.0
        for c in r.cells:
            implied[r.src, c.dst] += p * c.p / r.n
            implied[r.src, c.other] += p * (1 - c.p) / r.n
    want = Counter()
    for a, b, w in rows:
        want[a, b] += w / total[a]
    assert {k: p for k, p in implied.items() if p > 1e-12} == pytest.approx(want)


@pytest.fixture
def graph():
    rng = random.Random(21)
    hub = [(0, rng.getrandbits(40), rng.choice([1, 2, 3, 5, 9, 17])) for _ in range(200)]
    rest = [(s, rng.choice([0, 1, 2, hub[s][1]]), rng.randint(1, 20)) for s in range(1, 30) for _ in range(rng.randint(1, 6))]
    return hub + rest + [(d, 0, 1) for _, d, _ in hub[:100]] + [(5, 5, 4), (5, 5, 4), (5, 5, 9)]


def test_store_of_a_graph_and_its_updates(spark, edges, graph, tmp_path):
    folder = f"file://{tmp_path}/store"
    store = stored.create(edges(graph), folder, block=8, chunk=4)
    checked(store, graph)
    assert store.version == 0 and store.table("nodes").base.agg(F.max("blocks")).first()[0] == 32
    rng, rows = random.Random(22), list(graph)
    for k in range(1, 3):
        gone = rng.sample([r for r in rows if r[:2] != (5, 5)], 40) + ([(5, 5, 9)] if k == 1 else [])
        new = [(a, rng.getrandbits(40), rng.randint(1, 40)) for a, _, _ in rng.sample(gone, 25)] + [(10**6 + k, 1, 2), (10**6 + k, 2, 3), (0, 7, 1)]
        keys = Counter(r[:2] for r in gone)
        # of parallel edges the heaviest goes, so those are what leaves
        left = []
        for key in sorted({r[:2] for r in rows}):
            own = sorted((r for r in rows if r[:2] == key), key=lambda r: -r[2])
            left += own[keys[key] :]
        rows = left + new
        store = stored.update(stored.Store.open(spark, folder), edges(gone), edges(new), {"batch": k})
        assert store.version == k and store.facts["batch"] == k
        checked(Store.open(spark, folder), rows)
    checked(Store.open(spark, folder, 0), graph)
    # all edges of a source may go, and it may come back
    only = [r for r in rows if r[0] == 3]
    store = stored.update(stored.update(store, edges(only), edges([])), edges([]), edges([(3, 4, 2)]))
    rows = [r for r in rows if r[0] != 3] + [(3, 4, 2)]
    packed = stored.compact(store, 0.01)
    assert packed.version == store.version + 1 and packed.table("blocks").live is None and stored.compact(packed) is packed
    checked(packed, rows)
    with pytest.raises(MissingEdges, match="77"):
        stored.update(store, edges([(0, 77, 1)]), edges([]))
    with pytest.raises(MissingEdges):
        stored.update(store, edges([(987654, 1, 1)]), edges([]))
    # a commit of a version that is there already fails, and changes nothing
    with pytest.raises(Exception, match="(?i)exists"):
        stored.update(store, edges([]), edges([(3, 5, 2)]))
    assert Store.open(spark, folder).version == packed.version
    with pytest.raises(ValueError, match="version"):
        Store.open(spark, folder, 99)


def test_an_update_of_a_hub_rewrites_few_blocks(spark, edges, tmp_path):
    rng = random.Random(23)
    n = 100_000
    hub = spark.range(n).select(F.lit(0).cast("long").alias("src"), F.xxhash64("id").alias("dst"), (F.lit(1.0) + F.col("id") % 7).alias("w"))
    store = stored.create(hub, f"file://{tmp_path}/store")
    gone = [(r.src, r.dst, r.w) for r in hub.filter(F.col("dst") % 9973 == rng.randint(0, 9)).limit(10).collect()]
    after = stored.update(store, edges(gone), edges([]))
    assert 0 < after.table("blocks").live.count() <= 20 and after.table("chunks").live.count() <= 2 * len(gone)
    assert stored.edges_of(after).count() == n - len(gone)
    assert after.table("nodes").whole().first().deg == n - len(gone)


@pytest.mark.parametrize("how", ["prefix", "alias", "rejection"])
def test_walks_on_a_store(spark, edges, asked, graph, tmp_path, how):
    folder, n = f"file://{tmp_path}/store", 3000
    stored.create(edges(graph), folder, block=8)
    hub = [r for r in graph if r[0] == 0]
    gone, new = hub[:60] + [(5, 5, 9)], [(0, 1, 400), (5, 3, 7), (77, 0, 2)]
    stored.update(Store.open(spark, folder), edges(gone), edges(new))
    rows = list(graph)
    for r in gone:
        rows.remove(r)
    rows += new
    store = Store.open(spark, folder)
    for length in (0, 3):
        got = {(r.query_id, r.node): r.p for r in stored.walk(store, asked(0, 5, 77, 999_999), n, length, how).collect()}
        want = {(q, v): p for q, u in enumerate((0, 5, 77)) for v, p in power(rows, u, length).items()} | ({(3, 999_999): 1.0} if not length else {})
        assert set(got) <= set(want)
        for key, p in want.items():
            assert abs(got.get(key, 0) - p) <= 6 * math.sqrt(p * (1 - p) / n) + 6 / n
    assert how == "rejection" or sum(r.cnt for r in stored.walk(store, asked(0), 50, 4, how, dangling="stay").collect()) == 50
    with pytest.raises(ValueError, match="walk"):
        stored.walk(store, asked(0), 1, 1, "random")


def test_pushes_on_a_store(spark, edges, asked, tmp_path):
    store = stored.create(edges(MIXED4), f"file://{tmp_path}/store", block=2, chunk=1)
    store = stored.update(store, edges([(0, 2, 6)]), edges([(0, 2, 3), (3, 1, 1)]))
    rows, n = [(0, 2, 3) if r == (0, 2, 6) else r for r in MIXED4] + [(3, 1, 1)], 3000
    got = {r.node: r.p for r in stored.sampled_push(store, asked(0), n, 3).collect()}
    for node, p in power(rows, 0, 3).items():
        assert abs(got.get(node, 0) - p) <= 6 * math.sqrt(p / n) + 1e-9


def test_a_walk_builds_nothing(spark, edges, asked, graph, tmp_path):
    folder = f"file://{tmp_path}/store"
    store = stored.update(stored.create(edges(graph), folder, block=8), edges(graph[:3]), edges([]))
    for how in ("prefix", "alias"):
        plan = stored.walk(Store.open(spark, folder), asked(0), 10, 1, how)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Relation" in plan
    # a step's joins leave the base's buckets where they are
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        read = stored.create(edges(graph), f"{folder}-2", block=8).table("blocks")
        plan = read.meet(spark.createDataFrame([(0, 0)], "src long, block long"), ["src", "block"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    assert store.version == 1


def test_empty_stores(spark, edges, asked, tmp_path):
    store = stored.create(edges([]), f"file://{tmp_path}/store")
    assert stored.walk(store, asked(0), 5, 2).count() == 0 and stored.sampled_push(store, asked(0), 5, 2).count() == 0
    after = stored.update(store, edges([]), edges([(1, 2, 3)]))
    checked(after, [(1, 2, 3)])
    assert columns.push_samples(0.1, 5) == 20


def test_points_below_bounds():
    bounds = np.array([0.0, 0.1, 0.25, 0.7, 0.7000001, 1.0])
    whole = counted.below(10**12, bounds, 7)
    assert whole[0] == 0 and whole[-1] == 10**12 and (np.diff(whole) >= 0).all()
    for n, at in zip(whole.tolist(), bounds.tolist(), strict=True):
        assert abs(n - 10**12 * at) <= 6 * math.sqrt(10**12 * at * (1 - at)) + 1
    # each bound by itself finds the same points
    assert [int(counted.below(10**12, bounds[k : k + 1], 7)[0]) for k in range(6)] == whole.tolist()
    assert counted.below(10**12, bounds, 8).tolist() != whole.tolist() and counted.below(0, bounds, 7).tolist() == [0] * 6
    small = sum(counted.below(20, np.array([0.3]), k)[0] for k in range(2000))
    assert abs(small - 12_000) <= 6 * math.sqrt(40_000 * 0.21)


def test_walks_by_their_numbers(spark, edges, asked, graph, tmp_path):
    n, length = 10**8, 3
    store = stored.create(edges(graph), f"file://{tmp_path}/store", block=8)
    gone = graph[:30]
    store = stored.update(store, edges(gone), edges([(0, 1, 400)]))
    rows = graph[30:] + [(0, 1, 400)]
    got = {(r.query_id, r.node): r.cnt for r in counted.walk(store, asked(0, 5), n, length).collect()}
    want = {(q, v): p for q, u in enumerate((0, 5)) for v, p in power(rows, u, length).items()}
    assert set(got) <= set(want)
    off = [(got.get(k, 0) - n * p) ** 2 / (n * p) for k, p in want.items()]
    assert sum(off) < len(off) + 6 * math.sqrt(2 * len(off))
    # few walks at a source of many blocks
    few = [r.cnt for r in counted.walk(store, asked(0), 7, 1).collect()]
    assert sum(few) == 7 and counted.walk(store, asked(0), 0, 1).count() == 0
