"""Graph operators on hand-made graphs, against plain Python versions of the definitions."""

import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayfare import catalog
from wayfare.functions import columns
from wayfare.operators import answers, exact, indexes, metrics, push, stats, stored, updates, walks
from wayfare.plans import ordered
from wayfare.plans.storage import materialize
from wayfare.sources import csr, derived, files, parts
from wayfare.sources.store import Store
from wayfare.streaming.ops import apply_batch, apply_stream

DATA = "/root/testdata/sf0.001"
CHAIN = [(0, 1, 1), (1, 2, 1)]
LOOP = [(0, 0, 1), (0, 1, 3), (1, 0, 2)]
PARALLEL = [(0, 1, 1), (0, 1, 2), (0, 2, 1), (1, 0, 1), (2, 0, 1)]
MIXED4 = [(0, 1, 1), (0, 2, 6), (0, 3, 2), (1, 0, 3), (1, 2, 1), (2, 0, 2), (2, 3, 5)]


def plain_power(rows, u, length):
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
    return {k: p for k, p in state.items() if p > 0}


def as_dict(answer):
    return {r.node: r.p for r in answer.collect()}


@pytest.mark.parametrize("rows", [CHAIN, LOOP, PARALLEL, MIXED4])
@pytest.mark.parametrize("length", [0, 1, 3])
def test_power(edges, asked, rows, length):
    got = as_dict(exact.power_method(edges(rows), asked(0), length))
    assert got == pytest.approx(plain_power(rows, 0, length))


def test_power_known_values_and_long_walks(edges, asked):
    assert as_dict(exact.power_method(edges(MIXED4), asked(0), 3)) == pytest.approx({0: 0.0079, 1: 0.0304, 2: 0.1825, 3: 0.0807}, abs=1e-4)
    assert as_dict(exact.power_method(edges(LOOP), asked(0), 9)) == pytest.approx(plain_power(LOOP, 0, 9))
    assert exact.power_method(edges(CHAIN), asked(2), 1).count() == 0


@pytest.mark.parametrize("walk", [walks.prefix_walk, walks.alias_walk, walks.rejection_walk])
def test_walks_are_near_the_exact_distribution(edges, asked, walk):
    n = 4000
    got = as_dict(walk(edges(PARALLEL), asked(0), n, 3))
    want = plain_power(PARALLEL, 0, 3)
    assert set(got) <= set(want)
    for node, p in want.items():
        assert abs(got.get(node, 0) - p) <= 5 * math.sqrt(p * (1 - p) / n) + 1e-9


@pytest.mark.parametrize("walk", [walks.prefix_walk, walks.alias_walk, walks.rejection_walk])
def test_dangling_policies(edges, asked, walk):
    g = edges(CHAIN)
    assert as_dict(walk(g, asked(0), 10, 2)) == {2: 1.0}
    assert as_dict(walk(g, asked(0), 10, 3)) == {}
    assert as_dict(walk(g, asked(0), 10, 3, dangling="stay")) == {2: 1.0}
    assert as_dict(walk(g, asked(2), 10, 1)) == {}
    assert as_dict(walk(g, asked(0), 10, 0)) == {0: 1.0}
    with pytest.raises(ValueError, match="policy"):
        walk(g, asked(0), 10, 1, dangling="jump")


def test_rejection_retries_until_accepted(edges, asked):
    # an attempt at 0 is accepted once in a thousand times, so 64 of them would lose 94 percent of the walks
    rows = [(0, d, 1) for d in range(1, 1000)] + [(0, 1000, 2.0**20)] + [(d, 0, 1) for d in range(1, 1001)]
    assert walks.least_acceptance(edges(rows)).first().acceptance < 0.0011
    n = 200
    got = walks.rejection_walk(edges(rows), asked(0), n, 3)
    assert got.agg(F.sum("cnt")).first()[0] == n
    assert as_dict(got)[1000] >= 0.95
    first, later = (as_dict(walks.rejection_walk(edges(rows), asked(0), 50, 1, attempts=k)) for k in (1, 5000))
    assert first == later
    # no weight at all leaves nothing to accept
    assert as_dict(walks.rejection_walk(edges([(0, 1, 0)]), asked(0), 5, 1)) == {}
    with pytest.raises(ValueError, match="attempts"):
        walks.rejection_walk(edges(CHAIN), asked(0), 5, 1, attempts=0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_rejection_on_skewed_weights(spark, asked):
    g = materialize(derived.skewed(spark, DATA), "skewed")
    sources, n = [r.u for r in updates.max_queries(g, 2).collect()], 3000
    got = {(r.query_id, r.node): r.p for r in walks.rejection_walk(g, asked(*sources), n, 2).collect()}
    want = {(r.query_id, r.node): r.p for r in exact.power_method(g, asked(*sources), 2).collect()}
    for q in range(2):
        assert sum(p for k, p in got.items() if k[0] == q) == pytest.approx(sum(p for k, p in want.items() if k[0] == q))
    assert set(got) <= set(want)
    for key, p in want.items():
        assert abs(got.get(key, 0) - p) <= 6 * math.sqrt(p * (1 - p) / n) + 6 / n


def test_sampled_push_is_unbiased(edges, asked):
    n = 3000
    got = as_dict(push.sampled_push(edges(MIXED4), asked(0), n, 3))
    for node, p in plain_power(MIXED4, 0, 3).items():
        assert abs(got.get(node, 0) - p) <= 6 * math.sqrt(p / n) + 1e-9
    assert as_dict(push.sampled_push(edges(MIXED4), asked(0), 0, 3)) == {}


def test_push_hands_on_exact_mass_in_heavy_buckets(edges, asked):
    # one out-edge: its bucket bound is at least the total, so nothing is left to chance
    assert as_dict(push.sampled_push(edges(CHAIN), asked(0), 7, 2)) == {2: 1.0}


def test_alias_slots_imply_the_weights(edges):
    rng = random.Random(5)
    rows = [(s, d, rng.choice([1, 1, 2, 3, 50, 7])) for s in range(12) for d in range(rng.randint(1, 30))]
    index = indexes.alias_index(edges(rows))
    assert index.filter("p < 0 or p > 1").count() == 0
    total = Counter()
    for s, _, w in rows:
        total[s] += w
    got = {(r.src, r.dst): r.p for r in indexes.alias_distribution(index).collect()}
    for s, d, w in rows:
        assert got[s, d] == pytest.approx(w / total[s], abs=1e-12)


def test_guided_prefix_index_is_small_and_complete(edges):
    rows = [(0, d, 1 + (d % 7) ** 3) for d in range(200)]
    guided = indexes.guided_prefix_index(edges(rows))
    assert guided.count() <= 2 * len(rows)
    assert guided.select("cell").distinct().count() == 200


def test_weight_bucket_at_powers_of_two(spark):
    exps = [(2.0**k, k) for k in range(32)] + [(2.0**k + 0.5, k + 1) for k in range(1, 31)] + [(0.75, 0)]
    got = spark.createDataFrame(exps, "w double, b int").select(columns.weight_bucket(F.col("w")).alias("g"), "b").collect()
    assert all(r.g == r.b for r in got)


def test_sample_sizes_truncate():
    assert [columns.walk_count(e) for e in (0.1, 0.01, 0.001, 0.0001, 0.00001)] == [40, 400, 4000, 40000, 399999]
    assert columns.push_samples(0.01, 10) == 400 and columns.push_samples(0.1, 0) == 0


def test_statistics(edges):
    g = edges(LOOP)
    assert stats.attribute(g).first()[:2] == (2, 3)
    assert {(r.src, r.deg) for r in stats.out_degree(g).collect()} == {(0, 2), (1, 1)}
    assert {(r.dst, r.deg) for r in stats.in_degree(g).collect()} == {(0, 2), (1, 1)}
    assert [r.node for r in stats.dangling_nodes(edges(CHAIN)).collect()] == [2]
    assert stats.validate(edges([(0, 1, 0.5), (0, 1, 0.6), (0, 1, 2.0**31), (0, 1, 2.0**31 + 1)])).count() == 2


def plain_conductance(answer, rows):
    vol, whole = defaultdict(float), 0.0
    for a, _, w in rows:
        vol[a] += w
        whole += w
    cut_nodes, cut, v, best = set(), 0.0, 0.0, 1.0
    for p, u in sorted(((p, u) for u, p in answer.items()), reverse=True):
        if u not in vol:
            continue
        v += vol[u]
        cut_nodes.add(u)
        for a, b, w in rows:
            if a == u:
                cut += -w if b in cut_nodes else w
        if cut <= 0:
            cut = 0.0
            continue
        small = min(v, whole - v)
        if small > 0:
            best = min(best, cut / small)
    return best


def test_metrics(spark, edges):
    rng = random.Random(9)
    for _ in range(4):
        n = 9
        rows = [(a, b, rng.randint(1, 5)) for a in range(n) for b in range(n) if rng.random() < 0.3]
        answer = {k: rng.random() for k in range(n) if rng.random() < 0.7}
        truth = {k: rng.random() for k in range(n) if rng.random() < 0.7}
        frame = lambda x: spark.createDataFrame([(0, k, p) for k, p in x.items()], "query_id long, node long, p double")
        a, t, g = frame(answer), frame(truth), edges(rows)
        off = {k: abs(answer.get(k, 0) - truth.get(k, 0)) for k in answer.keys() | truth.keys()}
        assert metrics.l1_error(a, t).first().l1 == pytest.approx(sum(off.values()))
        assert metrics.max_additive_error(a, t).first().max_ae == pytest.approx(max(off.values()))
        assert metrics.conductance(a, g).first().conductance == pytest.approx(plain_conductance(answer, rows))
        assert metrics.precision_at_k(a, t, n).first().precision == 1.0
        assert metrics.l1_error(t, t).first().l1 == 0


def test_precision_ties_and_filling(spark):
    frame = lambda x: spark.createDataFrame([(0, k, p) for k, p in x.items()], "query_id long, node long, p double")
    truth = {k: 0.1 for k in range(3)} | {k: 0.01 for k in range(10, 13)}
    # places 4 to 6 tie, so all six count for k = 4
    assert metrics.precision_at_k(frame({12: 0.5, 11: 0.4, 10: 0.3, 0: 0.2}), frame(truth), 20, 4).first().precision == 1.0
    # one answer; 0, 1 and 2 fill it up
    assert metrics.precision_at_k(frame({15: 0.5}), frame(truth), 20, 4).first().precision == 0.75


def test_where_the_greatest_error_is(spark):
    frame = lambda x: spark.createDataFrame([(0, k, p) for k, p in x.items()], "query_id long, node long, p double")
    most = lambda a, t: tuple(metrics.max_additive_error(frame(a), frame(t)).first())[1:]
    assert most({1: 0.5}, {1: 0.5, 5: 0.2, 3: 0.2}) == (0.2, 3, 0.0, 0.2)
    assert most({1: 0.4, 2: 0.4, 7: 0.1}, {1: 0.2, 2: 0.2, 0: 0.2}) == (0.2, 2, 0.4, 0.2)
    assert most({1: 0.4}, {1: 0.4}) == (0.0, None, None, None)


def test_hubs_are_numbered_in_ranges(edges, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP", 20)
    rng = random.Random(12)
    # neighbours as far apart as hashes are; sources of 50 edges are hubs here, those of 5 are not
    ids = [rng.getrandbits(62) for _ in range(60)]
    rows = [(s, rng.choice(ids), rng.choice([1, 2, 4, 9])) for s in range(4) for _ in range(50 if s < 3 else 5)]
    want, at = {}, defaultdict(lambda: [0, 0.0])
    for s, d, w in sorted(rows):
        want[s, at[s][0]] = (d, at[s][1], at[s][1] + w)
        at[s] = [at[s][0] + 1, at[s][1] + w]
    got = indexes.prefix_index(edges(rows)).collect()
    assert {(r.src, r.pos): (r.dst, r.lo, r.hi) for r in got} == want and {(r.src, r.deg, r.total) for r in got} == {(s, n, t) for s, (n, t) in at.items()}
    by_bucket = Counter((r.src, r.bucket) for r in indexes.bucket_index(edges(rows)).collect())
    assert {(r.src, r.bucket): r.cnt for r in indexes.bucket_totals(edges(rows)).collect()} == by_bucket
    total = {s: t for s, (_, t) in at.items()}
    implied = {(r.src, r.dst): r.p for r in indexes.alias_distribution(indexes.alias_index(edges(rows))).collect()}
    weight = Counter()
    for s, d, w in rows:
        weight[s, d] += w / total[s]
    assert {k: p for k, p in implied.items() if p > 1e-12} == pytest.approx(weight)


@pytest.mark.parametrize("build", [indexes.prefix_index, indexes.alias_index, csr.csr_edges])
def test_no_window_goes_over_a_hub(edges, monkeypatch, build):
    monkeypatch.setattr(ordered, "GROUP", 100)
    rng = random.Random(13)
    plan = build(edges([(0, rng.getrandbits(62), rng.randint(1, 9)) for _ in range(2000)]))._jdf.queryExecution().optimizedPlan().toString()
    # windows of hubs go over a range, or over what the ranges come to; others have no row of a hub
    hub = [line for line in plan.splitlines() if "Window" in line and "__range" not in line and "__fine" not in line and "__sum_" not in line and "__min_" not in line]
    assert all("Window" in line for line in hub) and plan.count("__fine") > 0
    assert plan.count("LeftAnti") >= 1


def test_push_meets_few_edges_of_a_hub(edges, spark):
    n, samples = 20_000, 50
    hub = edges([(0, d, 1 + d % 2) for d in range(1, n)])
    totals, index = indexes.bucket_totals(hub), indexes.bucket_index(hub)
    state = push.start(spark.createDataFrame([(0, 0)], "query_id long, u long"), samples)
    unit = F.col("p") / F.col("total")
    met = state.join(totals, F.col("node") == F.col("src")).select("query_id", "sample", "src", "bucket", F.col("cnt").cast("long").alias("cnt"), unit.alias("unit"), (unit * F.col("maxw")).alias("q"))
    found = push.hits(met, "push", 1)
    # one edge is handed on for each sample on average, and the bounds are the weights here
    assert abs(found.count() - samples) < 6 * math.sqrt(samples)
    assert found.groupBy("sample", "bucket", "bpos").count().filter("count > 1").count() == 0
    assert push.offers(state, *push.lookups(totals, index), "push", 1).filter("mass <> 1").count() == 0


def test_written_tables_are_removed(spark, edges, asked):
    from wayfare.plans import storage

    walks.alias_walk(edges(LOOP), asked(0), 5, 2).collect()
    assert any(t.name.startswith("alias_index") for t in spark.catalog.listTables())
    storage.clear(spark)
    assert not any(t.name.startswith("alias_index") for t in spark.catalog.listTables())
    storage.clear(spark)


def test_answers(spark):
    a = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.1)], "query_id long, node long, p double")
    b = spark.createDataFrame([(0, 2, 0.5), (0, 9, 0.6)], "query_id long, node long, p double")
    assert [r.node for r in answers.ranked(a).orderBy("rank").collect()] == [2, 1, 3]
    assert {r.node for r in answers.support_union(a, b).collect()} == {1, 2, 3, 9}
    assert {r.node for r in answers.support_missing(a, b).collect()} == {1, 3}
    assert {r.node for r in answers.topk_intersection(a, b, 2).collect()} == {2}
    assert answers.reached_count(a).first().reached == 3


def as_edges(frame):
    return Counter((r.src, r.dst, r.w) for r in frame.select("src", "dst", "w").collect())


def test_updates(edges):
    g = edges(PARALLEL + MIXED4)
    ops = updates.generate_ops(edges(MIXED4), 4)
    rows = [(r.src, r.dst, r.w) for r in ops.collect()]
    assert len(set(rows)) == 4 and set(rows) <= {(a, b, float(w)) for a, b, w in MIXED4}
    assert updates.generate_ops(edges(MIXED4), 100).count() == 7
    # parallel edges are one operation
    assert sorted((r.src, r.dst, r.w) for r in updates.generate_ops(edges(PARALLEL), 100).collect()) == [(0, 1, 2.0), (0, 2, 1.0)]
    # of parallel edges one goes
    gone = updates.delete(edges(PARALLEL), edges([(0, 1, 9)]))
    assert as_edges(gone) == Counter({(0, 1, 1.0): 1, (0, 2, 1.0): 1, (1, 0, 1.0): 1, (2, 0, 1.0): 1})
    with pytest.raises(updates.MissingEdges):
        updates.apply(g, edges([(0, 77, 1)]), edges([]))
    # delete and insert the same edges: all as before, indexes too
    m = edges(MIXED4)
    after = updates.apply(m, ops, ops)
    assert as_edges(after) == as_edges(m)
    for build in (indexes.prefix_index, indexes.bucket_index, indexes.alias_index):
        fresh = updates.refresh(build(m), after, updates.touched(ops), build)
        assert sorted(map(tuple, fresh.collect())) == sorted(map(tuple, build(m).collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_updates_of_the_references_number_of_edges(spark):
    g = materialize(derived.transitions(spark, DATA.replace("sf0.001", "sf0.01")), "graph")
    ops = materialize(updates.generate_ops(g, 100_000), "ops")
    again = ops.withColumn("w", F.col("w") + 1)
    after = materialize(updates.apply(g, ops, again), "updated")
    assert ops.select("src").distinct().count() > 40
    fresh = updates.refresh(indexes.prefix_index(g), after, updates.touched(ops, again), indexes.prefix_index)
    assert sorted(map(tuple, fresh.collect())) == sorted(map(tuple, indexes.prefix_index(after).collect()))


def test_queries_by_degree(edges):
    g = edges(MIXED4)
    got = Counter(r.u for r in updates.generate_queries(g, 700).collect())
    assert sum(got.values()) == 700 and set(got) == {0, 1, 2} and abs(got[0] - 300) < 80
    assert [r.u for r in updates.max_queries(g, 2).orderBy("query_id").collect()] == [0, 1]


def test_many_draws_by_degree(spark):
    deg = {s: 1 + (s * 7) % 40 for s in range(300)}
    g = spark.createDataFrame([(s * 10**12, d, 1.0) for s, n in deg.items() for d in range(n)], "src long, dst long, w double")
    many, m = 100_000, sum(deg.values())
    found = updates.generate_queries(g, many)
    got = {r.u: r.n for r in found.groupBy("u").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == many and found.select("query_id").distinct().count() == many
    assert sum((got.get(s * 10**12, 0) - many * n / m) ** 2 / (many * n / m) for s, n in deg.items()) < 300 + 6 * math.sqrt(600)
    assert updates.generate_queries(g.limit(0), 5).count() == 0


def test_csr(spark, edges, tmp_path):
    g = edges(MIXED4)
    assert [r.ptr for r in csr.out_ptr(g, 4).orderBy("src").collect()] == [0, 3, 5, 7, 7]
    assert as_edges(csr.from_flat(csr.placed_edges(g, 4), csr.out_ptr(g, 4))) == as_edges(g)
    csr.write_binary(g, 4, str(tmp_path), "m4", vertices=2)
    back = csr.read_binary(spark, str(tmp_path), "m4")
    # the parts, one after the other, are the files as others have them
    for ending, kind in (("outPtr", "<u4"), ("outEdges", "<u4"), ("outWEdges", "<f8")):
        parts = sorted((tmp_path / f"m4.{ending}").glob("part-*"))
        (tmp_path / f"one.{ending}").write_bytes(b"".join(x.read_bytes() for x in parts))
    (tmp_path / "one.attribute").write_text("n 4\nm 7\n")
    assert (tmp_path / "one.outPtr").stat().st_size == 20
    assert sorted(map(tuple, csr.read_binary(spark, str(tmp_path), "one").collect())) == sorted(map(tuple, back.collect()))
    with pytest.raises(ValueError, match="shared file system"):
        csr.write_binary(g, 4, "hdfs://there/x", "m4")
    assert as_edges(back) == as_edges(g)
    assert sorted((r.src, r.pos) for r in back.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert files.read_attribute(spark, str(tmp_path / "m4.attribute")).first() == (4, 7)


def test_a_csr_write_counts_as_a_whole_or_not_at_all(spark, edges, tmp_path):
    at, ten = str(tmp_path), [(k, (k + 1) % 10, 1) for k in range(10)]
    read = lambda: as_edges(csr.read_binary(spark, at, "x"))
    csr.write_binary(edges(ten), 10, at, "x", vertices=4)
    assert read() == Counter((a, b, 1.0) for a, b, _ in ten) and len(list((tmp_path / "x.outPtr").iterdir())) == 3
    # other cuts, other weights, fewer vertices: nothing of the first write is left
    csr.write_binary(edges([(a, b, 7) for a, b, _ in ten[:6]]), 8, at, "x", vertices=100)
    assert read() == Counter((a, b, 7.0) for a, b, _ in ten[:6])
    assert all(len(list((tmp_path / f"x.{e}").iterdir())) == 1 for e in csr.ENDINGS)
    # a task fails: what was there stays, and what the others have written is in no list
    broken = edges(ten).withColumn("w", F.when(F.col("src") == 9, F.raise_error(F.lit("no weight"))).otherwise(F.lit(2.0)).cast("double"))
    with pytest.raises(Exception, match="no weight"):
        csr.write_binary(broken, 10, at, "x", vertices=1)
    assert read() == Counter((a, b, 7.0) for a, b, _ in ten[:6])
    # a task that is tried again leaves files of its first try, which don't count
    (tmp_path / "x.outPtr" / csr.part_name(0, "0lost")).write_bytes(b"abc")
    assert read() == Counter((a, b, 7.0) for a, b, _ in ten[:6])
    csr.write_binary(edges(ten), 10, at, "x", vertices=3)
    assert read() == Counter((a, b, 1.0) for a, b, _ in ten) and len(list((tmp_path / "x.outPtr").iterdir())) == 4
    csr.write_binary(edges([]), 0, at, "x")
    assert read() == Counter()
    with pytest.raises(Exception, match="exists"):
        edges([]).write.format("csr_graph").mode("append").option("label", "x").option("n", 0).save(at)


def test_files(spark, edges, tmp_path):
    (tmp_path / "g.txt").write_text("0 1 2.5\n\n1\t0   1e-5\n")
    assert as_edges(files.read_edges(spark, str(tmp_path / "g.txt"))) == Counter({(0, 1, 2.5): 1, (1, 0, 1e-5): 1})
    assert as_edges(files.read_edges(spark, str(tmp_path / "g.txt"), "affinity")) == Counter({(0, 1, 250000.0): 1, (1, 0, 1.0): 1})
    with pytest.raises(ValueError, match="rescale"):
        files.read_edges(spark, str(tmp_path / "g.txt"), "other")
    (tmp_path / "q.query").write_text("5\n7\n9\n\n")
    assert [tuple(r) for r in files.read_queries(spark, str(tmp_path / "q.query"), 2).collect()] == [(0, 5), (1, 7)]
    answer = spark.createDataFrame([("a", "g", 2, "0.1", 3, 1, 0.5), ("a", "g", 2, "0.1", 3, 2, 1e-16)], "algo string, label string, L int, eps string, u long, node long, p double")
    files.write_answers(answer, str(tmp_path / "answers"))
    assert [(r.u, r.node, r.p) for r in files.read_answers(spark, str(tmp_path / "answers")).collect()] == [(3, 1, 0.5)]
    log = "0.1 0.2\nmy-add-delete-memory new del update time: 0.25\nx new add update time: 7.5e-1\nTotal graph: peak memory: 1.5 G\nnew del update time: none\n"
    (tmp_path / "u.log").write_text(log)
    assert [(r.line, r.kind, r.value) for r in files.parse_log(spark, str(tmp_path / "u.log")).orderBy("line").collect()] == [(1, "delete", 0.25), (2, "insert", 0.75), (3, "memory", 1.5)]
    (tmp_path / "g.op").write_text("5 1 2.5\n4 2 1\n\n3 3 0.5\n")
    assert [tuple(r) for r in files.read_ops(spark, str(tmp_path / "g.op")).orderBy("seq").collect()] == [(0, 5, 1, 2.5), (1, 4, 2, 1.0), (2, 3, 3, 0.5)]
    files.write_answer_text(answer, str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).orderBy("value").collect()] == ["1 0.500000000000000", "2 0.000000000000000"]
    assert [(r.u, r.node, r.p) for r in files.read_answer_text(spark, str(tmp_path / "text")).collect()] == [(3, 1, 0.5)]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "long.query").write_text("".join(f"{k}\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = files.read_queries(spark, str(tmp_path / "long.query")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == [(k, k) for k in range(3000)]


def test_reports(spark):
    runs = spark.createDataFrame([("a", "g", 2, k, k / 10) for k in range(7)], "algo string, label string, L int, eps_idx int, avg_sec double")
    errors = spark.createDataFrame([("a", "g", 2, k, k / 5, 0.5, 0.25) for k in range(7)], "algo string, label string, L int, eps_idx int, precision double, conductance double, max_ae double")
    assert updates.metric_series(runs, errors).count() == 15
    assert {r.value for r in updates.metric_series(runs, errors, metrics=("conductance",)).collect()} == {0.5}
    values = [("g", a, k, v) for a, k, v in (("base", "delete", 1.0), ("base", "insert", 3.0), ("base", "memory", 2.0), ("a", "delete", 6.0), ("a", "insert", 8.0), ("a", "memory", 5.0))]
    over = updates.update_overhead(spark.createDataFrame(values, "label string, algo string, kind string, value double"), "base")
    assert {r.algo: (r.seconds, r.overhead, r.memory, r.memory_overhead) for r in over.collect()} == {"base": (2.0, 0.0, 2.0, 0.0), "a": (7.0, 5.0, 5.0, 3.0)}
    points = updates.precision_points(runs, errors, over, spark.createDataFrame([("g", 3)], "label string, eps_idx int"))
    assert [tuple(r) for r in points.collect()] == [("a", "g", 0.3, 5.0, 0.6)]


def test_stream(spark, edges, tmp_path):
    g = edges(MIXED4 + [(k, 0, 1) for k in range(10, 40)])
    incoming = str(tmp_path / "in")
    spark.createDataFrame([("delete", 0, 1, 1.0), ("insert", 3, 0, 4.0)], "op string, src long, dst long, w double").coalesce(1).write.parquet(incoming)
    stream = spark.readStream.schema("op string, src long, dst long, w double").parquet(incoming)
    after = apply_stream(spark, g, stream, str(tmp_path / "graph"))
    want = as_edges(g)
    del want[0, 1, 1.0]
    want[3, 0, 4.0] = 1
    assert as_edges(after) == want
    # the batch again changes nothing, a new file goes on from where the stream was
    at = str(tmp_path / "graph/store")
    again = apply_batch(spark, at, spark.read.parquet(incoming), 0)
    assert again.version == 1 and as_edges(stored.edges_of(again)) == want
    spark.createDataFrame([("insert", 9, 9, 1.0)], "op string, src long, dst long, w double").coalesce(1).write.mode("append").parquet(incoming)
    want[9, 9, 1.0] = 1
    assert as_edges(apply_stream(spark, edges([]), stream, str(tmp_path / "graph"))) == want
    # what a batch writes follows the batch
    assert Store.open(spark, at).table("blocks").live.count() == 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stream_query_takes_a_batch_for_each_file(spark, monkeypatch):
    taken, update = [], stored.update
    monkeypatch.setattr(stored, "update", lambda *args: taken.append(args[3]) or update(*args))
    assert catalog.queries()["update_stream"](spark, DATA).count() > 0
    assert taken == [{"batch": 0}, {"batch": 1}]


def test_all_eps_in_one_run(edges, asked):
    g = edges(MIXED4)
    for run in (walks.prefix_walk, walks.alias_walk, push.sampled_push):
        both = run(g, asked(0, 1), [40, 7], 2).collect()
        for k, n in enumerate((40, 7)):
            alone = {(r.query_id, r.node): r.p for r in run(g, asked(0, 1), n, 2).collect()}
            assert {(r.query_id, r.node): r.p for r in both if r.eps_idx == k} == pytest.approx(alone)


def test_empty_graph(edges, asked):
    g = edges([])
    assert exact.power_method(g, asked(0), 2).count() == 0
    assert walks.prefix_walk(g, asked(0), 3, 2).count() == 0
    assert push.sampled_push(g, asked(0), 3, 2).count() == 0


def test_steps_read_the_parts_of_their_frontier(spark, edges, asked, tmp_path):
    rows = [(a, b, 1 + a * b % 5) for a in range(200) for b in (a + 1, a + 7, a * 3 % 211)] + [(500, b, 1.0) for b in range(3000)]
    parts.write_parts(edges(rows), str(tmp_path), 16)
    graph = parts.open_parts(spark, str(tmp_path))
    files_of = lambda df: {os.path.dirname(r.f) for r in df.select(F.input_file_name().alias("f")).distinct().collect()}
    assert graph.parts == 16 and len(files_of(graph.edges)) == 16
    one = spark.createDataFrame([(3,)], "node long")
    met, totals = graph.at(one)
    assert len(files_of(met)) == len(files_of(totals)) == 1
    assert sorted(map(tuple, met.collect())) == sorted((a, b, float(w)) for a, b, w in rows if a == 3)
    assert "PartitionFilters: [isnotnull(part" in met._jdf.queryExecution().toString() and "PushedFilters" in met._jdf.queryExecution().toString()
    many = spark.range(5, 40).select(F.col("id").alias("node"))
    met = {tuple(r) for r in graph.at(many)[0].collect()}
    assert {(a, b, float(w)) for a, b, w in rows if 5 <= a < 40} <= met <= {(a, b, float(w)) for a, b, w in rows}
    # no edge, no part
    assert graph.at(one.limit(0))[0].count() == 0
    for us, length in (((3,), 1), ((3, 500), 3), ((77,), 0), ((9999,), 2)):
        want = {(r.query_id, r.node): r.p for r in exact.power_method(edges(rows), asked(*us), length).collect()}
        assert {(r.query_id, r.node): r.p for r in exact.parted_power(graph, asked(*us), length).collect()} == pytest.approx(want)
    # written again with other parts
    parts.write_parts(edges(rows[:10]), str(tmp_path), 3)
    again = parts.open_parts(spark, str(tmp_path))
    assert again.parts == 3 and again.edges.count() == 10


def test_alias_slots_are_dealt_by_rows(edges, monkeypatch):
    """A task gets so many edges, whatever the input; with a fixed number of tasks it sorted ever more of them."""
    monkeypatch.setattr(indexes, "ALIAS_EDGES", 200)
    rows = [(s, t, 1 + (s + t) % 5) for s in range(50) for t in range(40)]
    index = indexes.alias_index(edges(rows))
    assert index.rdd.getNumPartitions() == 10
    got = {(r.src, r.dst): r.p for r in indexes.alias_distribution(index).collect()}
    total = {s: sum(w for a, _, w in rows if a == s) for s in range(50)}
    assert got == pytest.approx({(s, t): w / total[s] for s, t, w in rows})


def test_graphs_of_orders_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(derived, "LINES", 1000)
    lines = derived.table(spark, DATA, "lineitem").count()
    for graph in (derived.copurchase, derived.cust_supp):
        assert graph(spark, DATA).rdd.getNumPartitions() == math.ceil(lines / 1000)


@pytest.mark.parametrize("dangling", ["drop", "stay"])
def test_few_walks_index_the_nodes_at_hand_alone(edges, asked, monkeypatch, dangling):
    """The answer is that of an index of the whole graph; the edges of sources that no walk comes to are not indexed."""
    draw = random.Random(3)
    # nodes 0 to 19, of which 16 to 19 are dangling, and many sources that no edge leads to
    rows = [(s, t, draw.randint(1, 9)) for s in range(16) for t in draw.sample(range(20), 5)]
    g, build, sizes = edges(rows + [(s, t, 1) for s in range(100, 300) for t in range(5)]), walks.guided_prefix_index, []
    monkeypatch.setattr(walks, "guided_prefix_index", lambda e: sizes.append(e.count()) or build(e))
    got = walks.prefix_walk(g, asked(0, 7, 18), 60, 3, dangling=dangling).collect()
    assert len(sizes) == 3 and max(sizes) <= len(rows)
    whole = walks.prefix_walk(edges(rows), asked(0, 7, 18), 60, 3, dangling=dangling).collect()
    assert len(sizes) == 4 and sizes[3] == len(rows)
    assert sorted(got) == sorted(whole)


def test_few_samples_index_the_nodes_at_hand_alone(edges, asked, monkeypatch):
    rng = random.Random(9)
    rows = [(a, rng.randrange(50), rng.randint(1, 40)) for a in range(50) for _ in range(20)]
    graph, sizes, build = edges(rows), [], push.bucket_index
    monkeypatch.setattr(push, "bucket_index", lambda e: sizes.append(e.count()) or build(e))
    found = sorted(map(tuple, push.sampled_push(graph, asked(3, 7), [10, 30], 3).collect()))
    assert len(sizes) == 3 and sizes[0] == 40 and max(sizes) < len(rows)
    totals = push.bucket_totals(graph)
    whole = push.levels(asked(3, 7), [10, 30], 3, *push.lookups(totals, build(graph)), "push", 6)
    assert found == sorted(map(tuple, whole.collect()))


def test_a_single_power_step_writes_the_edges_of_its_sources_alone(edges, asked, monkeypatch):
    rows, sizes, write = [(a, b, a + b + 1) for a in range(20) for b in range(5)], [], exact.materialize
    monkeypatch.setattr(exact, "materialize", lambda df, label: sizes.append(df.count()) or write(df, label))
    found = {(r.query_id, r.node): r.p for r in exact.power_method(edges(rows), asked(3, 4), 1).collect()}
    assert sizes == [10]
    assert found == pytest.approx({(k, b): (u + b + 1) / sum(u + c + 1 for c in range(5)) for k, u in enumerate((3, 4)) for b in range(5)})


def test_the_metrics_graph_moves_its_pairs_once(spark, monkeypatch):
    monkeypatch.setattr(derived, "LINES", 1000)
    written, write = [], derived.bucketed
    monkeypatch.setattr(derived, "bucketed", lambda df, keys, label, buckets: written.append((df, buckets)) or write(df, keys, label, buckets))
    table = derived.copurchase_written(spark, DATA)
    df, buckets = written[0]
    # buckets grow with the lines, and dealing by them moves nothing anew
    assert buckets == -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 1000) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert str(df.repartition(buckets, "src")._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning(src") == 1
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, derived.copurchase(spark, DATA).collect()))


def test_the_metrics_graph_is_made_where_walks_go_alone(spark, asked):
    whole = {(r.src, r.dst): r.w for r in derived.copurchase(spark, DATA).collect()}
    begin = asked(1, 2).select(F.col("u").alias("src"))
    first = {b for a, b in whole if a in (1, 2)}
    # a node that is met again, as 1 is from its neighbours, has its edges once
    for steps, nodes in ((1, {1, 2}), (2, {1, 2} | first)):
        found = [tuple(r) for r in derived.copurchase_near(spark, DATA, begin, steps).collect()]
        assert sorted(found) == sorted((a, b, w) for (a, b), w in whole.items() if a in nodes)
    size = derived.copurchase_size(spark, DATA).first()
    assert (size.n, size.whole) == (max(map(max, whole)) + 1, sum(whole.values()))


def test_queries_of_answers_make_no_graph_and_no_truth(spark, monkeypatch):
    def fail(*args, **more):
        raise AssertionError("not needed")

    for name in ("copurchase", "copurchase_written", "copurchase_size"):
        monkeypatch.setattr(derived, name, fail)
    assert catalog.queries()["metric_l1"](spark, DATA).count() == 2
    monkeypatch.setattr(exact, "power_method", fail)
    for name in ("reached_count", "answer_sorted", "top_k_answer"):
        assert catalog.queries()[name](spark, DATA).count()


def test_size_of_orders_that_repeat_parts_or_have_none(spark, tmp_path):
    lines = [(1, 5), (1, 5), (1, 7), (2, 90), (2, 90), (3, None), (3, 4), (None, 8), (None, 9), (4, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tuple(derived.copurchase_size(spark, str(tmp_path)).first()) == (8, 4.0)
    assert tuple(stats.attribute(derived.copurchase(spark, str(tmp_path))).first())[:1] == (8,)
    near = derived.copurchase_near(spark, str(tmp_path), spark.range(5, 6).select(F.col("id").alias("src")), 2)
    assert sorted(map(tuple, near.collect())) == [(5, 7, 2.0), (7, 5, 2.0)]


def test_conductance_of_the_answers_edges_and_the_whole_weight(spark, edges):
    graph = edges([(0, 1, 4), (1, 0, 4), (1, 2, 1), (2, 1, 1), (2, 3, 5), (3, 2, 5)])
    answer = spark.createDataFrame([(0, 0, 0.6), (0, 1, 0.4)], "query_id long, node long, p double")
    assert metrics.conductance(answer, graph.filter("src < 2"), 20.0).collect() == metrics.conductance(answer, graph).collect()
