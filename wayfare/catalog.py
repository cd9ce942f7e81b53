"""All graph queries by name, with the SQL that checks them."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import columns
from wayfare.operators import answers, counted, exact, indexes, metrics, push, stats, stored, updates, walks
from wayfare.plans import oracle as sql
from wayfare.plans.storage import materialize, new_path
from wayfare.sources import csr, derived, files, parts
from wayfare.sources.store import Store
from wayfare.streaming.ops import apply_stream

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: Decimals of compared numbers.
DECIMALS = 9
#: Parameters of the walks and pushes.
WALKS, STEPS = 400, 5
PUSH_EPS, PUSH_LEVELS = 0.01, 3
SAMPLES = columns.push_samples(PUSH_EPS, PUSH_LEVELS)


def query(name: str, oracle: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return register


def rounded(name: str) -> Column:
    return F.round(name, DECIMALS).alias(name)


def sources(spark: SparkSession, us: list[int]) -> DataFrame:
    """queries(query_id, u)"""
    pairs = ", ".join(f"({k}L, {u}L)" for k, u in enumerate(us))
    return spark.sql(f"SELECT * FROM VALUES {pairs} AS v(query_id, u)")


# ---- graphs and statistics


@query("scan_edges", sql.graph("nation_trade") + " SELECT src, dst, w FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "edges-text")
    files.write_edges(derived.nation_trade(spark, d), path)
    return files.read_edges(spark, path)


@query("graph_attribute", sql.graph("copurchase") + " SELECT max(greatest(src, dst)) + 1 AS n, count(*) AS m, round(count(*) / (max(greatest(src, dst)) + 1) / 3, 9) AS avg_degree_div3 FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    return stats.attribute(derived.copurchase(spark, d)).select("n", "m", rounded("avg_degree_div3"))


for _name, _make, _sql in (
    ("out_degree", stats.out_degree, "SELECT src, count(*) AS deg FROM g GROUP BY src"),
    ("in_degree", stats.in_degree, "SELECT dst, count(*) AS deg FROM g GROUP BY dst"),
    ("out_weight", stats.out_weight, "SELECT src, sum(w) AS total FROM g GROUP BY src"),
    ("max_out_weight", stats.max_out_weight, "SELECT src, max(w) AS max_w FROM g GROUP BY src"),
    ("total_volume", stats.total_volume, "SELECT sum(w) AS volume FROM g"),
    ("dangling_nodes", stats.dangling_nodes, "SELECT DISTINCT dst AS node FROM g WHERE dst NOT IN (SELECT src FROM g)"),
    ("bucket_histogram", stats.bucket_histogram, f"SELECT src, {sql.BUCKET} AS bucket, count(*) AS cnt FROM g GROUP BY ALL"),
    ("max_bucket", stats.max_bucket, f"SELECT src, max({sql.BUCKET}) AS max_bucket FROM g GROUP BY src"),
    ("bucket_bitmap", stats.bucket_bitmap, f"SELECT src, CAST(sum(DISTINCT CAST(1 AS BIGINT) << {sql.BUCKET}) AS BIGINT) AS bitmap FROM g GROUP BY src"),
    (
        "bucket_capacity",
        stats.bucket_capacity,
        f"""SELECT src, bucket, cnt, greatest(CAST(ceil(1.5 * cnt) AS BIGINT), CAST(floor(ceil(sum(cnt) OVER (PARTITION BY src) / count(*) OVER (PARTITION BY src)) * CAST(1.2 AS DOUBLE)) AS BIGINT)) AS capacity
          FROM (SELECT src, {sql.BUCKET} AS bucket, count(*) AS cnt FROM g GROUP BY ALL)""",
    ),
    ("transition_matrix", lambda e: indexes.transition_matrix(e).select("src", "dst", rounded("p")), "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS p FROM g"),
    (
        "prefix_index",
        indexes.prefix_index,
        "SELECT src, pos, dst, hi - w AS lo, hi, total, deg FROM (SELECT *, sum(w) OVER (PARTITION BY src ORDER BY dst) AS hi, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INTEGER) AS pos, sum(w) OVER (PARTITION BY src) AS total, count(*) OVER (PARTITION BY src) AS deg FROM g)",
    ),
    ("weight_bucket", lambda e: e.select("src", "dst", columns.weight_bucket(F.col("w")).alias("bucket"), F.pow(F.lit(2.0), columns.weight_bucket(F.col("w"))).alias("bound")), f"SELECT src, dst, {sql.BUCKET} AS bucket, pow(CAST(2 AS DOUBLE), {sql.BUCKET}) AS bound FROM g"),
    ("bucket_index", indexes.bucket_index, f"SELECT src, {sql.BUCKET} AS bucket, CAST(row_number() OVER (PARTITION BY src, {sql.BUCKET} ORDER BY dst) - 1 AS INTEGER) AS bpos, dst, w, pow(CAST(2 AS DOUBLE), {sql.BUCKET}) AS maxw FROM g"),
    ("alias_index_distribution", lambda e: indexes.alias_distribution(indexes.alias_index(e)).filter("p > 1e-12").select("src", "dst", rounded("p")), "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS p FROM g"),
    ("affinity_rescale", lambda e: e.select("src", "dst", columns.affinity_rescale(F.col("w") / F.lit(1e7)).alias("w")), "SELECT src, dst, greatest(w / CAST(1e7 AS DOUBLE) * 100000, 1) AS w FROM g"),
):
    query(_name, f"{sql.graph('cust_supp')} {_sql}")(lambda spark, d, f=_make: f(derived.cust_supp(spark, d)))


@query(
    "sample_sizes",
    """SELECT r_regionkey, CAST(trunc(1 / eps / CAST(0.25 AS DOUBLE)) AS BIGINT) AS walks, CAST(trunc(CAST(0.1 AS DOUBLE) * 10 / eps * 4) AS BIGINT) AS samples_10, CAST(trunc(CAST(0.1 AS DOUBLE) * 5 / eps * 4) AS BIGINT) AS samples_5
      FROM (SELECT r_regionkey, CAST([0.1, 0.01, 0.001, 0.0001, 0.00001][r_regionkey + 1] AS DOUBLE) AS eps FROM region)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    eps = F.element_at(F.array(*map(F.lit, (0.1, 0.01, 0.001, 0.0001, 0.00001))), F.col("r_regionkey") + 1)
    return derived.table(spark, d, "region").select("r_regionkey", columns.walk_count_of(eps).alias("walks"), columns.push_samples_of(eps, 10).alias("samples_10"), columns.push_samples_of(eps, 5).alias("samples_5"))


@query("attribute_scan", sql.graph("nation_trade") + " SELECT CAST(max(greatest(src, dst)) + 1 AS BIGINT) AS n, count(*) AS m FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "attribute")
    found = stats.attribute(derived.nation_trade(spark, d)).select(F.explode(F.array(F.concat(F.lit("n "), F.col("n")), F.concat(F.lit("m "), F.col("m")))).alias("value"))
    found.write.text(path)
    return files.read_attribute(spark, path)


# ---- compressed sparse rows


def _nations(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    edges = materialize(derived.nation_trade(spark, d), "nation-trade")
    return edges, stats.attribute(edges).first().n


_PTR = sql.graph("nation_trade") + ", v AS (SELECT unnest(range((SELECT max(greatest(src, dst)) + 2 FROM g))) AS src) SELECT v.src, CAST((SELECT count(*) FROM g WHERE g.src < v.src) AS BIGINT) AS ptr FROM v"
_POS = sql.graph("nation_trade") + " SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INTEGER) AS pos, dst, w FROM g"


@query("csr_out_ptr", _PTR)
def _(spark: SparkSession, d: str) -> DataFrame:
    return csr.out_ptr(*_nations(spark, d))


@query("csr_edges", _POS)
def _(spark: SparkSession, d: str) -> DataFrame:
    return csr.csr_edges(_nations(spark, d)[0])


@query("csr_roundtrip", _POS)
def _(spark: SparkSession, d: str) -> DataFrame:
    edges, n = _nations(spark, d)
    return csr.from_flat(csr.placed_edges(edges, n), csr.out_ptr(edges, n))


@query("csr_binary", _POS)
def _(spark: SparkSession, d: str) -> DataFrame:
    """To binary files and back."""
    edges, n = _nations(spark, d)
    folder = new_path(spark, "csr")
    csr.write_binary(edges, n, folder, "nations", vertices=4)
    return csr.read_binary(spark, folder, "nations")


# ---- exact and sampled distributions


def _power(graph: str, us: list[int], length: int) -> Query:
    return lambda spark, d: exact.power_method(getattr(derived, graph)(spark, d), sources(spark, us), length).select("query_id", "node", rounded("p"))


for _name, _graph, _us, _length in (("power_step", "copurchase", [1], 1), ("power_method_L3", "copurchase", [1], 3), ("power_method_L10", "nation_trade", [3], 10), ("power_method_multi", "nation_trade", [1, 3, 5, 8], 4)):
    query(_name, f"{sql.graph(_graph, 'matrix')},\n{sql.power(_us, _length)} SELECT query_id, node, round(p, 9) AS p FROM truth")(_power(_graph, _us, _length))


def _parted_power(graph: str, us: list[int], length: int) -> Query:
    """Write the graph in parts, open it, take steps that read their frontier's parts."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = new_path(spark, "parts")
        parts.write_parts(getattr(derived, graph)(spark, d), path)
        return exact.parted_power(parts.open_parts(spark, path), sources(spark, us), length).select("query_id", "node", rounded("p"))

    return run


for _name, _graph, _us, _length in (("parted_step", "transitions", [1], 1), ("parted_power_L3", "transitions", [1, 7], 3)):
    query(_name, f"{sql.graph(_graph, 'matrix')},\n{sql.power(_us, _length)} SELECT query_id, node, round(p, 9) AS p FROM truth")(_parted_power(_graph, _us, _length))

_ANSWER = "SELECT query_id, node, cnt, round(p, 9) AS p FROM answer"


def _answer(found: DataFrame) -> DataFrame:
    return found.select("query_id", "node", "cnt", rounded("p"))


@query("prefix_walk", f"{sql.graph('transitions', 'positions', 'prefix')},\n{sql.prefix_walk([0, 3], WALKS, STEPS)} {_ANSWER}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _answer(walks.prefix_walk(derived.transitions(spark, d), sources(spark, [0, 3]), WALKS, STEPS))


@query("alias_walk", f"{sql.graph('nation_trade', 'positions')},\n{sql.ALIAS},\n{sql.alias_walk([1, 3], WALKS, 3)} {_ANSWER}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _answer(walks.alias_walk(derived.nation_trade(spark, d), sources(spark, [1, 3]), WALKS, 3))


for _name, _graph, _us, _length in (("rejection_walk", "transitions", [0, 3], 3), ("reject_accept_step", "transitions", [0, 1, 2, 3], 1), ("rejection_walk_skewed", "skewed", [0, 3], 2)):
    query(_name, f"{sql.graph(_graph, 'positions')},\n{sql.rejection_walk(_us, WALKS, _length)} {_ANSWER}")(
        lambda spark, d, graph=_graph, us=_us, length=_length: _answer(walks.rejection_walk(getattr(derived, graph)(spark, d), sources(spark, us), WALKS, length))
    )

for _policy in ("drop", "stay"):
    query(f"walk_dangling_{_policy}", f"{sql.graph('trade', 'positions', 'prefix')},\n{sql.prefix_walk([1, 2], WALKS, 3, stay=_policy == 'stay')} {_ANSWER}")(
        lambda spark, d, policy=_policy: _answer(walks.prefix_walk(derived.trade(spark, d), sources(spark, [1, 2]), WALKS, 3, dangling=policy))
    )


def _push(graph: str, us: list[int], samples: int, levels: int) -> Query:
    return lambda spark, d: push.sampled_push(getattr(derived, graph)(spark, d), sources(spark, us), samples, levels).select("query_id", "node", rounded("p"))


for _name, _graph, _us, _samples, _length in (("sampled_push_step", "copurchase", [1, 2], SAMPLES, 1), ("sampled_push_walk", "copurchase", [1], SAMPLES, PUSH_LEVELS), ("sampled_push_skewed", "skewed", [0, 1], 200, 4)):
    query(_name, f"{sql.graph(_graph, 'buckets', 'totals')},\n{sql.sampled_push(_us, _samples, _length)} SELECT query_id, node, round(p, 9) AS p FROM answer")(_push(_graph, _us, _samples, _length))


# ---- answers and metrics: prefix walks against the exact distribution

_EVALUATED = f"{sql.graph('copurchase', 'positions', 'prefix', 'matrix')},\n{sql.power([1, 2], 2)},\n{sql.prefix_walk([1, 2], WALKS, 2, with_queries=False)}"


class _Evaluated:
    """An answer, the truth and what metrics ask of the graph, each made when it is asked for.

    Two steps from two sources meet few edges, so those alone are made of the order lines, and written.
    """

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d, self.asked = spark, d, sources(spark, [1, 2])

    @functools.cached_property
    def near(self) -> DataFrame:
        """The edges that the walks and the exact steps can take."""
        return derived.copurchase_near(self.spark, self.d, self.asked.select(F.col("u").alias("src")), 2)

    @functools.cached_property
    def answer(self) -> DataFrame:
        return materialize(walks.prefix_walk(self.near, self.asked, WALKS, 2, written=True).select("query_id", "node", "p"), "answer")

    @functools.cached_property
    def truth(self) -> DataFrame:
        return materialize(exact.power_method(self.near, self.asked, 2, written=True), "truth")

    @functools.cached_property
    def swept(self) -> DataFrame:
        """The edges of the answer's nodes."""
        return derived.copurchase_of(self.spark, self.d, self.answer.select(F.col("node").alias("src")))

    @functools.cached_property
    def size(self) -> Row:
        """n and whole of the graph."""
        return derived.copurchase_size(self.spark, self.d).first()


def _size(edges: DataFrame) -> int:
    return stats.attribute(edges).first().n


_METRICS = f"{_EVALUATED},\n{sql.METRICS}"
for _name, _sql, _make in (
    ("metric_l1", "SELECT query_id, round(l1, 9) AS l1 FROM l1", lambda e: metrics.l1_error(e.answer, e.truth).select("query_id", rounded("l1"))),
    ("metric_max_ae", "SELECT query_id, round(max_ae, 9) AS max_ae, node, round(a, 9) AS a, round(t, 9) AS t FROM ae", lambda e: metrics.max_additive_error(e.answer, e.truth).select("query_id", rounded("max_ae"), "node", rounded("a"), rounded("t"))),
    ("metric_precision", "SELECT query_id, round(precision, 9) AS precision FROM precise", lambda e: metrics.precision_at_k(e.answer, e.truth, e.size.n).select("query_id", rounded("precision"))),
    ("metric_conductance", "SELECT query_id, round(conductance, 9) AS conductance FROM conduct", lambda e: metrics.conductance(e.answer, e.swept, e.size.whole).select("query_id", rounded("conductance"))),
    (
        "metrics_report",
        "SELECT round(avg(l1), 9) AS l1, round(avg(precision), 9) AS precision, round(avg(conductance), 9) AS conductance, round(avg(max_ae), 9) AS max_ae FROM l1 JOIN ae USING (query_id) JOIN precise USING (query_id) JOIN conduct USING (query_id)",
        lambda e: metrics.report(e.answer, e.truth, e.swept, e.size.n, whole=e.size.whole).select(*map(rounded, ("l1", "precision", "conductance", "max_ae"))),
    ),
    ("answer_sorted", "SELECT query_id, node, round(p, 9) AS p, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, node DESC) AS rank FROM answer", lambda e: answers.ranked(e.answer).select("query_id", "node", rounded("p"), F.col("rank").cast("long").alias("rank"))),
    ("top_k_answer", "SELECT query_id, node FROM mine", lambda e: answers.top_k(e.answer, 50).select("query_id", "node")),
    ("support_union", "SELECT query_id, node FROM answer UNION SELECT query_id, node FROM truth", lambda e: answers.support_union(e.answer, e.truth)),
    ("support_missing", "SELECT query_id, node FROM truth EXCEPT SELECT query_id, node FROM answer", lambda e: answers.support_missing(e.truth, e.answer)),
    (
        "topk_intersection",
        "SELECT query_id, node FROM mine INTERSECT SELECT query_id, node FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 12) DESC, node DESC) AS k FROM truth) WHERE k <= 50",
        lambda e: answers.topk_intersection(e.answer, e.truth.withColumn("p", F.round("p", 12)), 50),
    ),
    ("reached_count", "SELECT query_id, count(*) AS reached FROM answer GROUP BY query_id", lambda e: answers.reached_count(e.answer)),
):
    query(_name, f"{_METRICS} {_sql}")(lambda spark, d, f=_make: f(_Evaluated(spark, d)))


# ---- files of answers and queries


@query("result_sink", f"{sql.graph('nation_trade', 'matrix')},\n{sql.power([1, 3], 2)} SELECT 'exact' AS algo, 'nation_trade' AS label, 2 AS \"L\", query_id, node, round(p, 9) AS p FROM truth")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "answers")
    found = exact.power_method(derived.nation_trade(spark, d), sources(spark, [1, 3]), 2)
    files.write_answers(found.select(F.lit("exact").alias("algo"), F.lit("nation_trade").alias("label"), F.lit(2).alias("L"), F.lit("0").alias("eps"), F.col("query_id").alias("u"), "node", "p"), path)
    return files.read_answers(spark, path).select("algo", "label", F.col("L").cast("int").alias("L"), F.col("u").cast("long").alias("query_id"), "node", rounded("p"))


def _as_text(found: DataFrame, path: str) -> None:
    files.write_answer_text(found.select(F.lit("exact").alias("algo"), F.lit("nation_trade").alias("label"), F.lit(2).alias("L"), F.lit("0").alias("eps"), F.col("query_id").alias("u"), "node", "p"), path)


@query("result_text", f"{sql.graph('nation_trade', 'matrix')},\n{sql.power([1, 3], 2)} SELECT query_id, node, round(p, 9) AS p FROM truth")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "answer-text")
    _as_text(exact.power_method(derived.nation_trade(spark, d), sources(spark, [1, 3]), 2), path)
    return files.read_answer_text(spark, path).select(F.col("u").cast("long").alias("query_id"), "node", rounded("p"))


@query("gt_scan", f"{sql.graph('nation_trade', 'matrix')},\n{sql.power([1, 3], 2)} SELECT query_id, node FROM truth WHERE p * CAST(1.2e-14 AS DOUBLE) >= CAST(5e-16 AS DOUBLE)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities so small that some vanish in the fifteen decimals of the text."""
    path = new_path(spark, "tiny-answers")
    found = exact.power_method(derived.nation_trade(spark, d), sources(spark, [1, 3]), 2)
    _as_text(found.withColumn("p", F.col("p") * F.lit(1.2e-14)), path)
    return files.read_answer_text(spark, path).select(F.col("u").cast("long").alias("query_id"), "node")


@query("query_scan", sql.graph("transitions") + ", d AS (SELECT src, count(*) AS deg FROM g GROUP BY src) SELECT row_number() OVER (ORDER BY deg DESC, src) - 1 AS query_id, src AS u FROM d QUALIFY query_id < 4")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "queries")
    files.write_queries(updates.max_queries(derived.transitions(spark, d), 9), path)
    return files.read_queries(spark, path, 4)


@query("query_generate", f"{sql.graph('nation_trade')}, e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS idx, src FROM g), n AS (SELECT CAST(range AS BIGINT) AS query_id FROM range(50)) SELECT query_id, src AS u FROM n JOIN e ON e.idx = CAST(floor({sql.rng(repr('queries'), 'query_id')} * (SELECT count(*) FROM g)) AS BIGINT)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return updates.generate_queries(_nations(spark, d)[0], 50)


@query("max_queries", sql.graph("copurchase") + ", d AS (SELECT src, count(*) AS deg FROM g GROUP BY src) SELECT row_number() OVER (ORDER BY deg DESC, src) - 1 AS query_id, src AS u, deg FROM d QUALIFY query_id < 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return updates.max_queries(derived.copurchase(spark, d), 50)


# ---- updates: a workload of edges of transitions, deleted and inserted again with other weights

OPS = 40
_R = sql.rng(repr("ops"), "src", "dst")
_OPS = f"{sql.graph('transitions')}, d AS (SELECT src FROM g GROUP BY src HAVING count(*) > 1), ops AS (SELECT row_number() OVER (ORDER BY {_R}, src, dst) - 1 AS seq, src, dst, w FROM g WHERE src IN (SELECT src FROM d) QUALIFY seq < {OPS})"
_DELETED = f"{_OPS}, h AS (SELECT * FROM g WHERE (src, dst) NOT IN (SELECT (src, dst) FROM ops))"
_UPDATED = f"{_OPS}, h AS (SELECT src, dst, w FROM g WHERE (src, dst) NOT IN (SELECT (src, dst) FROM ops) UNION ALL SELECT src, dst, w + 1 FROM ops)"


def _workload(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph, edges to delete, edges to insert (those again, of weights one greater)."""
    edges = materialize(derived.transitions(spark, d), "graph")
    ops = materialize(updates.generate_ops(edges, OPS), "ops")
    return edges, ops, ops.withColumn("w", F.col("w") + 1)


@query("oplog_generate", f"{_OPS} SELECT CAST(seq AS BIGINT) AS seq, src, dst, w FROM ops")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _workload(spark, d)[1]


@query("oplog_scan", f"{_OPS} SELECT CAST(seq AS BIGINT) AS seq, src, dst, w FROM ops")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "op-log")
    files.write_ops(_workload(spark, d)[1], path)
    return files.read_ops(spark, path)


@query("update_missing_keys", f"{_OPS} SELECT src, dst + 1000000 AS dst FROM ops WHERE seq % 2 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    edges, ops, _ = _workload(spark, d)
    asked = ops.select("src", F.when(F.col("seq") % 2 == 0, F.col("dst") + 1000000).otherwise(F.col("dst")).alias("dst"))
    return updates.missing_keys(edges, asked)


@query("update_delete", f"{_DELETED} SELECT src, dst, w FROM h")
def _(spark: SparkSession, d: str) -> DataFrame:
    edges, ops, _ = _workload(spark, d)
    return updates.delete(edges, ops)


@query("update_insert", f"{_OPS} SELECT src, dst, w FROM g UNION ALL SELECT src, dst, w + 1 FROM ops")
def _(spark: SparkSession, d: str) -> DataFrame:
    edges, _, again = _workload(spark, d)
    return updates.insert(edges, again)


@query("update_apply", f"{_UPDATED} SELECT src, dst, w FROM h")
def _(spark: SparkSession, d: str) -> DataFrame:
    return updates.apply(*_workload(spark, d))


def _refreshed(build: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        edges, gone, new = _workload(spark, d)
        after = materialize(updates.apply(edges, gone, new), "updated")
        return updates.refresh(build(edges), after, updates.touched(gone, new), build)

    return run


for _name, _build, _sql in (
    ("update_bucket_stats", stats.bucket_histogram, f"SELECT src, {sql.BUCKET} AS bucket, count(*) AS cnt FROM h GROUP BY ALL"),
    ("update_bucket_index", indexes.bucket_index, f"SELECT src, {sql.BUCKET} AS bucket, CAST(row_number() OVER (PARTITION BY src, {sql.BUCKET} ORDER BY dst) - 1 AS INTEGER) AS bpos, dst, w, pow(CAST(2 AS DOUBLE), {sql.BUCKET}) AS maxw FROM h"),
    ("update_prefix_index", lambda e: indexes.prefix_index(e).select("src", "pos", "dst", "lo", "hi", "total"), "SELECT src, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, dst, sum(w) OVER w - w AS lo, sum(w) OVER w AS hi, sum(w) OVER (PARTITION BY src) AS total FROM h WINDOW w AS (PARTITION BY src ORDER BY dst)"),
    ("update_alias_index", lambda e: indexes.alias_distribution(indexes.alias_index(e)).filter("p > 1e-12").select("src", "dst", rounded("p")), "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS p FROM h"),
):
    query(_name, f"{_UPDATED} {_sql}")(_refreshed(_build))


# ---- stores: transitions with all indexes, written once, updated in part, opened again

#: Edges of a block and places of a chunk; small, so that most sources have several.
STORE_BLOCK, STORE_CHUNK = 8, 4
_STORED = f"{_UPDATED}, n AS (SELECT src, CAST(pow(2, greatest(ceil(log2(count(*) / CAST({STORE_BLOCK} AS DOUBLE))), 0)) AS BIGINT) AS blocks FROM g GROUP BY src), cells AS (SELECT h.src, h.dst, h.w, CAST(floor({sql.rng(repr('block'), 'h.dst')} * n.blocks) AS BIGINT) AS block, {sql.BUCKET} AS bucket FROM h JOIN n ON h.src = n.src)"
_STORED_PREFIX = f"{_STORED}, prefix AS (SELECT src, dst, hi - w AS lo, hi, total FROM (SELECT *, sum(w) OVER (PARTITION BY src ORDER BY block, dst) AS hi, sum(w) OVER (PARTITION BY src) AS total FROM cells))"


def _updated_store(spark: SparkSession, d: str) -> tuple[str, Store]:
    """A store of transitions and what a batch has made of it, opened anew."""
    edges, gone, new = _workload(spark, d)
    folder = new_path(spark, "store")
    stored.create(edges, folder, STORE_BLOCK, STORE_CHUNK)
    stored.update(Store.open(spark, folder), gone, new)
    return folder, Store.open(spark, folder)


@query("store_prefix_walk", f"{_STORED_PREFIX},\n{sql.prefix_walk([0, 3], WALKS, STEPS, seed='stored')} {_ANSWER}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Build, update, open, walk."""
    return _answer(stored.walk(_updated_store(spark, d)[1], sources(spark, [0, 3]), WALKS, STEPS))


@query("store_push", f"{sql.graph('skewed', 'buckets', 'totals')},\n{sql.sampled_push([0, 1], 200, 4)} SELECT query_id, node, round(p, 9) AS p FROM answer")
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "store")
    stored.create(derived.skewed(spark, d), folder, STORE_BLOCK, STORE_CHUNK)
    return stored.sampled_push(Store.open(spark, folder), sources(spark, [0, 1]), 200, 4).select("query_id", "node", rounded("p"))


@query("store_counted_walk", None)
def _(spark: SparkSession, d: str) -> DataFrame:
    """A hundred million walks by their numbers; SQL has no binomial draws, so tests hold them against the exact distribution."""
    return _answer(counted.walk(_updated_store(spark, d)[1], sources(spark, [0, 3]), 10**8, 3))


@query("store_versions", f"{_UPDATED} SELECT 0 AS version, src, dst, w FROM g UNION ALL SELECT 1, src, dst, w FROM h UNION ALL SELECT 2, src, dst, w FROM h")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The graph before and after a batch, and after the store has been compacted."""
    folder, store = _updated_store(spark, d)
    stored.compact(store, 0.0)
    graphs = [stored.edges_of(Store.open(spark, folder, k)).select(F.lit(k).alias("version"), "src", "dst", "w") for k in range(3)]
    return graphs[0].unionByName(graphs[1]).unionByName(graphs[2])


@query("store_alias_distribution", f"{_STORED} SELECT src, dst, round(sum(w) / any_value(total), 9) AS p FROM (SELECT *, sum(w) OVER (PARTITION BY src) AS total FROM h) GROUP BY src, dst")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What the alias slots of an updated store's blocks, and those over the blocks, imply."""
    store = _updated_store(spark, d)[1]
    blocks = store.table("blocks").whole().select("src", "block", "n", F.explode("cells").alias("c"))
    inside = blocks.select("src", "block", F.explode(F.array(F.struct(F.col("c.dst").alias("dst"), (F.col("c.p") / F.col("n")).alias("p")), F.struct(F.col("c.other").alias("dst"), ((1 - F.col("c.p")) / F.col("n")).alias("p")))).alias("x"))
    choice = store.table("choice").whole().join(store.table("nodes").whole().select("src", "slots"), "src")
    over = choice.select("src", F.explode(F.array(F.struct("block", (F.col("p") / F.col("slots")).alias("q")), F.struct(F.col("other").alias("block"), ((1 - F.col("p")) / F.col("slots")).alias("q")))).alias("x"))
    over = over.select("src", "x.block", "x.q").groupBy("src", "block").agg(F.sum("q").alias("q"))
    both = inside.select("src", "block", "x.dst", "x.p").join(over, ["src", "block"], "left")
    return both.groupBy("src", "dst").agg(F.sum(F.col("p") * F.coalesce("q", F.lit(1.0))).alias("p")).filter("p > 1e-12").select("src", "dst", rounded("p"))


@query("store_bucket_places", f"{_STORED} SELECT src, bucket, count(*) AS cnt, CAST(0 AS BIGINT) AS least, count(*) - 1 AS most, count(*) AS places, sum(w) AS total FROM cells GROUP BY src, bucket")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Places in buckets stay dense through deletes and inserts, in chunks as in what the sources say of them."""
    store = _updated_store(spark, d)[1]
    edges = store.table("chunks").whole().select("src", "bucket", F.explode("edges").alias("e")).select("src", "bucket", "e.bpos", "e.w")
    about = edges.groupBy("src", "bucket").agg(F.min("bpos").cast("long").alias("least"), F.max("bpos").cast("long").alias("most"), F.countDistinct("bpos").alias("places"), F.sum("w").alias("total"))
    counts = store.table("nodes").whole().select("src", F.explode("buckets").alias("b")).select("src", "b.bucket", "b.cnt")
    return about.join(counts, ["src", "bucket"], "full").select("src", "bucket", "cnt", "least", "most", "places", "total")


# ---- logs and reports: the errors are those of runs of the engine, update logs are made of the tables


@query(
    "log_parse",
    """WITH k AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation)
      SELECT CAST(4 * r + j AS BIGINT) AS line, kind, CASE kind WHEN 'delete' THEN k / CAST(8 AS DOUBLE) WHEN 'insert' THEN k / CAST(4 AS DOUBLE) ELSE k + CAST(0.5 AS DOUBLE) END AS value
      FROM k JOIN (VALUES (0, 'delete'), (1, 'insert'), (3, 'memory')) v(j, kind) ON true""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    path, k = new_path(spark, "log"), F.col("n_nationkey")
    label = F.concat(F.lit("add-memory-"), k)
    lines = F.array(
        F.concat(label, F.lit(" new del update time: "), k / F.lit(8.0)), F.concat(label, F.lit(" new add update time: "), k / F.lit(4.0)),
        F.lit("no new del update time here"), F.concat(F.lit("Total graph: peak memory: "), k + F.lit(0.5), F.lit(" G")),
    )
    text = derived.table(spark, d, "nation").select(k, F.posexplode(lines).alias("j", "value"))
    text.coalesce(1).sortWithinPartitions("n_nationkey", "j").select("value").write.text(path)
    return files.parse_log(spark, path).select("line", "kind", "value")


@query(
    "update_overhead",
    """WITH v AS (SELECT CAST(s_nationkey AS VARCHAR) AS label, ['plain', 'alias', 'push'][s_suppkey % 3 + 1] AS algo, ['delete', 'insert', 'memory'][(s_suppkey // 3) % 3 + 1] AS kind, CAST(s_suppkey AS DOUBLE) AS value FROM supplier),
      m AS (SELECT label, algo, avg(value) FILTER (kind <> 'memory') AS seconds, avg(value) FILTER (kind = 'memory') AS memory FROM v GROUP BY label, algo)
      SELECT m.label, m.algo, round(m.seconds, 9) AS seconds, round(m.seconds - b.seconds, 9) AS overhead, round(m.memory, 9) AS memory, round(m.memory - b.memory, 9) AS memory_overhead FROM m JOIN m b ON m.label = b.label AND b.algo = 'plain'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _overheads(spark, d).select("label", "algo", *map(rounded, ("seconds", "overhead", "memory", "memory_overhead")))


def _overheads(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % 3 + 1).cast("int"))
    k = F.col("s_suppkey")
    values = derived.table(spark, d, "supplier").select(
        F.col("s_nationkey").cast("string").alias("label"), pick(("plain", "alias", "push"), k).alias("algo"),
        pick(("delete", "insert", "memory"), F.floor(k / 3)).alias("kind"), k.cast("double").alias("value"),
    )
    return updates.update_overhead(values, "plain")


#: The runs of the reports: walks and pushes of several eps, each answered by one run of the least.
RUN_EPS, RUN_LENGTH, RUN_US = [0.1, 0.04, 0.02], 3, [0, 3]
RUN_WALKS, RUN_SAMPLES = [columns.walk_count(e) for e in RUN_EPS], [columns.push_samples(e, RUN_LENGTH) for e in RUN_EPS]
#: Queries of one run are numbered by algorithm, eps and source.
_RUN = lambda algo, eps, q: f"{algo} * 100 + {eps} * 10 + {q}"


def _run_sql() -> str:
    """CTEs: answer and truth of all runs, and r, a row of costs and errors for each algorithm and eps."""
    walked = sql.prefix_walk(RUN_US, max(RUN_WALKS), RUN_LENGTH, with_queries=False).rsplit(",\nanswer AS", 1)[0]
    pushed = sql.sampled_push(RUN_US, max(RUN_SAMPLES), RUN_LENGTH, with_queries=False).rsplit(",\nanswer AS", 1)[0]
    own = [f"SELECT {_RUN(0, k, 'query_id')} AS query_id, node, count(*) / CAST({n} AS DOUBLE) AS p FROM w{RUN_LENGTH} WHERE walk < {n} GROUP BY query_id, node" for k, n in enumerate(RUN_WALKS)]
    own += [f"SELECT {_RUN(1, k, 'query_id')} AS query_id, node, sum(p) / CAST({n} AS DOUBLE) AS p FROM p{RUN_LENGTH} WHERE sample < {n} GROUP BY query_id, node" for k, n in enumerate(RUN_SAMPLES)]
    true = " UNION ALL ".join(f"SELECT {_RUN(a, k, 'query_id')} AS query_id, node, p FROM exact" for a in (0, 1) for k in range(len(RUN_EPS)))
    return f"""{sql.graph('transitions', 'positions', 'prefix', 'matrix', 'buckets', 'totals')},
{sql.power(RUN_US, RUN_LENGTH, at='exact')},
{walked},
{pushed},
answer AS ({' UNION ALL '.join(own)}),
truth AS ({true}),
{sql.METRICS},
met AS (SELECT l1.query_id, l1, precision, conductance, max_ae, reached FROM l1 JOIN ae USING (query_id) JOIN precise USING (query_id) JOIN conduct USING (query_id) JOIN (SELECT query_id, count(*) AS reached FROM answer GROUP BY query_id) USING (query_id)),
r AS (SELECT ['prefix', 'push'][query_id // 100 + 1] AS algo, 'transitions' AS label, {RUN_LENGTH} AS "L", CAST(query_id // 10 % 10 AS INTEGER) AS eps_idx, avg(reached) AS avg_sec,
  round(avg(l1), 9) AS l1, round(avg(precision), 9) AS precision, round(avg(conductance), 9) AS conductance, round(avg(max_ae), 9) AS max_ae FROM met GROUP BY ALL)"""


_REPORTS = _run_sql()


def _answers_by_eps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The answers and truths of all runs, by numbered queries, and the graph."""
    edges, asked = materialize(derived.transitions(spark, d), "graph"), sources(spark, RUN_US)
    number = lambda algo: (F.lit(100 * algo) + F.col("eps_idx") * 10 + F.col("query_id")).cast("long").alias("query_id")
    walked = walks.prefix_walk(edges, asked, RUN_WALKS, RUN_LENGTH).select(number(0), "node", "p")
    pushed = push.sampled_push(edges, asked, RUN_SAMPLES, RUN_LENGTH).select(number(1), "node", "p")
    runs = F.explode(F.array(*[F.lit(100 * a + 10 * k) for a in (0, 1) for k in range(len(RUN_EPS))])).alias("run")
    truth = exact.power_method(edges, asked, RUN_LENGTH).select("query_id", "node", "p", runs)
    truth = truth.select((F.col("query_id") + F.col("run")).cast("long").alias("query_id"), "node", "p")
    return materialize(walked.unionByName(pushed), "answers"), materialize(truth, "truths"), edges


def _reports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Costs (the mean number of nodes that a run reaches, in place of seconds) and errors of walks and pushes, by algorithm and eps."""
    answer, truth, edges = _answers_by_eps(spark, d)
    met = metrics.by_query(answer, truth, edges, _size(edges)).join(answers.reached_count(answer), "query_id")
    algo = F.element_at(F.array(F.lit("prefix"), F.lit("push")), (F.floor(F.col("query_id") / 100) + 1).cast("int"))
    key = [algo.alias("algo"), F.lit("transitions").alias("label"), F.lit(RUN_LENGTH).alias("L"), (F.floor(F.col("query_id") / 10) % 10).cast("int").alias("eps_idx")]
    found = met.groupBy(*key).agg(F.avg("reached").alias("avg_sec"), *[F.round(F.avg(c), DECIMALS).alias(c) for c in ("l1", "precision", "conductance", "max_ae")])
    found, at = materialize(found, "reports"), ["algo", "label", "L", "eps_idx"]
    return found.select(*at, "avg_sec"), found.select(*at, "l1", "precision", "conductance", "max_ae")


@query(
    "overhead_dumps",
    """WITH v AS (SELECT CAST(s_nationkey AS VARCHAR) AS label, ['plain', 'alias', 'push'][s_suppkey % 3 + 1] AS algo, ['delete', 'insert', 'memory'][(s_suppkey // 3) % 3 + 1] AS kind, CAST(s_suppkey AS DOUBLE) AS value FROM supplier),
      m AS (SELECT label, algo, avg(value) FILTER (kind <> 'memory') AS seconds, avg(value) FILTER (kind = 'memory') AS memory FROM v GROUP BY label, algo),
      o AS (SELECT m.label, m.algo, m.seconds, m.seconds - b.seconds AS overhead, m.memory, m.memory - b.memory AS memory_overhead FROM m JOIN m b ON m.label = b.label AND b.algo = 'plain'),
      u AS (SELECT label, algo, 'time' AS measure, seconds AS v FROM o UNION ALL SELECT label, algo, 'time_overhead', overhead FROM o UNION ALL SELECT label, algo, 'memory', memory FROM o UNION ALL SELECT label, algo, 'memory_overhead', memory_overhead FROM o)
      SELECT measure, label || ':[' || string_agg(coalesce(printf('%.9f', v), 'nan'), ', ' ORDER BY algo) || ']' AS value FROM u GROUP BY measure, label""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "dumps")
    files.write_dumps(_overheads(spark, d), path)
    return spark.read.text(path).select("measure", "value")


@query("answers_by_eps", f"{_REPORTS} SELECT query_id, node, round(p, 9) AS p FROM answer")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The answers of all values of eps, from one run of each algorithm."""
    return _answers_by_eps(spark, d)[0].select("query_id", "node", rounded("p"))


@query("report_append", f"{_REPORTS} SELECT algo, eps_idx, l1, precision, conductance, max_ae FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    path, errors = new_path(spark, "reports"), _reports(spark, d)[1].select("algo", "eps_idx", "l1", "precision", "conductance", "max_ae")
    for even in (0, 1):
        files.append_report(errors.filter(F.col("eps_idx") % 2 == even), path)
    return files.read_report(spark, path, errors.schema)


@query("metric_series", f"{_REPORTS} SELECT algo, label, \"L\", eps_idx, avg_sec, metric, value FROM r UNPIVOT (value FOR metric IN (precision, conductance, max_ae)) WHERE eps_idx < 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return updates.metric_series(*_reports(spark, d))


@query("precision_points", f"{_REPORTS}, o AS (SELECT algo, max(avg_sec) AS overhead FROM r GROUP BY algo) SELECT algo, label, avg_sec AS query_sec, overhead AS update_overhead, precision FROM r JOIN o USING (algo) WHERE eps_idx = 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    runtimes, errors = _reports(spark, d)
    overheads = runtimes.groupBy("algo", "label").agg(F.max("avg_sec").alias("overhead"))
    return updates.precision_points(runtimes, errors, overheads, runtimes.select("label", F.lit(2).alias("eps_idx")).distinct())


@query("update_stream", f"{_UPDATED} SELECT src, dst, w FROM h")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Our extension: the same updates as a stream of op-log files, one micro-batch for each file."""
    edges, gone, new = _workload(spark, d)
    folder = new_path(spark, "op-stream")
    for k, (op, rows) in enumerate((("delete", gone), ("insert", new))):
        # the stream takes files in the order of their times, which some stores keep in whole seconds
        time.sleep(1.1 * k)
        rows.select(F.lit(op).alias("op"), "src", "dst", "w").coalesce(1).write.mode("append").parquet(f"{folder}/in/part={k}")
    stream = spark.readStream.schema("op string, src long, dst long, w double, part int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").drop("part")
    return apply_stream(spark, edges, stream, f"{folder}/graph")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
