"""DuckDB SQL for the graph queries, in pieces: graphs, random numbers, indexes, walks and metrics."""

from __future__ import annotations

#: The derived graphs, edges(src, dst, w).
GRAPHS = {
    "copurchase": """SELECT a.l_partkey AS src, b.l_partkey AS dst, CAST(count(*) AS DOUBLE) AS w
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY a.l_partkey, b.l_partkey""",
    "nation_trade": """SELECT CAST(s.s_nationkey AS BIGINT) AS src, CAST(c.c_nationkey AS BIGINT) AS dst, sum(l.l_quantity) AS w
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
      JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_nationkey, c.c_nationkey""",
    "cust_supp": """SELECT o.o_custkey AS src, 10000000 + l.l_suppkey AS dst, sum(l.l_quantity) AS w
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, l.l_suppkey""",
    "transitions": """SELECT user_id AS src, nu AS dst, CAST(count(*) AS DOUBLE) AS w
      FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nu FROM events) z WHERE nu IS NOT NULL GROUP BY user_id, nu""",
}


def rng(*parts: str | int) -> str:
    texts = ", ".join(f"'{p}'" if isinstance(p, int) else p for p in parts)
    return f"(CAST(CAST(CAST('0x' || substr(md5(concat_ws('|', {texts})), 1, 8) AS UBIGINT) AS BIGINT) % 2147483647 AS DOUBLE) / CAST(2147483647.0 AS DOUBLE))"


_U = f"({rng(repr('sk'), 'src', 'dst')} + CAST(0.0001 AS DOUBLE))"
GRAPHS["skewed"] = f"SELECT src, dst, w * CAST(ceil(CAST(1.0 AS DOUBLE) / ({_U} * {_U})) AS DOUBLE) AS w FROM ({GRAPHS['transitions']})"

#: cust_supp, and back again from every second supplier; the others are dangling.
GRAPHS["trade"] = f"SELECT * FROM ({GRAPHS['cust_supp']}) UNION ALL SELECT dst AS src, src AS dst, w FROM ({GRAPHS['cust_supp']}) WHERE dst % 2 = 0"

BUCKET = "CAST(ceil(log2(w)) AS INTEGER)"

INDEXES = {
    "positions": """SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos,
      count(*) OVER (PARTITION BY src) AS deg, sum(w) OVER (PARTITION BY src) AS total FROM g""",
    "prefix": "SELECT src, pos, dst, hi - w AS lo, hi, total, deg FROM (SELECT *, sum(w) OVER (PARTITION BY src ORDER BY pos) AS hi FROM positions)",
    "buckets": f"SELECT src, dst, w, {BUCKET} AS bucket, pow(CAST(2 AS DOUBLE), {BUCKET}) AS maxw, row_number() OVER (PARTITION BY src, {BUCKET} ORDER BY dst) - 1 AS bpos FROM g",
    "totals": "SELECT b.src, b.bucket, count(*) AS cnt, any_value(b.maxw) AS maxw, any_value(t.total) AS total FROM buckets b JOIN (SELECT src, sum(w) AS total FROM g GROUP BY src) t ON b.src = t.src GROUP BY b.src, b.bucket",
    "matrix": "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM g",
}


def graph(name: str, *indexes: str) -> str:
    """WITH clauses of a graph and of indexes over it."""
    return f"WITH RECURSIVE g AS ({GRAPHS[name]})" + "".join(f",\n{k} AS ({INDEXES[k]})" for k in indexes)


def queries(sources: list[int]) -> str:
    rows = ", ".join(f"({k}, {u})" for k, u in enumerate(sources))
    return f"q AS (SELECT CAST(query_id AS BIGINT) AS query_id, CAST(u AS BIGINT) AS u FROM (VALUES {rows}) v(query_id, u))"


def power(sources: list[int], length: int, at: str = "truth") -> str:
    """CTEs over matrix; the last one, `at`, is (query_id, node, p)."""
    out = [queries(sources), f"{at}0 AS (SELECT query_id, u AS node, CAST(1 AS DOUBLE) AS p FROM q)"]
    for k in range(1, length + 1):
        out.append(f"{at}{k} AS (SELECT s.query_id, m.dst AS node, sum(s.p * m.p) AS p FROM {at}{k - 1} s JOIN matrix m ON s.node = m.src GROUP BY s.query_id, m.dst)")
    return ",\n".join([*out, f"{at} AS (SELECT * FROM {at}{length} WHERE p > 0)"])


def _walk(sources: list[int], walks: int, steps: list[str], with_queries: bool) -> str:
    out = [queries(sources)] if with_queries else []
    out.append(f"w0 AS (SELECT query_id, range AS walk, u AS node FROM q, range({walks}))")
    out += [f"w{k} AS ({s})" for k, s in enumerate(steps, 1)]
    end = f"w{len(steps)}"
    return ",\n".join([*out, f"answer AS (SELECT query_id, node, count(*) AS cnt, count(*) / CAST({walks} AS DOUBLE) AS p FROM {end} GROUP BY query_id, node)"])


def prefix_walk(sources: list[int], walks: int, length: int, seed: str = "prefix", stay: bool = False, with_queries: bool = True) -> str:
    def step(k: int) -> str:
        x = f"{rng(repr(seed), 's.query_id', 's.walk', k, 0)} * i.total"
        join = "LEFT JOIN" if stay else "JOIN"
        return f"SELECT s.query_id, s.walk, coalesce(i.dst, s.node) AS node FROM w{k - 1} s {join} prefix i ON s.node = i.src AND {x} >= i.lo AND {x} < i.hi"

    return _walk(sources, walks, [step(k) for k in range(1, length + 1)], with_queries)


#: Alias slots over positions.
ALIAS = """items AS (SELECT *, w * deg - total AS surplus, w * deg - total > 0 AS heavy FROM positions),
ends AS (SELECT *, sum(abs(surplus)) OVER (PARTITION BY src, heavy ORDER BY pos) AS stop, lead(dst) OVER (PARTITION BY src, heavy ORDER BY pos) AS next_heavy FROM items),
slots AS (SELECT l.src, l.pos AS slot, l.deg, l.dst,
    CASE WHEN l.heavy THEN coalesce((l.total + l.stop - l.used) / l.total, 1) WHEN l.surplus < 0 THEN (l.total + l.surplus) / l.total ELSE 1 END AS p,
    CASE WHEN l.heavy AND l.used IS NOT NULL THEN l.next_heavy WHEN l.surplus < 0 AND NOT l.heavy THEN l.giver ELSE l.dst END AS alias_dst
  FROM (SELECT e.*,
      CASE WHEN e.next_heavy IS NOT NULL AND e.heavy THEN (SELECT min(x.stop) FROM ends x WHERE x.src = e.src AND NOT x.heavy AND x.surplus < 0 AND x.stop > e.stop) END AS used,
      (SELECT arg_min(x.dst, x.stop) FROM ends x WHERE x.src = e.src AND x.heavy AND x.stop >= e.stop + e.surplus) AS giver
    FROM ends e) l)"""


def alias_walk(sources: list[int], walks: int, length: int, seed: str = "alias") -> str:
    def step(k: int) -> str:
        draw = lambda d: rng(repr(seed), "s.query_id", "s.walk", k, d)
        slot = f"CAST(floor({draw(0)} * i.deg) AS BIGINT)"
        return f"SELECT s.query_id, s.walk, CASE WHEN {draw(1)} < i.p THEN i.dst ELSE i.alias_dst END AS node FROM w{k - 1} s JOIN slots i ON s.node = i.src AND i.slot = {slot}"

    return _walk(sources, walks, [step(k) for k in range(1, length + 1)], True)


def rejection_walk(sources: list[int], walks: int, length: int, seed: str = "reject") -> str:
    """Each step tries neighbours until one is accepted."""
    index = "accepts AS (SELECT p.src, p.pos, p.dst, p.deg, p.w / pow(CAST(2 AS DOUBLE), max(CAST(ceil(log2(p.w)) AS INTEGER)) OVER (PARTITION BY p.src)) AS accept FROM positions p)"
    out = [index, queries(sources), f"w0 AS (SELECT query_id, range AS walk, u AS node FROM q, range({walks}))"]
    for k in range(1, length + 1):
        number = lambda d: rng(repr(seed), "t.query_id", "t.walk", k, f"CAST(t.attempt * 2 + {d} AS VARCHAR)")  # noqa: B023, E731
        out.append(f"""t{k} AS (SELECT query_id, walk, node, 0 AS attempt, CAST(NULL AS BIGINT) AS dst FROM w{k - 1} WHERE node IN (SELECT src FROM g)
          UNION ALL SELECT t.query_id, t.walk, t.node, t.attempt + 1, CASE WHEN {number(1)} < i.accept THEN i.dst END
          FROM t{k} t JOIN accepts i ON t.node = i.src AND i.pos = CAST(floor({number(0)} * i.deg) AS BIGINT) WHERE t.dst IS NULL)""")
        out.append(f"w{k} AS (SELECT query_id, walk, dst AS node FROM t{k} WHERE dst IS NOT NULL)")
    return ",\n".join([*out, f"answer AS (SELECT query_id, node, count(*) AS cnt, count(*) / CAST({walks} AS DOUBLE) AS p FROM w{length} GROUP BY query_id, node)"])


def sampled_push(sources: list[int], samples: int, length: int, seed: str = "push", with_queries: bool = True) -> str:
    """CTEs over buckets and totals; the last one, answer, is (query_id, node, p)."""
    out = [queries(sources)] if with_queries else []
    out.append(f"p0 AS (SELECT query_id, range AS sample, u AS node, CAST(1 AS DOUBLE) AS p FROM q, range({samples}))")
    one = "CAST(1 AS DOUBLE)"
    for k in range(1, length + 1):
        skip = lambda i: f"CAST(floor(ln({one} - {rng(repr(seed), 'query_id', 'sample', k, 'src', 'bucket', i)}) / ln({one} - q)) AS BIGINT)"  # noqa: B023, E731
        coin = rng(repr(seed), "h.query_id", "h.sample", k, "'accept'", "h.src", "h.bucket", "h.pos")
        out.append(f"m{k} AS (SELECT s.query_id, s.sample, b.src, b.bucket, b.cnt, s.p / b.total AS unit, s.p / b.total * b.maxw AS q FROM p{k - 1} s JOIN totals b ON s.node = b.src)")
        out.append(f"""h{k} AS (SELECT query_id, sample, src, bucket, cnt, q, 0 AS i, {skip("'0'")} AS pos FROM m{k} WHERE q < 1
          UNION ALL SELECT query_id, sample, src, bucket, cnt, q, i + 1, pos + 1 + {skip("i + 1")} FROM h{k} WHERE pos < cnt)""")
        out.append(f"""p{k} AS (SELECT query_id, sample, dst AS node, round(sum(mass), 12) AS p FROM (
            SELECT m.query_id, m.sample, b.dst, m.unit * b.w AS mass FROM m{k} m JOIN buckets b ON m.src = b.src AND m.bucket = b.bucket WHERE m.q >= 1
            UNION ALL SELECT h.query_id, h.sample, b.dst, {one} FROM h{k} h JOIN buckets b ON h.src = b.src AND h.bucket = b.bucket AND h.pos = b.bpos
              WHERE h.pos < h.cnt AND {coin} < b.w / b.maxw) GROUP BY query_id, sample, dst)""")
    return ",\n".join([*out, f"answer AS (SELECT query_id, node, sum(p) / CAST({samples} AS DOUBLE) AS p FROM p{length} GROUP BY query_id, node)"])


#: Metrics of answer against truth, over g; n is one more than the greatest id, k is 50.
METRICS = """both_sides AS (SELECT coalesce(a.query_id, t.query_id) AS query_id, coalesce(a.node, t.node) AS node, coalesce(a.p, 0) AS a, coalesce(t.p, 0) AS t, a.node IS NOT NULL AS answered
  FROM answer a FULL JOIN truth t ON a.query_id = t.query_id AND a.node = t.node),
l1 AS (SELECT query_id, sum(abs(a - t)) AS l1 FROM both_sides GROUP BY query_id),
ae AS (SELECT query_id, off AS max_ae, CASE WHEN off > 0 THEN node END AS node, CASE WHEN off > 0 THEN a END AS a, CASE WHEN off > 0 THEN t END AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY off DESC, answered DESC, CASE WHEN answered THEN a END DESC, CASE WHEN answered THEN -node ELSE node END) AS r FROM (
    SELECT *, round(abs(a - t), 12) AS off FROM both_sides)) WHERE r = 1),
best AS (SELECT query_id, node FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY p DESC) AS r FROM truth) WHERE r <= 50),
sizes AS (SELECT query_id, count(*) AS n FROM truth GROUP BY query_id),
mine AS (SELECT query_id, node, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, node DESC) AS r FROM answer) WHERE r <= 50),
fills AS (SELECT s.query_id, x.range AS node, row_number() OVER (PARTITION BY s.query_id ORDER BY x.range) AS r
  FROM sizes s JOIN range((SELECT max(greatest(src, dst)) + 1 FROM g)) x ON true
  WHERE NOT EXISTS (SELECT 1 FROM answer a WHERE a.query_id = s.query_id AND a.node = x.range)),
filled AS (SELECT query_id, node FROM mine UNION ALL
  SELECT f.query_id, f.node FROM fills f LEFT JOIN (SELECT query_id, count(*) AS have FROM mine GROUP BY query_id) h ON f.query_id = h.query_id WHERE f.r <= 50 - coalesce(h.have, 0)),
precise AS (SELECT s.query_id, CASE WHEN s.n < 50 THEN CAST(1 AS DOUBLE) ELSE (SELECT count(*) FROM filled f JOIN best b ON f.query_id = b.query_id AND f.node = b.node WHERE f.query_id = s.query_id) / CAST(50 AS DOUBLE) END AS precision FROM sizes s),
vols AS (SELECT src, sum(w) AS vol FROM g GROUP BY src),
swept AS (SELECT a.query_id, a.node, v.vol, row_number() OVER (PARTITION BY a.query_id ORDER BY a.p DESC, a.node DESC) AS r FROM answer a JOIN vols v ON a.node = v.src),
deltas AS (SELECT s.query_id, s.r, any_value(s.vol) AS vol, sum(CASE WHEN i.r <= s.r THEN -e.w ELSE e.w END) AS delta
  FROM swept s JOIN g e ON s.node = e.src LEFT JOIN swept i ON i.query_id = s.query_id AND i.node = e.dst GROUP BY s.query_id, s.r),
sums AS (SELECT query_id, r, sum(delta) OVER w AS s, sum(vol) OVER w AS v FROM deltas WINDOW w AS (PARTITION BY query_id ORDER BY r)),
cuts AS (SELECT query_id, v, s - least(0, min(s) OVER (PARTITION BY query_id ORDER BY r)) AS cut FROM sums),
phis AS (SELECT query_id, min(cut / least(v, (SELECT sum(w) FROM g) - v)) AS phi FROM cuts WHERE cut > 0 AND least(v, (SELECT sum(w) FROM g) - v) > 0 GROUP BY query_id),
conduct AS (SELECT q.query_id, least(1, coalesce(p.phi, 1)) AS conductance FROM (SELECT DISTINCT query_id FROM answer) q LEFT JOIN phis p ON q.query_id = p.query_id)"""
