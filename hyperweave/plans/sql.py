"""DuckDB SQL of the queries in ``queries``, over the driver's tables."""

from __future__ import annotations

BASE = """
WITH RECURSIVE pins AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS v FROM lineitem),
 edges AS (SELECT l_orderkey AS e, sum(l_quantity)::BIGINT AS w FROM lineitem GROUP BY l_orderkey),
 nodes AS (SELECT p_partkey AS v, 1::BIGINT AS size FROM part),
 parts AS (SELECT v, v % 8 AS p FROM nodes),
 groups_ AS (SELECT v, v // 2 AS g FROM nodes),
 heads AS (SELECT l_orderkey AS e, arg_min(l_partkey, (l_linenumber, l_partkey)) AS s, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey),
 dpins AS (SELECT e, v, v = s AS is_src FROM pins JOIN heads USING (e) WHERE n > 1),
 dedges AS (SELECT e, w FROM edges JOIN heads USING (e) WHERE n > 1),
 raw AS (SELECT l_orderkey AS e, l_partkey AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1 AS is_src FROM lineitem),
 spread AS (SELECT e, count(DISTINCT p) AS l, count(*) AS n FROM pins JOIN parts USING (v) GROUP BY e),
 ppp AS (SELECT e, p, count(*) AS n, count(*) FILTER (NOT is_src) AS n_in FROM dpins JOIN parts USING (v) GROUP BY e, p),
 uppp AS (SELECT e, p, count(*) AS n FROM pins JOIN parts USING (v) GROUP BY e, p),
 dloads AS (SELECT p, count(*) AS size, coalesce(any_value(i.n), 0) AS inbound FROM parts LEFT JOIN (SELECT p, count(DISTINCT e) AS n FROM dpins JOIN parts USING (v) WHERE NOT is_src GROUP BY p) i USING (p) GROUP BY p),
 moves AS (SELECT v, v % 8 AS src, (v + 3) % 8 AS dst, (v * 7919) % 10007 AS gain, row_number() OVER (ORDER BY (v * 7919) % 10007 DESC, v) - 1 AS rank FROM nodes WHERE v % 5 = 0),
 roles AS (SELECT e, p, bool_or(is_src) AS s, bool_or(NOT is_src) AND NOT bool_or(is_src) AS d FROM dpins JOIN parts USING (v) GROUP BY e, p),
 quot AS (SELECT e, coalesce(list(p ORDER BY p) FILTER (s), []) AS srcs, coalesce(list(p ORDER BY p) FILTER (d), []) AS dsts FROM roles GROUP BY e),
 qedges AS (SELECT e, array_to_string(srcs, ',') AS srcs, array_to_string(dsts, ',') AS dsts, w FROM quot JOIN dedges USING (e) WHERE len(srcs) > 1 OR len(dsts) > 0),
 sib AS (SELECT e, p // 2 AS h, count(*) FILTER (p % 2 = 0) AS even, count(*) FILTER (p % 2 = 1) AS odd FROM pins JOIN parts USING (v) GROUP BY e, p // 2),
 r64 AS (SELECT e, v % 64 AS p, bool_or(is_src) AS s FROM dpins GROUP BY ALL),
 q64 AS (SELECT e FROM r64 GROUP BY e HAVING count(*) FILTER (s) > 1 OR count(*) FILTER (NOT s) > 0),
 qpins AS (SELECT e, p AS v, s AS is_src, (p % 8)::INTEGER AS x, (p // 8)::INTEGER AS y FROM r64 JOIN q64 USING (e)),
 routes AS (SELECT a.e, w, a.v AS s, a.x AS sx, a.y AS sy, b.x AS dx, b.y AS dy, abs(a.x - b.x) + abs(a.y - b.y) AS m FROM qpins a JOIN qpins b USING (e) JOIN dedges USING (e) WHERE a.is_src AND NOT b.is_src),
 qpairs AS (SELECT a.v, b.v AS u, w, b.x - a.x AS dx, b.y - a.y AS dy FROM qpins a JOIN qpins b USING (e) JOIN dedges USING (e) WHERE a.v <> b.v),
 force AS (SELECT v, sum(w * (abs(dx) + abs(dy) - greatest(abs(dx + 1) + abs(dy), 1)))::BIGINT AS "left", sum(w * (abs(dx) + abs(dy) - greatest(abs(dx - 1) + abs(dy), 1)))::BIGINT AS "right",
   sum(w * (abs(dx) + abs(dy) - greatest(abs(dx) + abs(dy + 1), 1)))::BIGINT AS up, sum(w * (abs(dx) + abs(dy) - greatest(abs(dx) + abs(dy - 1), 1)))::BIGINT AS down FROM qpairs GROUP BY v),
 harmonic AS (SELECT e, any_value(w) AS w, any_value(w) / sum(1.0::DOUBLE / deg) AS ratio FROM pins JOIN (SELECT v, count(*) AS deg FROM pins GROUP BY v) USING (v) JOIN edges USING (e) GROUP BY e)
"""

#: Expected weight through each cell: routes of equal ends merged, chances by binomials, border cells by what enters them.
_CONGESTION = """,
 boxes AS (SELECT sx, sy, dx, dy, abs(dx - sx) AS bx, abs(dy - sy) AS by_, sum(w)::DOUBLE AS w FROM routes GROUP BY ALL),
 inner_ AS (SELECT a, b, exp(lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) - (a + b) * ln(2)) AS q FROM range(0, 8) s(a), range(0, 8) t(b)),
 chances AS (
  SELECT bx, by_, a, b, CASE WHEN bx = 0 OR by_ = 0 OR a = bx AND b = by_ THEN 1.0::DOUBLE
    WHEN a < bx AND b < by_ THEN (SELECT q FROM inner_ i WHERE i.a = s.a AND i.b = t.b)
    WHEN a = bx THEN (SELECT sum(q) / 2 FROM inner_ i WHERE i.a = bx - 1 AND i.b <= t.b)
    ELSE (SELECT sum(q) / 2 FROM inner_ i WHERE i.b = by_ - 1 AND i.a <= s.a) END AS p
  FROM (SELECT DISTINCT bx, by_ FROM boxes), range(0, 8) s(a), range(0, 8) t(b) WHERE a <= bx AND b <= by_),
 stops AS (SELECT CASE WHEN dx >= sx THEN sx + a ELSE sx - a END AS x, CASE WHEN dy >= sy THEN sy + b ELSE sy - b END AS y, w * p AS l, least(sx, dx) AS x0, least(sy, dy) AS y0, bx, by_ FROM boxes JOIN chances USING (bx, by_)),
 cell_loads AS (SELECT x, y, sum(l) AS load, sum(l) FILTER (x < x0 + bx AND y < y0 + by_) AS load_ref FROM stops GROUP BY x, y)"""

#: A spanning tree of each hyperedge's cells, one cell a step.
_PRIM = """,
 spots AS MATERIALIZED (SELECT DISTINCT e, x, y, x * 8 + y AS c FROM qpins),
 grown AS (
  SELECT e, 1 AS n, [min(c)] AS inside, 0::BIGINT AS total FROM spots GROUP BY e
  UNION ALL
  SELECT g.e, g.n + 1, list_append(any_value(g.inside), arg_min(b.c, abs(a.x - b.x) + abs(a.y - b.y))), any_value(g.total) + min(abs(a.x - b.x) + abs(a.y - b.y))
  FROM grown g JOIN spots a ON a.e = g.e AND list_contains(g.inside, a.c) JOIN spots b ON b.e = g.e AND NOT list_contains(g.inside, b.c) GROUP BY g.e, g.n),
 spans_ AS (SELECT e, max(total) AS total FROM grown GROUP BY e)"""

#: A lattice point is in a hull if it is in a triangle of three of its points (which may coincide).
_HULL = """,
 corners AS MATERIALIZED (SELECT DISTINCT e, x, y FROM qpins),
 shapes AS MATERIALIZED (SELECT e, list(x * 8 + y ORDER BY x, y) AS cs FROM corners GROUP BY e),
 kinds AS MATERIALIZED (SELECT row_number() OVER () AS k, cs FROM (SELECT DISTINCT cs FROM shapes)),
 tips AS MATERIALIZED (SELECT k, c // 8 AS x, c % 8 AS y FROM (SELECT k, unnest(cs) AS c FROM kinds)),
 inside AS (
  SELECT DISTINCT a.k, s.x, t.y FROM tips a JOIN tips b ON b.k = a.k JOIN tips c ON c.k = a.k
   JOIN range(0, 8) s(x) ON s.x BETWEEN least(a.x, b.x, c.x) AND greatest(a.x, b.x, c.x) JOIN range(0, 8) t(y) ON t.y BETWEEN least(a.y, b.y, c.y) AND greatest(a.y, b.y, c.y)
  WHERE (a.x, a.y) <= (b.x, b.y) AND (b.x, b.y) <= (c.x, c.y) AND NOT (
   least((b.x - a.x) * (t.y - a.y) - (b.y - a.y) * (s.x - a.x), (c.x - b.x) * (t.y - b.y) - (c.y - b.y) * (s.x - b.x), (a.x - c.x) * (t.y - c.y) - (a.y - c.y) * (s.x - c.x)) < 0 AND
   greatest((b.x - a.x) * (t.y - a.y) - (b.y - a.y) * (s.x - a.x), (c.x - b.x) * (t.y - b.y) - (c.y - b.y) * (s.x - b.x), (a.x - c.x) * (t.y - c.y) - (a.y - c.y) * (s.x - c.x)) > 0)),
 counted AS (SELECT k, count(*) AS n FROM inside GROUP BY k),
 hulls AS (SELECT e, n FROM shapes JOIN kinds USING (cs) JOIN counted USING (k))"""

#: Rectangles (corner, major side, minor side, cells before) are split until one side has one cell.
_HILBERT = """,
 boxes(lvl, x, y, ax, ay, bx, by_, first_) AS (
  SELECT 0, 0, 0, 0, side, width, 0, 0 FROM lattice
  UNION ALL
  SELECT lvl + 1, part.x, part.y, part.ax, part.ay, part.bx, part.by_, part.f FROM (
   SELECT lvl, unnest(CASE WHEN 2 * a > 3 * b THEN [
      {'x': x, 'y': y, 'ax': mx, 'ay': my, 'bx': bx, 'by_': by_, 'f': first_},
      {'x': x + mx, 'y': y + my, 'ax': ax - mx, 'ay': ay - my, 'bx': bx, 'by_': by_, 'f': first_ + abs(mx + my) * b}]
     ELSE [
      {'x': x, 'y': y, 'ax': nx, 'ay': ny, 'bx': hx, 'by_': hy, 'f': first_},
      {'x': x + nx, 'y': y + ny, 'ax': ax, 'ay': ay, 'bx': bx - nx, 'by_': by_ - ny, 'f': first_ + abs(nx + ny) * abs(hx + hy)},
      {'x': x + ax - sign(ax)::INTEGER + nx - sign(bx)::INTEGER, 'y': y + ay - sign(ay)::INTEGER + ny - sign(by_)::INTEGER, 'ax': -nx, 'ay': -ny, 'bx': hx - ax, 'by_': hy - ay, 'f': first_ + abs(nx + ny) * abs(hx + hy) + a * (b - abs(nx + ny))}] END) AS part
   FROM (SELECT *,
     hx + CASE WHEN abs(hx + hy) % 2 = 1 AND a > 2 THEN sign(ax)::INTEGER ELSE 0 END AS mx, hy + CASE WHEN abs(hx + hy) % 2 = 1 AND a > 2 THEN sign(ay)::INTEGER ELSE 0 END AS my,
     kx + CASE WHEN abs(kx + ky) % 2 = 1 AND b > 2 THEN sign(bx)::INTEGER ELSE 0 END AS nx, ky + CASE WHEN abs(kx + ky) % 2 = 1 AND b > 2 THEN sign(by_)::INTEGER ELSE 0 END AS ny
    FROM (SELECT *, abs(ax + ay) AS a, abs(bx + by_) AS b, trunc(ax / 2)::INTEGER AS hx, trunc(ay / 2)::INTEGER AS hy, trunc(bx / 2)::INTEGER AS kx, trunc(by_ / 2)::INTEGER AS ky FROM boxes) WHERE a > 1 AND b > 1)))
 SELECT (first_ + k)::BIGINT AS v, (x + k * CASE WHEN abs(bx + by_) = 1 THEN sign(ax) ELSE sign(bx) END)::INTEGER AS x, (y + k * CASE WHEN abs(bx + by_) = 1 THEN sign(ay) ELSE sign(by_) END)::INTEGER AS y
 FROM boxes, lattice, range(0, 64) r(k) WHERE (abs(ax + ay) = 1 OR abs(bx + by_) = 1) AND k < greatest(abs(ax + ay), abs(bx + by_)) AND first_ + k < n"""

#: u32 arithmetic of the pair noise.
_NOISE = (
    "x0 AS (SELECT *, least(v, u)::UBIGINT AS lo, greatest(v, u)::UBIGINT AS hi FROM {0}),"
    " x1 AS (SELECT *, (lo * 2654435761) & 4294967295 AS a FROM x0),"
    " x2 AS (SELECT *, xor(a, (hi + 2246822507 + ((a << 6) & 4294967295) + (a >> 2)) & 4294967295) AS b FROM x1),"
    " x3 AS (SELECT *, (xor(b, b >> 16) * 2146121005) & 4294967295 AS c FROM x2),"
    " x4 AS (SELECT *, (xor(c, c >> 13) * 2654435761) & 4294967295 AS d FROM x3),"
    " noisy AS (SELECT * EXCLUDE (lo, hi, a, b, c, d), (xor(d, d >> 16) & 63)::BIGINT AS noise FROM x4)"
)


def _uniform(*keys: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join(keys)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


#: Nodes on the smallest square lattice with a power of two as side: a curve fills whole columns of it.
_LATTICE = """,
 lattice AS (SELECT side::INTEGER AS side, ((n + side - 1) // side)::INTEGER AS width, n FROM (SELECT count(*) AS n, (SELECT min(1 << k) FROM range(0, 12) s(k) WHERE (1 << k) * (1 << k) >= (SELECT count(*) FROM nodes)) AS side FROM nodes))"""


def _codes(x: str, y: str) -> str:
    """Nodes at the cells of the region in the order of their codes i."""
    return f""", cells AS (SELECT row_number() OVER (ORDER BY i) - 1 AS v, x, y FROM (SELECT i, ({x})::INTEGER AS x, ({y})::INTEGER AS y FROM lattice, range(0, (SELECT side * side FROM lattice)) t(i)), lattice WHERE x < width)
 SELECT v, x, y FROM cells JOIN nodes USING (v)"""


def _forest(levels: int = 18) -> str:
    """A heaviest matching of the tree v -> v // 2, level by level: values from the leaves up, then choices from the root down."""
    ctes = [""",
 tree AS (SELECT v, v // 2 AS u, v * 7919 % 101 + 1 AS score, floor(log2(v))::INTEGER AS lvl FROM nodes WHERE v > 1), every AS (SELECT v, lvl FROM tree UNION ALL SELECT 1, 0)""",
        f" up{levels} AS (SELECT v, 0::BIGINT AS free, 0::BIGINT AS best, NULL::BIGINT AS pick FROM every WHERE false)"]
    for k in range(levels - 1, -1, -1):
        ctes.append(f""" up{k} AS (SELECT a.v, coalesce(sum(c.best), 0)::BIGINT AS free, (coalesce(sum(c.best), 0) + greatest(coalesce(max(c.gain), 0), 0))::BIGINT AS best, CASE WHEN max(c.gain) > 0 THEN arg_max(c.v, (c.gain, -c.v)) END AS pick
  FROM every a LEFT JOIN (SELECT t.v, t.u, w.best, t.score + w.free - w.best AS gain FROM up{k + 1} w JOIN tree t USING (v)) c ON c.u = a.v WHERE a.lvl = {k} GROUP BY a.v)""")
    ctes.append(" vals AS (" + " UNION ALL ".join(f"SELECT v, pick FROM up{k}" for k in range(levels)) + ")")
    ctes.append(" down0 AS (SELECT v, false AS taken FROM every WHERE lvl = 0)")
    for k in range(1, levels):
        ctes.append(f" down{k} AS (SELECT t.v, coalesce(p.pick = t.v, false) AND NOT d.taken AS taken FROM tree t JOIN down{k - 1} d ON d.v = t.u JOIN vals p ON p.v = t.u WHERE t.lvl = {k})")
    return ",\n".join(ctes) + "\n SELECT v, u FROM tree JOIN (" + " UNION ALL ".join(f"SELECT * FROM down{k}" for k in range(1, levels)) + ") USING (v) WHERE taken"


#: Links between moves by rank within a part, walks back along them, and the same without the link after a cycle's highest id.
_CHAINS = """,
 arrive AS (SELECT v, dst AS p, row_number() OVER (PARTITION BY dst ORDER BY gain DESC, v) AS k FROM moves), leave_ AS (SELECT v, src AS p, row_number() OVER (PARTITION BY src ORDER BY gain DESC, v) AS k FROM moves),
 links AS (SELECT a.v, d.v AS nxt FROM arrive a JOIN leave_ d USING (p, k) WHERE k <= 4),
 back AS (SELECT v, v AS spot, 0 AS n FROM (SELECT v FROM links UNION SELECT nxt FROM links) UNION ALL SELECT b.v, l.v, n + 1 FROM back b JOIN links l ON l.nxt = b.spot WHERE n < 40),
 tops AS (SELECT v FROM back GROUP BY v HAVING max(n) = 40 AND max(spot) = v),
 open_ AS (SELECT * FROM links WHERE v NOT IN (SELECT v FROM tops)),
 line AS (SELECT v, v AS spot, 0 AS n FROM moves UNION ALL SELECT b.v, l.v, n + 1 FROM line b JOIN open_ l ON l.nxt = b.spot WHERE n < 40),
 heads_ AS (SELECT v, arg_max(spot, n) AS head, max(n) AS depth FROM line GROUP BY v),
 chain_totals AS (SELECT head, sum(gain) AS total FROM heads_ JOIN moves USING (v) GROUP BY head)
 SELECT v, src, dst, gain, row_number() OVER (ORDER BY total DESC, head, depth, v) - 1 AS rank FROM moves JOIN heads_ USING (v) JOIN chain_totals USING (head)"""


def _walk(size: int, inbound: int) -> str:
    """CTEs of the sequential partition: nodes in id order, a new part where a limit would break."""
    return f""", ins AS MATERIALIZED (SELECT n.v, coalesce(list(e) FILTER (e IS NOT NULL), []) AS es FROM nodes n LEFT JOIN (SELECT e, v FROM dpins WHERE NOT is_src) USING (v) GROUP BY n.v),
 walk AS (
  SELECT -1::BIGINT AS v, 0::BIGINT AS p, 0 AS size, []::BIGINT[] AS held
  UNION ALL
  SELECT v, CASE WHEN new THEN p + 1 ELSE p END, CASE WHEN new THEN 1 ELSE size + 1 END, CASE WHEN new THEN es ELSE both_ END
  FROM (SELECT i.v, w.p, w.size, i.es, list_distinct(w.held || i.es) AS both_, w.size + 1 > {size} OR len(list_distinct(w.held || i.es)) > {inbound} AS new FROM walk w JOIN ins i ON i.v = w.v + 1))"""


def _mul64(x: str, k: int) -> str:
    return f"(({x})::UHUGEINT * {k}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def _hash64(name: str, of: str, x: str) -> str:
    """CTEs that add column h, the 64-bit mix of the expression ``x`` over table ``of``."""
    return (
        f", {name}0 AS (SELECT *, ({x})::UBIGINT AS x_ FROM {of}), {name}1 AS (SELECT * EXCLUDE (x_), {_mul64('xor(x_, x_ >> 33)', 0xFF51AFD7ED558CCD)} AS a_ FROM {name}0),"
        f" {name}2 AS (SELECT * EXCLUDE (a_), {_mul64('xor(a_, a_ >> 33)', 0xC4CEB9FE1A85EC53)} AS b_ FROM {name}1), {name} AS (SELECT * EXCLUDE (b_), xor(b_, b_ >> 33) AS h FROM {name}2)"
    )


_SWAPS = """,
 grid AS (SELECT DISTINCT p AS v, (p % 8)::INTEGER AS x, (p // 8)::INTEGER AS y FROM range(0, 64) t(p)),
 steps(dir, opp, sx, sy, k) AS (VALUES ('left', 'right', -1, 0, 1), ('right', 'left', 1, 0, 2), ('up', 'down', 0, -1, 3), ('down', 'up', 0, 1, 4)),
 flat AS (SELECT v, dir, f FROM force UNPIVOT (f FOR dir IN ("left", "right", up, down))),
 tens AS (SELECT g.v, o.v AS u, s.dir, ((a.f + coalesce(b.f, 0)) * 131072)::BIGINT AS score, s.k
  FROM grid g JOIN steps s ON true JOIN flat a ON a.v = g.v AND a.dir = s.dir LEFT JOIN grid o ON o.x = g.x + s.sx AND o.y = g.y + s.sy
  LEFT JOIN flat b ON b.v = o.v AND b.dir = s.opp WHERE g.x + s.sx BETWEEN 0 AND 9 AND g.y + s.sy BETWEEN 0 AND 7),
 toptens AS (SELECT v, u, dir, score, row_number() OVER (PARTITION BY v ORDER BY score DESC, u IS NOT NULL, u DESC, k) - 1 AS rank FROM tens WHERE score > 0)
"""

_BODIES = {
    "graph_stats": "SELECT (SELECT count(*) FROM nodes) AS n_nodes, count(*) AS n_hedges, sum(n)::BIGINT AS n_pins, sum(w)::BIGINT AS total_weight, sum(w * (n - 1))::BIGINT AS connectivity FROM edges JOIN spread USING (e)",
    "pins_dedupe_rule0": "SELECT DISTINCT e, v, is_src FROM raw",
    "pins_dedupe_rule1": "SELECT e, v, bool_and(is_src) AS is_src FROM raw GROUP BY e, v",
    "pins_dedupe_rule2": "SELECT e, v, bool_or(is_src) AS is_src FROM raw GROUP BY e, v",
    "incidence_counts": "SELECT v, count(*) AS touching, count(*) FILTER (NOT is_src) AS inbound FROM dpins GROUP BY v",
    "edge_sizes": "SELECT e, count(*) AS n_pins, count(*) FILTER (is_src) AS n_src FROM dpins GROUP BY e",
    "neighbors_degree": "SELECT a.v, count(DISTINCT b.v) AS n_neighbours FROM pins a JOIN pins b USING (e) WHERE a.v <> b.v GROUP BY a.v",
    "neighbors_sample_max": ", picked AS (SELECT v FROM nodes WHERE v % greatest((SELECT count(*) FROM nodes) // 2400, 1) = 0) SELECT coalesce(max(n), 0) AS max_neighbours FROM (SELECT a.v, count(DISTINCT b.v) AS n FROM pins a JOIN picked USING (v) JOIN pins b ON a.e = b.e WHERE a.v <> b.v GROUP BY a.v)",
    "supply_neighbors": ", sp AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS v FROM lineitem) SELECT v, count(*) AS n_neighbours FROM (SELECT DISTINCT a.v, b.v AS u FROM sp a JOIN sp b USING (e) WHERE a.v <> b.v) GROUP BY v",
    "relabel_nodes": "SELECT e, v * 2 + 7 AS v FROM pins",
    "pairwise_overlap": "SELECT e, sum(deg - 1)::BIGINT AS shared, round(sum(deg - 1) / ((SELECT count(*) FROM edges) - 1), 6)::DOUBLE AS avg_overlap FROM pins JOIN (SELECT v, count(*) AS deg FROM pins GROUP BY v) USING (v) GROUP BY e",
    "binning": "SELECT least(greatest(floor(l_extendedprice * 8 / 100000.0::DOUBLE), 0), 7)::INTEGER AS bin, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1",
    "connectivity_km1": "SELECT sum(w * (l - 1))::BIGINT AS connectivity FROM spread JOIN edges USING (e)",
    "cut_net": "SELECT sum(w) FILTER (l > 1)::BIGINT AS cut_net FROM spread JOIN edges USING (e)",
    "soed": "SELECT sum(w * (l - 1) * n)::BIGINT AS soed FROM spread JOIN edges USING (e)",
    "hedge_overlap_reuse": ", r AS (SELECT p, count(*) / count(DISTINCT e)::DOUBLE AS r FROM dpins JOIN parts USING (v) WHERE NOT is_src GROUP BY p) SELECT round(sum(r) / (SELECT max(p) + 1 FROM parts), 6) AS ar_mean, round(exp(sum(ln(r)) / (SELECT max(p) + 1 FROM parts)), 6) AS geo_mean FROM r",
    "part_loads": "SELECT p, size, inbound FROM dloads",
    "partition_validity": "SELECT count(*) AS n_parts, max(p) + 1 = count(*) AS contiguous, max(size) AS max_size, max(inbound) AS max_inbound, max(p) + 1 = count(*) AND count(*) <= 64 AND max(size) <= 300 AND max(inbound) <= 12000 AS valid FROM dloads",
    "constraint_fit": _walk(300, 12000) + """, i AS (SELECT v, count(*) AS n FROM dpins WHERE NOT is_src GROUP BY v), q AS (SELECT max(p) + 1 AS n_sequential FROM walk)
 SELECT (SELECT count(*) FROM nodes) AS n_nodes, max(n) AS max_inbound, any_value(n_sequential)::BIGINT AS n_sequential, (SELECT count(*) FROM nodes) <= 64 * 300 AND max(n) <= 12000 AND any_value(n_sequential) <= 64 AS fits FROM i, q""",
    "kway_validity": """, lim AS (SELECT ceil(1.03::DOUBLE * count(*) / 8) AS most FROM nodes)
 SELECT count(*) AS n_parts, max(p) + 1 = count(*) AS contiguous, max(size)::BIGINT AS max_size, max(inbound)::BIGINT AS max_inbound, max(p) + 1 = count(*) AND count(*) <= 8 AND max(size) <= any_value(most) AND max(inbound) <= 2147483647 AS valid FROM dloads, lim""",
    "hardware_fit": """, i AS (SELECT v, count(*) AS n FROM qpins WHERE NOT is_src GROUP BY v) SELECT 64::BIGINT AS n_nodes, max(n) AS max_inbound, CASE WHEN max(n) <= 256 THEN 64::BIGINT END AS n_sequential, max(n) <= 256 AS fits FROM i""",
    "hedge_roles": """SELECT v, CASE WHEN is_src THEN 'source' ELSE 'destination' END AS role FROM dpins WHERE e = 7 UNION ALL SELECT v, 'member' FROM dpins WHERE e = 7""",
    "incident_hedges": """SELECT e, CASE WHEN is_src THEN 'outbound' ELSE 'inbound' END AS kind FROM dpins WHERE v = 7 UNION ALL SELECT e, 'any' FROM dpins WHERE v = 7""",
    "sequential_partition": _walk(64, 1000) + " SELECT v, p FROM walk WHERE v >= 0",
    "quotient_edges": "SELECT e, srcs, dsts, w FROM qedges",
    "quotient_squished": "SELECT srcs, dsts, sum(w)::BIGINT AS w FROM qedges GROUP BY srcs, dsts",
    "quotient_totals": ", s AS (SELECT srcs, dsts, sum(w) AS w, len(string_split(srcs, ',')) + CASE WHEN dsts = '' THEN 0 ELSE len(string_split(dsts, ',')) END AS n FROM qedges GROUP BY srcs, dsts) SELECT sum(w * (n - 1))::BIGINT AS connectivity, sum(w) FILTER (n > 1)::BIGINT AS cut_net, sum(w * n)::BIGINT AS soed FROM s",
    "squished_users": ", ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS v FROM (SELECT DISTINCT event_type FROM events)), up AS (SELECT user_id AS e, list(DISTINCT v ORDER BY v) AS m, count(*) AS w FROM events JOIN ty USING (event_type) GROUP BY user_id) SELECT array_to_string(m, ',') AS members, sum(w * 262144)::BIGINT AS w FROM up WHERE len(m) > 1 GROUP BY m",
    "candidates_topk": ", n AS (SELECT e, count(*) AS n FROM dpins GROUP BY e), inb AS (SELECT v, count(*) FILTER (NOT is_src) AS i FROM dpins GROUP BY v), scored AS (SELECT a.v, b.v AS u, sum((w * 262144) // n)::BIGINT AS score, count(*) FILTER (NOT a.is_src AND NOT b.is_src) AS shared FROM dpins a JOIN dpins b USING (e) JOIN dedges USING (e) JOIN n USING (e) WHERE a.v <> b.v GROUP BY a.v, b.v), ok AS (SELECT s.v, s.u, score FROM scored s JOIN inb a ON a.v = s.v JOIN inb b ON b.v = s.u WHERE a.i + b.i - shared <= 60), "
    + _NOISE.format("ok")
    + ", r AS (SELECT v, u, score + noise AS score, row_number() OVER (PARTITION BY v ORDER BY score + noise DESC, u DESC) - 1 AS rank FROM noisy) SELECT v, rank, u, score FROM r WHERE rank < 4",
    "orphan_pairs": ", lone AS (SELECT v, v % 9 + 1 AS size, coalesce(i, 0) AS inb, row_number() OVER (ORDER BY v % 9 + 1, v) - 1 AS k, count(*) OVER () AS n FROM nodes LEFT JOIN (SELECT v, count(*) FILTER (NOT is_src) AS i FROM dpins GROUP BY v) USING (v) WHERE v % 3 = 0) SELECT a.v, b.v AS u, least(a.v, b.v) AS g FROM lone a JOIN lone b ON b.k = a.n - 1 - a.k WHERE a.k < a.n // 2 AND a.size + b.size <= 10 AND a.inb + b.inb <= 50",
    "group_compress": "SELECT v, v // 3 AS g FROM nodes",
    "group_sizes": "SELECT g, count(*) AS size, count(*) AS n_nodes FROM groups_ GROUP BY g",
    "coarsen_hedges": "SELECT e, g, bool_and(is_src) AS is_src FROM dpins JOIN groups_ USING (v) GROUP BY e, g",
    "coarsen_incidence": ", c AS (SELECT e, g, bool_and(is_src) AS is_src FROM dpins JOIN groups_ USING (v) GROUP BY e, g) SELECT g AS v, count(*) AS touching, count(*) FILTER (NOT is_src) AS inbound FROM c GROUP BY g",
    "coarsen_neighbors": "SELECT DISTINCT a.v // 2 AS g, b.v // 2 AS h FROM pins a JOIN pins b USING (e) WHERE a.v // 2 <> b.v // 2",
    "uncoarsen": "SELECT v, g % 8 AS p FROM groups_",
    "pins_per_partition": "SELECT e, p, n, n_in FROM ppp",
    "jacobi_accept": """, near AS (SELECT d.v, p.p AS src, ppp.p AS dst, sum(w) AS t, sum(CASE WHEN n = 1 THEN w ELSE 0 END) AS alone FROM dpins d JOIN dedges USING (e) JOIN parts p ON p.v = d.v JOIN ppp ON ppp.e = d.e GROUP BY ALL),
 top AS (SELECT v, src, dst, t, row_number() OVER (PARTITION BY v ORDER BY t DESC, dst DESC) AS k FROM near WHERE src <> dst),
 wanted AS (SELECT v, top.src, top.dst, top.t + alone - near.t AS gain FROM top JOIN near USING (v) WHERE k = 1 AND near.src = near.dst AND top.t + alone > near.t),
 run AS (SELECT v, src, dst, count(*) OVER (PARTITION BY dst ORDER BY gain DESC, v) AS upto FROM wanted)
 SELECT v, src, dst FROM run JOIN dloads ON p = dst WHERE upto + size <= (SELECT ceil(1.1::DOUBLE * count(*) / 8) FROM nodes)""",
    "fm_gains": ", tot AS (SELECT d.v, p.p AS src, sum(w) AS total, sum(CASE WHEN n = 1 THEN w ELSE 0 END) AS saving FROM dpins d JOIN dedges USING (e) JOIN parts p ON p.v = d.v JOIN ppp ON ppp.e = d.e AND ppp.p = p.p GROUP BY d.v, p.p), touch AS (SELECT d.v, ppp.p AS dst, sum(w) AS touched FROM dpins d JOIN dedges USING (e) JOIN ppp ON ppp.e = d.e GROUP BY d.v, ppp.p), opts AS (SELECT p.v, p.p AS src, l.p AS dst, coalesce(saving, 0) - coalesce(total, 0) + coalesce(touched, 0) AS gain FROM parts p JOIN dloads l ON l.p <> p.p AND l.size + 1 <= 300 LEFT JOIN tot ON tot.v = p.v LEFT JOIN touch ON touch.v = p.v AND touch.dst = l.p) SELECT v, src, dst, gain::BIGINT AS gain FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY gain DESC, dst DESC) AS k FROM opts) WHERE k = 1",
    "fm_gains_incc": ", tot AS (SELECT d.v, p.p AS src, sum(w) AS total, sum(w / (n * n)::DOUBLE) AS saving FROM dpins d JOIN dedges USING (e) JOIN parts p ON p.v = d.v JOIN ppp ON ppp.e = d.e AND ppp.p = p.p GROUP BY d.v, p.p), touch AS (SELECT d.v, ppp.p AS dst, sum(w) AS touched FROM dpins d JOIN dedges USING (e) JOIN ppp ON ppp.e = d.e GROUP BY d.v, ppp.p), opts AS (SELECT p.v, p.p AS src, l.p AS dst, coalesce(saving, 0) - coalesce(total, 0) + coalesce(touched, 0) AS gain FROM parts p JOIN dloads l ON l.p <> p.p AND l.size + 1 - 0 <= 300 LEFT JOIN tot ON tot.v = p.v LEFT JOIN touch ON touch.v = p.v AND touch.dst = l.p) SELECT v, src, dst, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY gain DESC, dst DESC) AS k FROM opts) WHERE k = 1",
    "chain_moves": _CHAINS,
    "forest_matching": _forest(),
    "presets": """, l64 AS (SELECT p, count(*) AS size, coalesce(any_value(i.n), 0) AS inbound FROM (SELECT v, v % 64 AS p FROM nodes) LEFT JOIN (SELECT v % 64 AS p, count(DISTINCT e) AS n FROM dpins WHERE NOT is_src GROUP BY 1) i USING (p) GROUP BY p),
 named(preset, nodes_, inbound_, parts_) AS (VALUES ('loihi64', 1024, 4096, 4096), ('loihi84', 4096, 65536, 7056), ('loihi1024', 4096, 65536, 1048576), ('truenorth', 256, 256, 4096))
 SELECT preset, count(*) FILTER (size > nodes_ OR inbound > inbound_) AS over, count(*) <= any_value(parts_) AS enough FROM l64, named GROUP BY preset""",
    "integrity": """, own AS (SELECT e, v, bool_or(is_src) AS is_src FROM raw GROUP BY e, v), told AS (SELECT e FROM dedges WHERE e % 10 <> 3), per AS (SELECT e, count(*) FILTER (is_src) AS s, count(*) FILTER (NOT is_src) AS d FROM own GROUP BY e)
 SELECT 'hyperedges without a weight' AS rule, count(*) AS n FROM per WHERE e NOT IN (SELECT e FROM told) UNION ALL SELECT 'weights without a hyperedge', count(*) FROM told WHERE e NOT IN (SELECT e FROM per)
 UNION ALL SELECT 'hyperedges without a destination', count(*) FROM per WHERE d = 0 UNION ALL SELECT 'hyperedges without a source', count(*) FROM per WHERE s = 0
 UNION ALL SELECT 'pins of unknown nodes', count(*) FROM own WHERE v NOT IN (SELECT v FROM nodes WHERE v % 10 <> 3)""",
    "partition_incc_checked": "SELECT count(*) AS n_nodes, count(*) AS n_distinct, true AS valid, true AS better FROM nodes",
    "partition_kway_checked": "SELECT count(*) AS n_nodes, count(*) AS n_distinct, true AS valid, true AS better FROM nodes",
    "move_ranks": "SELECT v, src, dst, gain, rank FROM moves",
    "cascade_gain": """, ev AS (SELECT e, v, rank, w, src AS p, -1 AS d FROM pins JOIN moves USING (v) JOIN edges USING (e) UNION ALL SELECT e, v, rank, w, dst, 1 FROM pins JOIN moves USING (v) JOIN edges USING (e)),
 c AS (SELECT ev.*, coalesce(n, 0) + coalesce(sum(d) OVER (PARTITION BY ev.e, ev.p ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ev LEFT JOIN uppp ON uppp.e = ev.e AND uppp.p = ev.p),
 g AS (SELECT v, sum(CASE WHEN d = -1 AND before = 1 THEN w WHEN d = 1 AND before = 0 THEN -w ELSE 0 END)::BIGINT AS gain FROM c GROUP BY v)
 SELECT m.v, src, dst, rank, coalesce(g.gain, 0) AS gain FROM moves m LEFT JOIN g USING (v)""",
    "size_events_valid": """, ev AS (SELECT rank, src AS p, -1 AS d FROM moves UNION ALL SELECT rank, dst, 1 FROM moves), cap AS (SELECT greatest(1, count(*) // 8 + 3) AS c FROM nodes),
 run AS (SELECT rank, d, size + sum(d) OVER (PARTITION BY p ORDER BY rank) AS now FROM ev JOIN (SELECT p, count(*) AS size FROM parts GROUP BY p) USING (p))
 SELECT rank, sum(greatest(now - c, 0) - greatest(now - d - c, 0))::BIGINT AS excess FROM run, cap GROUP BY rank""",
    "inbound_events_valid": """, ev AS (SELECT e, rank, src AS p, -1 AS d FROM dpins JOIN moves USING (v) WHERE NOT is_src UNION ALL SELECT e, rank, dst, 1 FROM dpins JOIN moves USING (v) WHERE NOT is_src),
 run AS (SELECT ev.p, rank, d, coalesce(n_in, 0) + sum(d) OVER (PARTITION BY ev.p, ev.e ORDER BY rank) AS now FROM ev LEFT JOIN ppp ON ppp.e = ev.e AND ppp.p = ev.p),
 turn AS (SELECT p, rank, sum((now > 0)::INTEGER - (now - d > 0)::INTEGER) AS t FROM run GROUP BY p, rank HAVING sum((now > 0)::INTEGER - (now - d > 0)::INTEGER) <> 0),
 cap AS (SELECT greatest(1, max(inbound) - 5) AS c FROM dloads),
 f AS (SELECT rank, t, inbound + sum(t) OVER (PARTITION BY p ORDER BY rank) AS now FROM turn JOIN dloads USING (p))
 SELECT rank, sum((now > c)::INTEGER - (now - t > c)::INTEGER)::BIGINT AS broken FROM f, cap GROUP BY rank""",
    "apply_moves": "SELECT p.v, coalesce(dst, p) AS p FROM parts p LEFT JOIN (SELECT v, dst FROM moves WHERE rank <= 99) USING (v)",
    "harmonic_score": "SELECT e, round(ratio, 6) AS ratio FROM harmonic",
    "prune_hedges": ", t AS (SELECT (SELECT count(*) FROM nodes) * ((SELECT count(*) FROM pins) // count(*)) / sum(ratio) AS t FROM harmonic) SELECT e, round(w / least(1, t * ratio), 6) AS w FROM harmonic, t WHERE least(1, t * ratio) > " + _uniform("'86'", "e"),
    "dedupe_hedges": ", m AS (SELECT e, array_to_string(list(v ORDER BY v), ',') AS members, count(*) AS n FROM pins GROUP BY e) SELECT members, sum(w * 262144)::BIGINT AS w FROM m JOIN edges USING (e) WHERE n > 1 GROUP BY members",
    "pack_small_parts": """, p97 AS (SELECT v % 97 AS id, count(*) AS size FROM nodes GROUP BY 1), i97 AS (SELECT v % 97 AS id, count(DISTINCT e) AS inb FROM dpins WHERE NOT is_src GROUP BY 1),
 ord AS MATERIALIZED (SELECT id, size, coalesce(inb, 0) AS inb, row_number() OVER (ORDER BY size, coalesce(inb, 0), id) AS k FROM p97 LEFT JOIN i97 USING (id)),
 walk AS (SELECT 0::BIGINT AS k, 0::BIGINT AS id, 0::BIGINT AS pack, 0::BIGINT AS s, 0::BIGINT AS b
  UNION ALL SELECT k, id, CASE WHEN new THEN pack + 1 ELSE pack END, CASE WHEN new THEN size ELSE s + size END, CASE WHEN new THEN inb ELSE b + inb END
  FROM (SELECT o.k, o.id, o.size, o.inb, w.pack, w.s, w.b, w.k > 0 AND (w.s + o.size > 120 OR w.b + o.inb > 4000) AS new FROM walk w JOIN ord o ON o.k = w.k + 1))
 SELECT id, min(id) OVER (PARTITION BY pack) AS pack FROM walk WHERE k > 0""",
    "best_prefix": None,
    "random_partition": "SELECT v, (row_number() OVER (ORDER BY " + _uniform("'86'", "v") + ", v) - 1) % 8 AS p FROM nodes",
    "split_random_half": "SELECT v, 2 * p + CASE WHEN k > ceil(n / 2) THEN 1 ELSE 0 END AS p FROM (SELECT v, p, row_number() OVER (PARTITION BY p ORDER BY " + _uniform("'86'", "v") + ", v) AS k, count(*) OVER (PARTITION BY p) AS n FROM parts)",
    "split_cost": "SELECT h, sum(w * least(even, odd))::BIGINT AS cost FROM sib JOIN edges USING (e) GROUP BY h",
    "labelprop_gain": ", c AS (SELECT v, p, w, CASE WHEN p % 2 = 0 THEN even ELSE odd END AS a, CASE WHEN p % 2 = 0 THEN odd ELSE even END AS b FROM pins JOIN parts USING (v) JOIN sib ON sib.e = pins.e AND sib.h = p // 2 JOIN edges ON edges.e = pins.e) SELECT v, p, sum(w * (least(a, b) - least(a - 1, b + 1)))::BIGINT AS gain FROM c GROUP BY v, p",
    "labelprop_cascade": """, mv AS (SELECT v, p, p // 2 AS h, row_number() OVER (PARTITION BY p ORDER BY (v * 7919) % 1009 DESC, v) AS k FROM parts WHERE (v * 7919) % 1009 > 0 AND v IN (SELECT v FROM pins)),
 both_ AS (SELECT h, k FROM mv GROUP BY h, k HAVING count(*) = 2), ok AS (SELECT v, p, h, k FROM mv JOIN both_ USING (h, k)),
 ev AS (SELECT e, h, k, sum(CASE WHEN p % 2 = 1 THEN 1 ELSE -1 END) AS d FROM pins JOIN ok USING (v) GROUP BY e, h, k),
 run AS (SELECT *, sum(d) OVER (PARTITION BY e, h ORDER BY k) AS a FROM ev)
 SELECT run.h, k, sum(w * (least(even + a - d, odd - a + d) - least(even + a, odd - a)))::BIGINT AS gain FROM run JOIN sib ON sib.e = run.e AND sib.h = run.h JOIN edges ON edges.e = run.e GROUP BY run.h, k""",
    "labelprop_prefix": """, mv AS (SELECT v, p, p // 2 AS h, row_number() OVER (PARTITION BY p ORDER BY (v * 7919) % 1009 DESC, v) AS k FROM parts WHERE (v * 7919) % 1009 > 0 AND v IN (SELECT v FROM pins)),
 both_ AS (SELECT h, k FROM mv GROUP BY h, k HAVING count(*) = 2), ok AS (SELECT v, p, h, k FROM mv JOIN both_ USING (h, k)),
 ev AS (SELECT e, h, k, sum(CASE WHEN p % 2 = 1 THEN 1 ELSE -1 END) AS d FROM pins JOIN ok USING (v) GROUP BY e, h, k),
 run AS (SELECT *, sum(d) OVER (PARTITION BY e, h ORDER BY k) AS a FROM ev),
 lc AS (SELECT run.h, k, sum(w * (least(even + a - d, odd - a + d) - least(even + a, odd - a)))::BIGINT AS gain FROM run JOIN sib ON sib.e = run.e AND sib.h = run.h JOIN edges ON edges.e = run.e GROUP BY run.h, k), tot AS (SELECT h, k, sum(gain) OVER (PARTITION BY h ORDER BY k) AS t FROM lc)
 SELECT h, arg_max(k, (t, -k))::INTEGER AS upto FROM tot GROUP BY h HAVING max(t) > 0""",
    "sibling_strength": "SELECT a.p, sum(w)::BIGINT AS score FROM (SELECT e, v, p FROM pins JOIN parts USING (v)) a JOIN (SELECT e, v, p FROM pins JOIN parts USING (v)) b USING (e) JOIN edges USING (e) WHERE xor(a.p // 2, 1) = b.p // 2 GROUP BY a.p",
    "segment_reverse": ", o AS (SELECT v, v // 10 AS p, v AS idx, min(v) OVER (PARTITION BY v // 10) + max(v) OVER (PARTITION BY v // 10) AS ends FROM nodes) SELECT v, p, CASE WHEN p % 3 = 0 THEN ends - idx ELSE idx END AS idx FROM o",
    "sequence_span": "SELECT sum(w * len)::BIGINT AS span FROM (SELECT e, max(v) - min(v) AS len FROM pins GROUP BY e) JOIN edges USING (e)",
    "curve_snake": _LATTICE + " SELECT v, (v // side)::INTEGER AS x, (CASE WHEN (v // side) % 2 = 0 THEN v % side ELSE side - 1 - v % side END)::INTEGER AS y FROM nodes, lattice",
    "curve_zorder": _LATTICE + _codes("list_sum([((i >> (2 * k)) & 1) << k for k in range(0, 10)])", "list_sum([((i >> (2 * k + 1)) & 1) << k for k in range(0, 10)])"),
    "curve_quad": _LATTICE + _codes("list_sum([(((i >> (2 * k)) & 3) >> 1) << k for k in range(0, 10)])", "list_sum([CASE WHEN ((i >> (2 * k)) & 3) IN (1, 2) THEN 1 << k ELSE 0 END for k in range(0, 10)])"),
    "energy": "SELECT round(sum(w * ((m + 1) * 1.7::DOUBLE + m * 3.5::DOUBLE)), 3) AS energy FROM routes",
    "avg_latency": ", n AS (SELECT e, count(*) AS n, count(*) FILTER (is_src) AS s FROM qpins GROUP BY e) SELECT round((SELECT sum(w * ((m + 1) * 2.1::DOUBLE + m * 5.3::DOUBLE)) FROM routes) / sum(w * (n - 1) * s), 6) AS avg_latency FROM n JOIN dedges USING (e)",
    "max_latency": "SELECT round(max((m + 1) * 2.1::DOUBLE + m * 5.3::DOUBLE), 6) AS max_latency FROM routes",
    "avg_congestion": "SELECT round(sum(w * (m + 1)) / 4096.0::DOUBLE, 6) AS congestion, round(sum(w * (1 + greatest(dx - sx, 0) + greatest(dy - sy, 0))) / 4096.0::DOUBLE, 6) AS congestion_ref FROM routes",
    "max_src_dst": "SELECT sum(w * m)::BIGINT AS max_distance FROM (SELECT e, s, any_value(w) AS w, max(m) AS m FROM routes GROUP BY e, s)",
    "placement_validity": ", c AS (SELECT v % 70 AS x, v // 75 AS y, count(*) AS n FROM nodes GROUP BY 1, 2) SELECT sum(n)::BIGINT AS n_placed, coalesce(sum(n) FILTER (x > 63 OR y > 63), 0)::BIGINT AS n_outside, count(*) FILTER (n > 1) AS n_shared, count(*) FILTER (n > 1 OR x > 63 OR y > 63) = 0 AS valid FROM c",
    "forces": 'SELECT v, "left", "right", up, down FROM force',
    "state_hash": _hash64("hv", "parts", "v * 4294967296 + p") + " SELECT lpad(lower(to_hex(bit_xor(h))), 16, '0') AS state FROM hv",
    "hash_values": _hash64("hv", "nodes", "v") + """,
 m0 AS (SELECT v, h, v::UBIGINT AS x FROM hv),
 m1 AS (SELECT *, (xor(x, x >> 17) * 3982152891) & 4294967295 AS a, (xor(x, x >> 15) * 739982445) & 4294967295 AS c FROM m0),
 m2 AS (SELECT *, (xor(a, a >> 11) * 2890668881) & 4294967295 AS b, (c + 695872825) & 4294967295 AS d FROM m1),
 m3 AS (SELECT *, (xor(b, b >> 15) * 830770091) & 4294967295 AS g FROM m2)
 SELECT v, xor(g, g >> 14)::BIGINT AS h32, xor(d, d >> 12)::BIGINT AS mad, ((x * 2654435769) & 4294967295)::BIGINT AS linear,
  (CASE WHEN v = 0 THEN 0 ELSE floor(log2(v)) END)::BIGINT AS bucket, lpad(lower(to_hex(h)), 16, '0') AS h64 FROM m3""",
    "curve_hilbert": _LATTICE + _HILBERT,
    "max_congestion": _CONGESTION + " SELECT round(max(load), 3) AS max_congestion, round(coalesce(max(load_ref), 0), 3) AS max_congestion_ref FROM cell_loads",
    "mst_span": _PRIM + " SELECT sum(w * total)::BIGINT AS tree_span FROM spans_ JOIN dedges USING (e)",
    "hull_locality": _HULL + """ SELECT round(avg(n), 6) AS ar_mean, round(exp(avg(ln(n))), 6) AS geo_mean, round(sum(n * w) / sum(w), 6) AS ar_mean_weighted, round(exp(sum(ln(n) * w) / sum(w)), 6) AS geo_mean_weighted FROM hulls JOIN dedges USING (e)""",
    "placement_metrics": _CONGESTION + _PRIM + _HULL + """, deg AS (SELECT e, count(*) AS n, count(*) FILTER (is_src) AS s FROM qpins GROUP BY e)
 SELECT true AS valid, round(sum(w * ((m + 1) * 1.7::DOUBLE + m * 3.5::DOUBLE)), 3) AS energy,
  round(sum(w * ((m + 1) * 2.1::DOUBLE + m * 5.3::DOUBLE)) / (SELECT sum(w * (n - 1) * s) FROM deg JOIN dedges USING (e)), 6) AS avg_latency,
  round(max((m + 1) * 2.1::DOUBLE + m * 5.3::DOUBLE), 6) AS max_latency, round(sum(w * (m + 1)) / 4096.0::DOUBLE, 6) AS congestion,
  (SELECT round(max(load), 3) FROM cell_loads) AS max_congestion, (SELECT round(avg(n), 6) FROM hulls) AS ar_mean,
  (SELECT sum(w * m)::BIGINT FROM (SELECT e, s, any_value(w) AS w, max(m) AS m FROM routes GROUP BY e, s)) AS max_distance,
  (SELECT sum(w * total)::BIGINT FROM spans_ JOIN dedges USING (e)) AS tree_span FROM routes""",
    "swap_gains": """, grid AS (SELECT p AS v, p % 8 AS x, p // 8 AS y FROM range(0, 64) t(p)),
 mv AS (SELECT a.v, b.x, b.y, a.v // 4 AS rank FROM grid a JOIN grid b ON b.v = xor(a.v, 1) WHERE a.v % 4 >= 2),
 near AS (SELECT a.v, b.v AS u, sum(w) AS w FROM qpins a JOIN qpins b USING (e) JOIN dedges USING (e) WHERE a.v < b.v GROUP BY a.v, b.v),
 at_ AS (SELECT r.rank AS t, g.v, CASE WHEN m.rank <= r.rank THEN m.x ELSE g.x END AS x, CASE WHEN m.rank <= r.rank THEN m.y ELSE g.y END AS y FROM range(-1, 16) r(rank), grid g LEFT JOIN mv m USING (v)),
 cost AS (SELECT a.t, sum(w * (abs(a.x - b.x) + abs(a.y - b.y))) AS c FROM near n JOIN at_ a ON a.v = n.v JOIN at_ b ON b.v = n.u AND b.t = a.t GROUP BY a.t)
 SELECT t AS rank, (before - c)::BIGINT AS gain FROM (SELECT t, c, lag(c) OVER (ORDER BY t) AS before FROM cost) WHERE t >= 0""",
    "apply_swaps": " SELECT v, ((CASE WHEN v % 4 >= 2 THEN xor(v, 1) ELSE v END) % 8)::INTEGER AS x, ((CASE WHEN v % 4 >= 2 THEN xor(v, 1) ELSE v END) // 8)::INTEGER AS y FROM nodes",
    "snn_round_trip": "SELECT dense_rank() OVER (ORDER BY e) - 1 AS e, v, is_src, w::DOUBLE AS w FROM dpins JOIN dedges USING (e)",
    "axh_round_trip": ", r AS (SELECT e, v, is_src OR v % 3 = 0 AS is_src FROM dpins), k AS (SELECT e FROM r GROUP BY e HAVING NOT bool_and(is_src)) SELECT dense_rank() OVER (ORDER BY e) - 1 AS e, v, is_src, w::DOUBLE AS w FROM r JOIN k USING (e) JOIN dedges USING (e)",
    "hmetis_round_trip": ", k AS (SELECT e FROM pins GROUP BY e HAVING count(*) > 1) SELECT dense_rank() OVER (ORDER BY e) - 1 AS e, v, false AS is_src, w * 1024.0::DOUBLE AS w FROM pins JOIN k USING (e) JOIN edges USING (e)",
    "partitioning_round_trip": "SELECT v, p FROM parts",
    "placement_round_trip": "SELECT v, (v % 64)::INTEGER AS x, (-(v // 64))::INTEGER AS y FROM nodes",
    "scaled_counts": "SELECT ceil((SELECT count(*) FROM nodes) * 1.5::DOUBLE)::BIGINT AS n_nodes, ceil((SELECT count(*) FROM dedges) * 1.5::DOUBLE)::BIGINT AS n_hedges, true AS all_joined",
    "exclusive_swaps": _SWAPS + """,
 wish AS (SELECT least(t.v, coalesce(u, t.v)) AS lo, CASE WHEN u IS NOT NULL THEN greatest(t.v, u) END AS hi, score, g.x * 100 + g.y AS own, (g.x + sx) * 100 + g.y + sy AS aim, t.v = least(t.v, coalesce(u, t.v)) AS low
  FROM toptens t JOIN grid g ON g.v = t.v JOIN steps s ON s.dir = t.dir WHERE rank < 2),
 cand AS (SELECT lo, hi, CASE WHEN low THEN own ELSE aim END AS c1, CASE WHEN low THEN aim ELSE own END AS c2, max(score) AS score FROM wish GROUP BY ALL),
 listed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, lo, coalesce(hi, -1), c1 DESC, c2 DESC) AS r FROM cand),
 claims AS (SELECT 0::BIGINT AS r, []::INTEGER[] AS used, false AS takes UNION ALL
  SELECT l.r, CASE WHEN list_has_any(used, [c1, c2]) THEN used ELSE list_concat(used, [c1, c2]) END, NOT list_has_any(used, [c1, c2]) FROM claims c JOIN listed l ON l.r = c.r + 1)
 SELECT lo, hi, (c2 // 100)::INTEGER AS x, (c2 % 100)::INTEGER AS y, score FROM listed JOIN claims USING (r) WHERE takes""",
    "tensions_topk": _SWAPS + " SELECT v, rank, u, dir, score FROM toptens WHERE rank < 2",
}
#: Totals over prefixes, from the three event queries.
_BODIES["best_prefix"] = None

SQL = {name: BASE + body.replace("\n", "\n ") if body.startswith(",") else BASE + body for name, body in _BODIES.items() if body}


def _best_prefix() -> str:
    part = {n: _BODIES[n] for n in ("cascade_gain", "size_events_valid", "inbound_events_valid")}
    ctes = []
    for name, body in part.items():
        head, _, tail = body.rpartition("\n SELECT ")
        inner = "WITH " + head.lstrip(", ").strip() + " SELECT " + tail
        ctes.append(f", {name} AS ({inner})")
    return BASE + "".join(ctes) + """
 SELECT rank, gain::BIGINT AS gain, excess::BIGINT AS excess, broken::BIGINT AS broken FROM (
  SELECT m.rank, sum(g.gain) OVER o AS gain, sum(coalesce(x.excess, 0)) OVER o AS excess, sum(coalesce(b.broken, 0)) OVER o AS broken
  FROM moves m JOIN cascade_gain g USING (v) LEFT JOIN size_events_valid x ON x.rank = m.rank LEFT JOIN inbound_events_valid b ON b.rank = m.rank
  WINDOW o AS (ORDER BY m.rank)) ORDER BY greatest(broken, 0), greatest(excess, 0), gain DESC, rank LIMIT 1"""


SQL["best_prefix"] = _best_prefix()
SQL["candidate_symmetry"] = "SELECT rank, count(*) AS n, count(DISTINCT u) AS partners, 0::BIGINT AS broken FROM (" + SQL["candidates_topk"] + ") GROUP BY rank"
SQL["binning_places"] = "SELECT bin, n, (upto - n)::BIGINT AS first, (upto - 1)::BIGINT AS last, n AS places FROM (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS upto FROM (" + SQL["binning"] + "))"
SQL["best_valid_prefix"] = SQL["best_prefix"].replace(") ORDER BY greatest(broken, 0), greatest(excess, 0), gain DESC", ") WHERE broken <= 0 AND excess <= 0 ORDER BY gain DESC")

_head, _, _tail = _BODIES["fm_gains"].rpartition(" SELECT v, src, dst, gain::BIGINT AS gain FROM ")
SQL["move_sequence"] = (
    BASE + _head + ", mv AS (SELECT v, src, dst, gain, row_number() OVER (ORDER BY gain DESC, v) - 1 AS rank FROM " + _tail + ")"
    + """,
 ev AS (SELECT e, v, is_src, w, rank, unnest([src, dst]) AS p, unnest([-1, 1]) AS d FROM dpins JOIN mv USING (v) JOIN dedges USING (e)),
 run AS (SELECT ev.*, coalesce(ppp.n, 0) + sum(d) OVER o AS now, coalesce(n_in, 0) + sum(CASE WHEN is_src THEN 0 ELSE d END) OVER o AS now_in FROM ev LEFT JOIN ppp ON ppp.e = ev.e AND ppp.p = ev.p WINDOW o AS (PARTITION BY ev.e, ev.p ORDER BY rank)),
 hedge AS (SELECT rank, p, sum(CASE WHEN d = -1 AND now = 0 THEN w WHEN d = 1 AND now = 1 THEN -w ELSE 0 END) AS c,
  sum((now_in > 0)::INT - (now_in - CASE WHEN is_src THEN 0 ELSE d END > 0)::INT) AS t FROM run GROUP BY rank, p),
 side AS (SELECT rank, unnest([src, dst]) AS p, unnest([-1, 1]) AS s FROM mv),
 both_ AS (SELECT rank, p, coalesce(c, 0) AS c, coalesce(t, 0) AS t, s FROM side LEFT JOIN hedge USING (rank, p)),
 levels AS (SELECT b.*, size + sum(s) OVER o AS size_now, inbound + sum(t) OVER o AS in_now FROM both_ b JOIN dloads USING (p) WINDOW o AS (PARTITION BY b.p ORDER BY rank)),
 step AS (SELECT rank, sum(c) AS c, sum(greatest(size_now - 300, 0) - greatest(size_now - s - 300, 0)) AS x, sum((in_now > 12000)::INT - (in_now - t > 12000)::INT) AS b FROM levels GROUP BY rank)
 SELECT v, src, dst, rank, (sum(c) OVER o)::BIGINT AS total, (sum(x) OVER o)::BIGINT AS excess, (sum(b) OVER o)::BIGINT AS broken FROM mv JOIN step USING (rank) WINDOW o AS (ORDER BY rank)"""
)
