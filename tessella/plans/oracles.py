"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

_GRID = """
dim AS (SELECT n, w, (n // w // 2 * 2) AS h FROM (SELECT count(*) AS n, CASE count(*) WHEN 200 THEN 20 WHEN 2000 THEN 50
        WHEN 20000 THEN 200 ELSE 2 * (sqrt(count(*)) / 2)::INT END AS w FROM part)),
pk AS (SELECT p_partkey AS k, p_size AS s FROM part),
cells AS (
  SELECT g.k AS cell_id, (g.k // dim.w)::INT AS y, (g.k % dim.w)::INT AS x,
         (CASE WHEN p.s <= 9 THEN 5 WHEN p.s <= 10 THEN 76 WHEN p.s <= 14 THEN 13 WHEN p.s <= 24 THEN 21 WHEN p.s <= 33 THEN 31
               WHEN p.s <= 44 THEN 40 WHEN p.s <= 46 THEN 33 WHEN p.s = 47 THEN 35 ELSE 0 END)::INT AS class_code
  FROM pk g CROSS JOIN dim JOIN pk p ON p.k = ((g.k // dim.w) // 2) * (dim.w // 2) + (g.k % dim.w) // 2
  WHERE g.k < dim.h * dim.w),
m AS (SELECT *, class_code IN (5, 76) AS habitat, class_code IN (13, 21) AS restorable,
             (CASE class_code WHEN 13 THEN 1 WHEN 21 THEN 2 ELSE 0 END)::DOUBLE AS cost FROM cells),
names AS (SELECT * FROM (VALUES (0, 'nodata'), (5, 'mangrove'), (13, 'other_non_forest'), (21, 'other_agriculture'), (31, 'pond'),
          (33, 'water'), (35, 'unclassified'), (40, 'rice_field'), (76, 'peat_swamp')) AS t(class_code, class_name)),
front AS (SELECT DISTINCT a.cell_id, a.y, a.x, a.cost FROM m a JOIN m b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.habitat
          WHERE a.restorable)
"""
_PATCH = """,
adj AS (SELECT a.cell_id AS a, b.cell_id AS b FROM m a JOIN m b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE a.habitat AND b.habitat),
reach AS (SELECT cell_id AS cell, cell_id AS seed FROM m WHERE habitat UNION SELECT adj.b, reach.seed FROM reach JOIN adj ON adj.a = reach.cell),
label AS (SELECT cell AS cell_id, min(seed) AS patch_id FROM reach GROUP BY cell),
lc AS (SELECT l.*, m.y, m.x FROM label l JOIN m USING (cell_id)),
areas AS (SELECT patch_id, count(*) AS area FROM label GROUP BY 1)
"""


def _edges(r: float, name: str = "edges") -> str:
    return f""",
{name} AS (SELECT DISTINCT a.patch_id AS lo, b.patch_id AS hi FROM lc a JOIN lc b ON a.patch_id < b.patch_id
          AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= {r * r})
"""


_HOP = """,
sym AS (SELECT lo AS a, hi AS b FROM edges UNION ALL SELECT hi, lo FROM edges),
walk AS (SELECT patch_id AS src, patch_id AS dst, 0 AS hop FROM areas
         UNION SELECT w.src, s.b, w.hop + 1 FROM walk w JOIN sym s ON s.a = w.dst WHERE w.hop < 64),
hops AS (SELECT src, dst, min(hop)::INT AS hop FROM walk GROUP BY 1, 2)
"""
_COMPONENT = ", comp AS (SELECT dst AS patch_id, min(src) AS component_id FROM hops GROUP BY 1)"
_IIC = """(SELECT coalesce(sum(t ORDER BY hop), 0) / power((SELECT count(*) FROM m WHERE habitat OR restorable), 2)::DOUBLE FROM
  (SELECT hop, sum(a.area * b.area)::DOUBLE / (1 + hop) AS t FROM hops JOIN areas a ON a.patch_id = src JOIN areas b ON b.patch_id = dst GROUP BY hop))"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + "".join(parts)


_FACTS = """
f AS (SELECT o_orderkey, o_orderpriority AS resolution, (CASE o_orderkey % 3 WHEN 0 THEN 'naive' WHEN 1 THEN 'cost' ELSE 'bridge' END) AS method,
             (o_custkey % 5)::INT AS seed, cents, cost, steps, invalid
      FROM orders JOIN (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, sum(l_quantity::BIGINT)::BIGINT AS cost,
                               count(*) AS steps, count(*) FILTER (l_returnflag = 'R') AS invalid FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
"""
_STEPS = """
e AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS action,
             event_type = 'error' AS invalid, round(value, 4) AS iic, (event_id % 3 + 1)::DOUBLE AS cost FROM events)
"""
_SUMMARY = """avg(iic_initial) AS iic_initial, avg(cents)::DOUBLE AS iic_final, avg(cents)::DOUBLE AS iic_gain, stddev_samp(cents)::DOUBLE AS std_iic_gain,
  avg(cost)::DOUBLE AS cost_used, avg(cents::DOUBLE / nullif(cost, 0)) AS iic_per_unit, avg(steps) AS cells_planted, avg(steps) AS n_patches,
  avg(steps) AS largest_patch, avg(invalid::DOUBLE / steps) AS invalid_action_rate"""
_MEASURES = ["iic_initial", "iic_final", "iic_gain", "std_iic_gain", "cost_used", "iic_per_unit", "cells_planted", "n_patches", "largest_patch", "invalid_action_rate"]
_BODY = r"array_to_string(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''), chr(10))"


def _markers(table: str, key: str, column: str, names: list[str]) -> str:
    each = " + ".join(f"(length(t) - length(replace(t, '{m}', ''))) // {len(m)}" for m in names)
    return f"SELECT {key}, ({each})::BIGINT AS n_markers FROM (SELECT {key}, lower({column}) AS t FROM {table})"


def _resample(expr_y: str, expr_x: str) -> str:
    return f"""SELECT y, x, class_code FROM (SELECT y, x, class_code, row_number() OVER (PARTITION BY y, x ORDER BY n DESC, class_code) AS k
      FROM (SELECT {expr_y} AS y, {expr_x} AS x, class_code, count(*) AS n FROM cells, dim GROUP BY 1, 2, 3)) WHERE k = 1"""


def _down(th: str, tw: str) -> str:
    return _resample(f"(((y + 1) * ({th}) - 1) // dim.h)::INT", f"(((x + 1) * ({tw}) - 1) // dim.w)::INT")


def _up(at_least_one: bool) -> str:
    hi = lambda i, n, t: f"greatest({i} * {n} // {t} + 1, ({i} + 1) * {n} // {t})" if at_least_one else f"({i} + 1) * {n} // {t}"
    body = f"""
big AS (SELECT h * 3 // 2 AS th, w * 3 // 2 AS tw, h, w FROM dim),
tgt AS (SELECT ty, tx, ty * h // th AS r0, {hi("ty", "h", "th")} AS r1, tx * w // tw AS c0, {hi("tx", "w", "tw")} AS c1
        FROM big, (SELECT unnest(range(1000)) AS ty), (SELECT unnest(range(1000)) AS tx) WHERE ty < th AND tx < tw),
cnt AS (SELECT ty, tx, class_code, count(*) AS n FROM tgt JOIN cells ON y >= r0 AND y < r1 AND x >= c0 AND x < c1 GROUP BY 1, 2, 3),
top AS (SELECT ty, tx, class_code FROM (SELECT *, row_number() OVER (PARTITION BY ty, tx ORDER BY n DESC, class_code) AS k FROM cnt) WHERE k = 1)
SELECT ty::INT AS y, tx::INT AS x, coalesce(class_code, 0)::INT AS class_code FROM tgt LEFT JOIN top USING (ty, tx)"""
    return _with(_GRID, ",", body)


_HIST = "SELECT {res} AS resolution, class_code, coalesce(class_name, '?') AS class_name, n AS n_cells, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS percent FROM (SELECT class_code, count(*) AS n FROM ({src}) GROUP BY 1) LEFT JOIN names USING (class_code)"
_SCENARIO_COSTS = "(VALUES ('1:1', 13, 1), ('1:1', 21, 1), ('1:2', 13, 1), ('1:2', 21, 2), ('1:3', 13, 1), ('1:3', 21, 3)) AS t(cost_scenario, class_code, cost)"
_LANDS = "(VALUES ('main'), ('s2')) AS l(land_scenario)"

_GAIN = f""",
adjc AS (SELECT DISTINCT f.cell_id AS c, l.patch_id AS p FROM front f JOIN lc l ON abs(f.y - l.y) + abs(f.x - l.x) = 1),
nearc AS (SELECT DISTINCT f.cell_id AS c, l.patch_id AS p FROM front f JOIN lc l ON (f.y - l.y) * (f.y - l.y) + (f.x - l.x) * (f.x - l.x) <= 4),
node AS (SELECT f.cell_id AS c, a.patch_id AS p, CASE WHEN adjc.p IS NULL THEN a.patch_id ELSE -1 END AS q, a.area
         FROM front f CROSS JOIN areas a LEFT JOIN adjc ON adjc.c = f.cell_id AND adjc.p = a.patch_id),
carea AS (SELECT c, q, sum(area) + CASE WHEN q = -1 THEN 1 ELSE 0 END AS area FROM node GROUP BY c, q),
cedge AS (SELECT DISTINCT n1.c, n1.q AS a, n2.q AS b FROM edges e JOIN node n1 ON n1.p = e.lo JOIN node n2 ON n2.p = e.hi AND n2.c = n1.c WHERE n1.q <> n2.q
          UNION SELECT n.c, -1, n.q FROM nearc JOIN node n ON n.c = nearc.c AND n.p = nearc.p WHERE n.q <> -1),
csym AS (SELECT c, a, b FROM cedge UNION ALL SELECT c, b, a FROM cedge),
cwalk AS (SELECT c, q AS src, q AS dst, 0 AS hop FROM carea
          UNION SELECT w.c, w.src, s.b, w.hop + 1 FROM cwalk w JOIN csym s ON s.c = w.c AND s.a = w.dst WHERE w.hop < 24),
chops AS (SELECT c, src, dst, min(hop) AS hop FROM cwalk GROUP BY 1, 2, 3),
csum AS (SELECT h.c, h.hop, sum(x.area * y.area)::DOUBLE / (1 + h.hop) AS t FROM chops h JOIN carea x ON x.c = h.c AND x.q = h.src
         JOIN carea y ON y.c = h.c AND y.q = h.dst GROUP BY h.c, h.hop),
cgain AS (SELECT g.c AS cell_id, f.cost, round(g.s / power((SELECT count(*) FROM m WHERE habitat OR restorable), 2)::DOUBLE - {_IIC}, 12) AS gain
          FROM (SELECT c, sum(t ORDER BY hop) AS s FROM csum GROUP BY c) g JOIN front f ON f.cell_id = g.c)
"""


# Cheapest way between two components: least distances from all habitat, each cell behind its cheapest neighbour.
_BRIDGE = """,
beside AS (SELECT a.cell_id AS a, b.cell_id AS b, b.cost FROM m a JOIN m b ON abs(a.y - b.y) + abs(a.x - b.x) = 1),
dist(cell, d) USING KEY (cell) AS (SELECT cell_id, 0.0::DOUBLE FROM label
      UNION SELECT b, min(dist.d + beside.cost) FROM dist JOIN beside ON a = cell JOIN m ON m.cell_id = b AND m.restorable
            LEFT JOIN recurring.dist k ON k.cell = b WHERE k.d IS NULL OR dist.d + beside.cost < k.d GROUP BY b),
behind AS (SELECT cell, pred FROM (SELECT v.cell, u.cell AS pred, row_number() OVER (PARTITION BY v.cell ORDER BY u.d, u.cell) AS k
           FROM dist v JOIN beside ON a = v.cell JOIN dist u ON u.cell = b WHERE v.d > 0) WHERE k = 1),
owner AS (SELECT cell_id AS cell, component_id AS own FROM label JOIN comp USING (patch_id) UNION ALL SELECT p.cell, o.own FROM owner o JOIN behind p ON p.pred = o.cell),
bridge AS (SELECT u.d + v.d AS cost, u.cell AS a, v.cell AS b FROM dist u JOIN beside ON a = u.cell JOIN dist v ON v.cell = b AND u.cell < v.cell
           JOIN owner x ON x.cell = u.cell JOIN owner y ON y.cell = v.cell AND x.own <> y.own ORDER BY 1, 2, 3 LIMIT 1),
back AS (SELECT a AS cell FROM bridge WHERE cost <= 20 UNION ALL SELECT b FROM bridge WHERE cost <= 20 UNION ALL SELECT pred FROM back JOIN behind USING (cell)),
route AS (SELECT DISTINCT cell AS cell_id FROM back JOIN front ON front.cell_id = cell WHERE front.cost <= 20)
"""


def _random_episodes(configs: str, seeds: int) -> str:
    """Episodes of the random policy: final(config, seed, planted, spent, steps, n_patches, largest, iic)."""
    return _with(
        _GRID,
        _PATCH,
        _edges(5),
        _HOP,
        f""",
config AS ({configs}),
side AS (SELECT a.cell_id AS c, list(b.cell_id) AS around, bool_or(b.habitat) AS first FROM m a JOIN m b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE a.restorable GROUP BY 1),
price AS (SELECT config, side.c, around, first, CASE class_code WHEN c1 THEN p1 ELSE p2 END AS cost FROM config, side JOIN m ON m.cell_id = side.c),
ep AS (SELECT config, seed, budget, 0 AS steps, []::BIGINT[] AS planted, 0.0::DOUBLE AS spent, false AS done FROM config, (SELECT unnest(range({seeds})) AS seed)
       UNION ALL
       SELECT config, seed, budget, steps + 1, list_append(planted, pick.c), spent + pick.cost, false FROM (
         SELECT ep.config, seed, budget, steps, planted, spent,
                arg_min(struct_pack(c := p.c, cost := p.cost), struct_pack(d := (p.c * 7919 + steps * 104729 + seed * 15485863 + 12345) % 1000003, c := p.c)) AS pick
         FROM ep JOIN price AS p ON p.config = ep.config AND p.cost <= budget - spent AND NOT list_contains(planted, p.c) AND (first OR list_has_any(around, planted))
         WHERE steps < 300 GROUP BY ep.config, seed, budget, steps, planted, spent)),
last AS (SELECT * FROM ep QUALIFY row_number() OVER (PARTITION BY config, seed ORDER BY steps DESC) = 1),
hab AS (SELECT config, seed, cell_id, y, x FROM last, m WHERE habitat OR list_contains(planted, cell_id)),
hadj AS (SELECT a.config, a.seed, a.cell_id AS a, b.cell_id AS b FROM hab a JOIN hab b ON a.config = b.config AND a.seed = b.seed AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
hreach AS (SELECT config, seed, cell_id AS cell, cell_id AS start FROM hab UNION SELECT r.config, r.seed, b, r.start FROM hreach r JOIN hadj j ON j.config = r.config AND j.seed = r.seed AND j.a = r.cell),
hlab AS (SELECT config, seed, cell, min(start) AS patch FROM hreach GROUP BY ALL),
hcell AS (SELECT hlab.*, m.y, m.x FROM hlab JOIN m ON m.cell_id = cell),
harea AS (SELECT config, seed, patch, count(*) AS area FROM hlab GROUP BY ALL),
hedge AS (SELECT DISTINCT a.config, a.seed, a.patch AS a, b.patch AS b FROM hcell a JOIN hcell b ON a.config = b.config AND a.seed = b.seed AND a.patch <> b.patch
          AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 25),
hwalk AS (SELECT config, seed, patch AS src, patch AS dst, 0 AS hop FROM harea
          UNION SELECT w.config, w.seed, w.src, e.b, w.hop + 1 FROM hwalk w JOIN hedge e ON e.config = w.config AND e.seed = w.seed AND e.a = w.dst WHERE w.hop < 24),
hhop AS (SELECT config, seed, src, dst, min(hop) AS hop FROM hwalk GROUP BY ALL),
hsum AS (SELECT h.config, h.seed, h.hop, sum(p.area * q.area)::DOUBLE / (1 + h.hop) AS t FROM hhop h JOIN harea p ON p.config = h.config AND p.seed = h.seed AND p.patch = h.src
         JOIN harea q ON q.config = h.config AND q.seed = h.seed AND q.patch = h.dst GROUP BY h.config, h.seed, h.hop),
hiic AS (SELECT config, seed, sum(t ORDER BY hop) / power((SELECT count(*) FROM m WHERE habitat OR restorable), 2)::DOUBLE AS iic FROM hsum GROUP BY config, seed),
final AS (SELECT last.*, iic, n_patches, largest FROM last JOIN hiic USING (config, seed) JOIN (SELECT config, seed, count(*) AS n_patches, max(area) AS largest FROM harea GROUP BY ALL) USING (config, seed))
""",
    )


def _greedy_episodes(land: str, configs: str, steps: int, r: int) -> str:
    """Episodes of the policies, a block of tables for each step: last(ep, spent, steps, planted) and its graph.

    land: land(g, cell, y, x, habitat, restorable, code) of every grid; configs: ep0(ep, g, method, seed, budget, p1, p2). The distances between all patches are kept from step to step: a cell makes one patch of those beside it, and
    two others are then as far apart as before or as their ways to it together.
    """
    out = [
        land,
        f""",
adj AS MATERIALIZED (SELECT a.g, a.cell AS a, b.cell AS b FROM land a JOIN land b ON a.g = b.g AND abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE (a.habitat OR a.restorable) AND (b.habitat OR b.restorable)),
reach AS MATERIALIZED (SELECT a.g, a.cell AS a, b.cell AS b FROM land a JOIN land b ON a.g = b.g AND a.restorable AND a.cell <> b.cell AND (b.habitat OR b.restorable)
         AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= {r * r}),
grown AS (SELECT g, cell, cell AS seed FROM land WHERE habitat UNION SELECT r.g, adj.b, r.seed FROM grown r JOIN adj ON adj.g = r.g AND adj.a = r.cell JOIN land l ON l.g = r.g AND l.cell = adj.b AND l.habitat),
label AS MATERIALIZED (SELECT g, cell, min(seed) AS patch FROM grown GROUP BY g, cell),
lc AS MATERIALIZED (SELECT label.*, y, x FROM label JOIN land USING (g, cell)),
link AS MATERIALIZED (SELECT DISTINCT a.g, a.patch AS a, b.patch AS b FROM lc a JOIN lc b ON a.g = b.g AND a.patch <> b.patch AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= {r * r}),
walk(g, a, b, d) USING KEY (g, a, b) AS (SELECT DISTINCT g, patch, patch, 0 FROM label
      UNION SELECT DISTINCT w.g, w.a, l.b, w.d + 1 FROM walk w JOIN link l ON l.g = w.g AND l.a = w.b LEFT JOIN recurring.walk k ON k.g = w.g AND k.a = w.a AND k.b = l.b WHERE k.b IS NULL),
ep0 AS MATERIALIZED ({configs}),
full0 AS MATERIALIZED (SELECT g, power(count(*), 2)::DOUBLE AS area FROM land WHERE habitat OR restorable GROUP BY g),
e0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS spent, 0 AS steps, ''::VARCHAR AS planted FROM ep0),
h0 AS MATERIALIZED (SELECT ep, label.cell, patch FROM ep0 JOIN label USING (g)),
d0 AS MATERIALIZED (SELECT ep, a, b, d FROM ep0 JOIN walk USING (g))""",
    ]
    for k in range(steps):
        n = k + 1
        out.append(f""",
s{k} AS MATERIALIZED (SELECT ep, patch, count(*) AS size FROM h{k} GROUP BY ALL),
y{k} AS MATERIALIZED (SELECT d{k}.ep, d AS hop, sum(p.size * q.size) AS w FROM d{k} JOIN s{k} p ON p.ep = d{k}.ep AND p.patch = a JOIN s{k} q ON q.ep = d{k}.ep AND q.patch = b GROUP BY d{k}.ep, d),
i{k} AS MATERIALIZED (SELECT ep, sum(w::DOUBLE / (1 + hop) ORDER BY hop) AS s FROM y{k} GROUP BY ep),
c{k} AS MATERIALIZED (SELECT e.ep, e.method, l.cell AS c, CASE l.code WHEN 13 THEN p1 ELSE p2 END AS cost FROM e{k} e JOIN land l ON l.g = e.g AND l.restorable LEFT JOIN h{k} h ON h.ep = e.ep AND h.cell = l.cell
         WHERE h.cell IS NULL AND (CASE l.code WHEN 13 THEN p1 ELSE p2 END) <= e.budget - e.spent AND EXISTS (SELECT 1 FROM adj JOIN h{k} x ON x.ep = e.ep AND x.cell = adj.b WHERE adj.g = e.g AND adj.a = l.cell)),
b{k} AS MATERIALIZED (SELECT DISTINCT c.ep, c.c, h.patch FROM c{k} c JOIN e{k} e ON e.ep = c.ep JOIN adj ON adj.g = e.g AND adj.a = c.c JOIN h{k} h ON h.ep = c.ep AND h.cell = adj.b),
n{k} AS MATERIALIZED (SELECT DISTINCT c.ep, c.c, h.patch FROM c{k} c JOIN e{k} e ON e.ep = c.ep JOIN reach ON reach.g = e.g AND reach.a = c.c JOIN h{k} h ON h.ep = c.ep AND h.cell = reach.b),
k{k} AS MATERIALIZED (SELECT ep, c, kind, min(c) OVER (PARTITION BY ep, kind) AS one FROM (SELECT ep, c, string_agg(patch || CASE WHEN side THEN 'b' ELSE '' END, ' ' ORDER BY patch, side) AS kind
         FROM (SELECT ep, c, patch, true AS side FROM b{k} UNION ALL SELECT ep, c, patch, false FROM n{k}) GROUP BY ep, c)),
u{k} AS MATERIALIZED (SELECT v.ep, v.c, v.q, v.u FROM (SELECT n.ep, n.c, d.b AS q, min(d.d + CASE WHEN b.patch IS NULL THEN 1 ELSE 0 END) AS u FROM n{k} n JOIN k{k} k ON k.ep = n.ep AND k.c = n.c AND k.one = n.c
         JOIN d{k} d ON d.ep = n.ep AND d.a = n.patch LEFT JOIN b{k} b ON b.ep = n.ep AND b.c = n.c AND b.patch = n.patch GROUP BY n.ep, n.c, d.b) v
         LEFT JOIN b{k} b ON b.ep = v.ep AND b.c = v.c AND b.patch = v.q WHERE b.patch IS NULL),
a{k} AS MATERIALIZED (SELECT b.ep, b.c, 1 + sum(size) AS size FROM b{k} b JOIN s{k} s ON s.ep = b.ep AND s.patch = b.patch GROUP BY ALL),
x{k} AS MATERIALIZED (SELECT n.ep, n.c FROM n{k} n JOIN k{k} k ON k.ep = n.ep AND k.c = n.c AND k.one = n.c JOIN b{k} b ON b.ep = n.ep AND b.c = n.c LEFT JOIN d{k} d ON d.ep = n.ep AND d.a = b.patch AND d.b = n.patch WHERE d.d IS NULL OR d.d > 1
      UNION SELECT ep, c FROM b{k} GROUP BY ep, c HAVING count(*) > 1),
t{k} AS MATERIALIZED (
  SELECT a.ep, a.c, 0 AS hop, a.size * a.size AS w FROM a{k} a JOIN k{k} k ON k.ep = a.ep AND k.one = a.c AND k.c = a.c
  UNION ALL SELECT u.ep, u.c, u.u, 2 * a.size * s.size FROM u{k} u JOIN a{k} a ON a.ep = u.ep AND a.c = u.c JOIN s{k} s ON s.ep = u.ep AND s.patch = u.q
  UNION ALL SELECT k.ep, k.c, y.hop, y.w FROM k{k} k JOIN y{k} y ON y.ep = k.ep WHERE k.c = k.one
  UNION ALL SELECT b.ep, b.c, d.d, -CASE WHEN o.patch IS NULL THEN 2 ELSE 1 END * p.size * q.size FROM b{k} b JOIN k{k} k ON k.ep = b.ep AND k.c = b.c AND k.one = b.c JOIN d{k} d ON d.ep = b.ep AND d.a = b.patch
            JOIN s{k} p ON p.ep = d.ep AND p.patch = d.a JOIN s{k} q ON q.ep = d.ep AND q.patch = d.b LEFT JOIN b{k} o ON o.ep = b.ep AND o.c = b.c AND o.patch = d.b
  UNION ALL SELECT z.ep, z.c, h, z.w FROM (SELECT v.ep, v.c, v.u + w.u AS h, d.d, p.size * q.size AS w FROM x{k} JOIN u{k} v ON v.ep = x{k}.ep AND v.c = x{k}.c JOIN u{k} w ON w.ep = v.ep AND w.c = v.c AND w.q <> v.q
            JOIN s{k} p ON p.ep = v.ep AND p.patch = v.q JOIN s{k} q ON q.ep = v.ep AND q.patch = w.q LEFT JOIN d{k} d ON d.ep = v.ep AND d.a = v.q AND d.b = w.q WHERE d.d IS NULL OR v.u + w.u < d.d) z
  UNION ALL SELECT v.ep, v.c, d.d, -p.size * q.size FROM x{k} JOIN u{k} v ON v.ep = x{k}.ep AND v.c = x{k}.c JOIN u{k} w ON w.ep = v.ep AND w.c = v.c AND w.q <> v.q
            JOIN s{k} p ON p.ep = v.ep AND p.patch = v.q JOIN s{k} q ON q.ep = v.ep AND q.patch = w.q JOIN d{k} d ON d.ep = v.ep AND d.a = v.q AND d.b = w.q WHERE v.u + w.u < d.d),
g{k} AS MATERIALIZED (SELECT c.ep, c.c, c.cost, CASE c.method WHEN 'naive' THEN gain ELSE round(gain / c.cost, 12) END AS score
         FROM (SELECT v.ep, v.c, round(v.s / f.area - i.s / f.area, 12) AS gain FROM (SELECT ep, c, sum(t ORDER BY hop) AS s FROM (SELECT ep, c, hop, sum(w)::DOUBLE / (1 + hop) AS t FROM t{k} GROUP BY ep, c, hop) GROUP BY ep, c) v
               JOIN i{k} i ON i.ep = v.ep JOIN e{k} e ON e.ep = v.ep JOIN full0 f ON f.g = e.g) x JOIN k{k} k ON k.ep = x.ep AND k.one = x.c JOIN c{k} c ON c.ep = k.ep AND c.c = k.c),
m{k} AS MATERIALIZED (SELECT ep, a AS patch, min(b) AS comp FROM d{k} JOIN e{k} USING (ep) WHERE method = 'bridge' GROUP BY ep, a),
w{k}(ep, cell, d) USING KEY (ep, cell) AS (SELECT ep, cell, 0.0::DOUBLE FROM h{k} JOIN e{k} USING (ep) WHERE method = 'bridge'
      UNION SELECT ep, cell, min(d) FROM (SELECT w.ep, l.cell, w.d + CASE l.code WHEN 13 THEN p1 ELSE p2 END AS d, r.d AS old FROM w{k} w JOIN e{k} e ON e.ep = w.ep JOIN adj ON adj.g = e.g AND adj.a = w.cell
            JOIN land l ON l.g = e.g AND l.cell = adj.b AND l.restorable LEFT JOIN recurring.w{k} r ON r.ep = w.ep AND r.cell = l.cell) WHERE old IS NULL OR d < old GROUP BY ep, cell),
f{k} AS MATERIALIZED (SELECT ep, cell, pred FROM (SELECT v.ep, v.cell, u.cell AS pred, row_number() OVER (PARTITION BY v.ep, v.cell ORDER BY u.d, u.cell) AS o FROM w{k} v JOIN e{k} e ON e.ep = v.ep JOIN adj ON adj.g = e.g AND adj.a = v.cell
         JOIN w{k} u ON u.ep = v.ep AND u.cell = adj.b WHERE v.d > 0) WHERE o = 1),
o{k} AS (SELECT h.ep, h.cell, comp FROM h{k} h JOIN m{k} m ON m.ep = h.ep AND m.patch = h.patch UNION ALL SELECT f.ep, f.cell, o.comp FROM o{k} o JOIN f{k} f ON f.ep = o.ep AND f.pred = o.cell),
r{k} AS MATERIALIZED (SELECT ep, a, b FROM (SELECT e.ep, u.cell AS a, v.cell AS b, u.d + v.d AS cost, budget - spent AS rest, row_number() OVER (PARTITION BY e.ep ORDER BY u.d + v.d, u.cell, v.cell) AS o
         FROM e{k} e JOIN w{k} u ON u.ep = e.ep JOIN adj ON adj.g = e.g AND adj.a = u.cell JOIN w{k} v ON v.ep = e.ep AND v.cell = adj.b AND u.cell < v.cell
         JOIN o{k} x ON x.ep = e.ep AND x.cell = u.cell JOIN o{k} y ON y.ep = e.ep AND y.cell = v.cell AND x.comp <> y.comp) WHERE o = 1 AND cost <= rest),
q{k} AS (SELECT ep, a AS cell FROM r{k} UNION ALL SELECT ep, b FROM r{k} UNION ALL SELECT f.ep, f.pred FROM q{k} q JOIN f{k} f ON f.ep = q.ep AND f.cell = q.cell),
z{k} AS MATERIALIZED (SELECT DISTINCT q.ep, q.cell FROM q{k} q JOIN c{k} c ON c.ep = q.ep AND c.c = q.cell),
p{k} AS MATERIALIZED (SELECT x.ep, x.c, x.cost, k.one FROM (SELECT g.*, row_number() OVER (PARTITION BY g.ep ORDER BY CASE method WHEN 'random' THEN -((g.c * 7919 + steps * 104729 + seed * 15485863 + 12345) % 1000003) ELSE score END DESC, g.c) AS o
         FROM g{k} g JOIN e{k} e ON e.ep = g.ep WHERE g.ep NOT IN (SELECT ep FROM z{k}) OR EXISTS (SELECT 1 FROM z{k} z WHERE z.ep = g.ep AND z.cell = g.c)) x JOIN k{k} k ON k.ep = x.ep AND k.c = x.c WHERE o = 1),
e{n} AS MATERIALIZED (SELECT e.* REPLACE (e.spent + coalesce(p.cost, 0) AS spent, e.steps + CASE WHEN p.c IS NULL THEN 0 ELSE 1 END AS steps, CASE WHEN p.c IS NULL THEN planted ELSE trim(planted || ' ' || p.c) END AS planted) FROM e{k} e LEFT JOIN p{k} p USING (ep)),
h{n} AS MATERIALIZED (SELECT h.ep, h.cell, CASE WHEN b.patch IS NULL THEN h.patch ELSE p.c END AS patch FROM h{k} h LEFT JOIN p{k} p ON p.ep = h.ep LEFT JOIN b{k} b ON b.ep = h.ep AND b.c = p.c AND b.patch = h.patch UNION ALL SELECT ep, c, c FROM p{k}),
v{k} AS MATERIALIZED (SELECT p.ep, u.q, u.u FROM p{k} p JOIN u{k} u ON u.ep = p.ep AND u.c = p.one),
d{n} AS MATERIALIZED (SELECT ep, a, b, min(d) AS d FROM (
  SELECT d.ep, d.a, d.b, d.d FROM d{k} d LEFT JOIN p{k} p ON p.ep = d.ep LEFT JOIN b{k} x ON x.ep = d.ep AND x.c = p.c AND x.patch = d.a LEFT JOIN b{k} y ON y.ep = d.ep AND y.c = p.c AND y.patch = d.b WHERE x.patch IS NULL AND y.patch IS NULL
  UNION ALL SELECT v.ep, v.q, w.q, v.u + w.u FROM v{k} v JOIN v{k} w ON w.ep = v.ep AND w.q <> v.q
  UNION ALL SELECT v.ep, v.q, p.c, v.u FROM v{k} v JOIN p{k} p ON p.ep = v.ep UNION ALL SELECT v.ep, p.c, v.q, v.u FROM v{k} v JOIN p{k} p ON p.ep = v.ep UNION ALL SELECT ep, c, c, 0 FROM p{k}) GROUP BY ep, a, b)""")
    k = steps
    out.append(f""",
s{k} AS MATERIALIZED (SELECT ep, patch, count(*) AS size FROM h{k} GROUP BY ALL),
finals AS MATERIALIZED (SELECT ep, sum(t ORDER BY d) AS s FROM (SELECT d{k}.ep, d, sum(p.size * q.size)::DOUBLE / (1 + d) AS t FROM d{k} JOIN s{k} p ON p.ep = d{k}.ep AND p.patch = a JOIN s{k} q ON q.ep = d{k}.ep AND q.patch = b GROUP BY d{k}.ep, d) GROUP BY ep),
last AS (SELECT e.*, i0.s / f.area AS iic_initial, x.s / f.area AS iic_final, n_patches, largest FROM e{k} e JOIN full0 f USING (g) JOIN i0 ON i0.ep = e.ep JOIN finals x ON x.ep = e.ep
         JOIN (SELECT ep, count(*) AS n_patches, max(size) AS largest FROM s{k} GROUP BY ep) y ON y.ep = e.ep)
""")
    return _with(*out)


_LAND = """,
land AS MATERIALIZED (SELECT 0 AS g, cell_id AS cell, y, x, habitat, restorable, class_code AS code FROM m)
"""


# Windows of two fifths of the raster, at half the resolution, with patches, gaps and scores.
_WINDOWS = """,
size AS (SELECT h, w, h * 2 // 5 AS nh, w * 2 // 5 AS nw, greatest(1, h * 2 // 5 // 2) AS th, greatest(1, w * 2 // 5 // 2) AS tw FROM dim),
place AS (SELECT a * th AS y0, b * tw AS x0, nh, nw, th, tw FROM size, (SELECT unnest(range(1000)) AS a), (SELECT unnest(range(1000)) AS b)
          WHERE a * th + nh <= h AND b * tw + nw <= w),
wcount AS (SELECT y0, x0, ((y - y0 + 1) * th - 1) // nh AS y, ((x - x0 + 1) * tw - 1) // nw AS x, any_value(tw) AS tw, class_code, count(*) AS n
           FROM place JOIN cells ON y >= y0 AND y < y0 + nh AND x >= x0 AND x < x0 + nw GROUP BY 1, 2, 3, 4, class_code),
w AS (SELECT y0 || ',' || x0 AS win, y0, x0, y, x, y * tw + x AS cell, class_code AS code, class_code IN (5, 76) AS habitat, class_code IN (13, 21) AS restorable,
             class_code IN (31, 40, 33, 0) AS locked
      FROM (SELECT *, row_number() OVER (PARTITION BY y0, x0, y, x ORDER BY n DESC, class_code) AS k FROM wcount) WHERE k = 1),
beside AS (SELECT a.win, a.cell AS a, b.cell AS b, a.habitat AND b.habitat AS inside FROM w a JOIN w b ON a.win = b.win AND abs(a.y - b.y) + abs(a.x - b.x) = 1
           WHERE (a.habitat OR a.restorable) AND (b.habitat OR b.restorable)),
wreach AS (SELECT win, cell, cell AS seed FROM w WHERE habitat UNION SELECT r.win, b.b, r.seed FROM wreach r JOIN beside b ON b.win = r.win AND b.a = r.cell AND b.inside),
wlabel AS (SELECT win, cell, min(seed) AS patch FROM wreach GROUP BY 1, 2),
warea AS (SELECT win, patch, count(*) AS area FROM wlabel GROUP BY 1, 2),
wland AS (SELECT win, any_value(y0)::INT AS y0, any_value(x0)::INT AS x0, avg(habitat::INT)::DOUBLE AS fh, avg(restorable::INT)::DOUBLE AS fr, avg(locked::INT)::DOUBLE AS fl FROM w GROUP BY 1),
per AS (SELECT wland.*, coalesce(n, 0) AS n, most FROM wland LEFT JOIN (SELECT win, count(*) AS n, max(area) AS most FROM warea GROUP BY 1) USING (win)),
wlarge AS (SELECT win, patch, area FROM warea JOIN per USING (win) WHERE n >= 2 AND fh >= 0.02 AND fr >= 0.05 AND area >= greatest(2, 0.08 * most)),
wstep(win, src, cell, d) USING KEY (win, src, cell) AS (SELECT win, patch, cell, 0 FROM wlabel JOIN wlarge USING (win, patch)
      UNION SELECT DISTINCT s.win, s.src, b.b, s.d + 1 FROM wstep s JOIN beside b ON b.win = s.win AND b.a = s.cell
            LEFT JOIN recurring.wstep k ON k.win = s.win AND k.src = s.src AND k.cell = b.b WHERE k.cell IS NULL),
wgap AS (SELECT s.win, s.src AS lo, l.patch AS hi, min(s.d) AS steps FROM wstep s JOIN wlabel l ON l.win = s.win AND l.cell = s.cell AND s.src < l.patch GROUP BY 1, 2, 3),
wpair AS (SELECT g.*, (a.area * b.area)::DOUBLE AS prize, steps BETWEEN 2 AND 20 AS valid FROM wgap g JOIN wlarge a ON a.win = g.win AND a.patch = lo JOIN wlarge b ON b.win = g.win AND b.patch = hi),
wbest AS (SELECT win, steps, prize FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY prize DESC, lo, hi) AS k FROM wpair WHERE valid) WHERE k = 1),
wtop AS (SELECT win, patch FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY area DESC, patch) AS k FROM warea) WHERE k = 1),
wbait AS (SELECT b.win, count(DISTINCT b.b) AS bait FROM beside b JOIN wlabel l ON l.win = b.win AND l.cell = b.a JOIN wtop t ON t.win = l.win AND t.patch = l.patch
          JOIN w ON w.win = b.win AND w.cell = b.b AND w.restorable GROUP BY 1),
structure AS (
  SELECT 'part@' || win AS raster_id, n::INT AS n_patches, (SELECT count(*) FROM wlarge WHERE wlarge.win = per.win)::INT AS n_significant, round(fh, 9) AS frac_habitat,
         round(fr, 9) AS frac_restorable, round(fl, 9) AS frac_locked, coalesce(wbest.steps, (SELECT min(steps) FROM wpair WHERE wpair.win = per.win), -1)::INT AS gap,
         coalesce(prize, 0)::DOUBLE AS prize, (SELECT count(*) FROM wpair WHERE wpair.win = per.win AND valid)::INT AS n_valid_pairs,
         (CASE WHEN prize IS NULL THEN 0 ELSE coalesce(bait, 0) END)::INT AS bait,
         round(CASE WHEN prize IS NULL THEN -1 ELSE 0.4::DOUBLE * greatest(1 - abs(wbest.steps - 10.0::DOUBLE) / 20, 0)
               + 0.4::DOUBLE * least(prize / (most * most + 1e-9::DOUBLE), 1) + 0.2::DOUBLE * least(coalesce(bait, 0) / 20.0::DOUBLE, 1) END, 9)::DOUBLE AS score, y0, x0
  FROM per LEFT JOIN wbest USING (win) LEFT JOIN wbait USING (win))
"""


ORACLE_SQL: dict[str, str] = {
    "class_histogram": _with(_GRID) + "SELECT class_code, class_name, n_cells, percent FROM (" + _HIST.format(res="''", src="SELECT class_code FROM cells") + ")",
    "band_stats": _with(_GRID) + "SELECT min(v) AS minimum, max(v) AS maximum, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std_dev, round(100.0 * count(v) / count(*), 6)::DOUBLE AS valid_percent FROM (SELECT nullif(class_code, 0) AS v FROM cells)",
    "mask_counts": _with(_GRID) + "SELECT count(*) AS total_cells, count(*) FILTER (habitat) AS habitat_cells, count(*) FILTER (restorable) AS restorable_cells, count(*) FILTER (NOT habitat AND NOT restorable) AS locked_cells, count(*) FILTER (habitat OR restorable) AS landscape_area, greatest(max(cost), 1.0)::DOUBLE AS max_cost FROM m",
    "cost_map": _with(_GRID) + "SELECT cell_id, cost FROM m",
    "cost_violations": _with(_GRID) + "SELECT class_code, count(*) AS n_cells FROM m WHERE class_code IN (13, 21, 31, 40) AND cost <= 0 GROUP BY 1",
    "unknown_codes": _with(_GRID) + "SELECT class_code, count(*) AS n_cells FROM m WHERE class_code NOT IN (5, 76, 13, 21, 31, 40, 33, 0) GROUP BY 1",
    "nodata_normalise": "SELECT p_partkey AS cell_id, (CASE WHEN p_size = 47 THEN 0 ELSE p_size END)::INT AS class_code FROM part",
    "cell_index_roundtrip": _with(_GRID) + 'SELECT cell_id, y AS "row", x AS col, (y::BIGINT * w + x)::BIGINT AS back FROM cells, dim',
    "majority_resample": _with(_GRID) + _down("dim.h * 2 // 5", "dim.w * 2 // 5"),
    "majority_resample_up": _up(True),
    "majority_resample_sparse": _up(False),
    "resample_histogram": _with(_GRID)
    + " UNION ALL ".join(
        "SELECT * FROM (" + _HIST.format(res=res, src=src) + ")"
        for res, src in (
            ("(SELECT h || 'x' || w FROM dim)", "SELECT class_code FROM cells"),
            ("(SELECT (h // 2) || 'x' || (w // 2) FROM dim)", _down("dim.h // 2", "dim.w // 2")),
            ("(SELECT (h // 5) || 'x' || (w // 5) FROM dim)", _down("dim.h // 5", "dim.w // 5")),
        )
    ),
    "frontier_initial": _with(_GRID) + "SELECT cell_id FROM front",
    "action_mask": _with(_GRID) + "SELECT cell_id FROM front WHERE cost <= 1",
    "observation_planes": _with(_GRID) + "SELECT cell_id, habitat::INT::DOUBLE AS habitat, (cell_id IN (SELECT cell_id FROM front))::INT::DOUBLE AS open_frontier, cost / greatest(max(cost) OVER (), 1) AS cost_share, 0.75::DOUBLE AS budget_share FROM m",
    "distance_pairs": _with(_GRID) + "SELECT a.cell_id AS lo, b.cell_id AS hi FROM m a JOIN m b ON a.cell_id < b.cell_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 9 WHERE a.habitat AND b.habitat",
    "patch_labels": _with(_GRID, _PATCH) + "SELECT cell_id, patch_id FROM label",
    "patch_areas": _with(_GRID, _PATCH) + "SELECT patch_id, area FROM areas",
    "patch_stats": _with(_GRID, _PATCH) + "SELECT count(*) AS n_patches, coalesce(max(area), 0) AS largest_patch FROM areas",
    "patch_edges": _with(_GRID, _PATCH, _edges(5)) + "SELECT lo, hi FROM edges",
    "components": _with(_GRID, _PATCH, _edges(5), _HOP, _COMPONENT) + "SELECT patch_id, component_id FROM comp",
    "component_cells": _with(_GRID, _PATCH, _edges(5), _HOP, _COMPONENT) + "SELECT cell_id, component_id FROM label JOIN comp USING (patch_id)",
    "component_count": _with(_GRID, _PATCH, _edges(5), _HOP, _COMPONENT) + "SELECT count(DISTINCT component_id) AS n_components FROM comp",
    "hop_distances": _with(_GRID, _PATCH, _edges(5), _HOP) + "SELECT src, dst, hop FROM hops",
    "iic": _with(_GRID, _PATCH, _edges(5), _HOP) + f"SELECT round({_IIC}, 10) AS iic",
    "iic_by_dispersal": " UNION ALL ".join("SELECT * FROM (" + _with(_GRID, _PATCH, _edges(r), _HOP) + f"SELECT {r}::DOUBLE AS dispersal, round({_IIC}, 10) AS iic)" for r in (2.0, 3.0, 5.0)),
    "largest_patch": _with(_GRID, _PATCH) + "SELECT patch_id, area FROM areas ORDER BY area DESC, patch_id LIMIT 1",
    "bait_frontier": _with(_GRID, _PATCH) + "SELECT DISTINCT a.cell_id FROM m a JOIN lc b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE a.restorable AND b.patch_id = (SELECT patch_id FROM areas ORDER BY area DESC, patch_id LIMIT 1)",
    "gap_distances": _with(
        _GRID,
        _PATCH,
        """,
large AS (SELECT patch_id, area FROM areas WHERE area >= greatest(2, 0.08 * (SELECT max(area) FROM areas))),
near AS (SELECT a.cell_id AS a, b.cell_id AS b FROM m a JOIN m b ON abs(a.y - b.y) + abs(a.x - b.x) = 1
         WHERE (a.habitat OR a.restorable) AND (b.habitat OR b.restorable)),
step(src, cell, d) USING KEY (src, cell) AS (SELECT patch_id, cell_id, 0 FROM label JOIN large USING (patch_id)
         UNION SELECT DISTINCT s.src, near.b, s.d + 1 FROM step s JOIN near ON near.a = s.cell
               LEFT JOIN recurring.step k ON k.src = s.src AND k.cell = near.b WHERE k.cell IS NULL),
hit AS (SELECT src, patch_id AS dst, min(d) AS steps FROM step JOIN label ON label.cell_id = step.cell GROUP BY 1, 2)
""",
    )
    + "SELECT a.patch_id AS lo, b.patch_id AS hi, coalesce(steps, -1)::INT AS steps FROM large a JOIN large b ON a.patch_id < b.patch_id LEFT JOIN hit ON src = a.patch_id AND dst = b.patch_id",
    "raster_audit": _with(_GRID, _PATCH, _edges(5), _HOP, _COMPONENT)
    + f"""SELECT 'part' AS raster_id, max(y) + 1 AS height, max(x) + 1 AS width, count(*) AS total_cells, count(*) FILTER (habitat) AS habitat_cells,
  100.0::DOUBLE * count(*) FILTER (habitat) / count(*) AS habitat_percent, count(*) FILTER (restorable) AS restorable_cells,
  100.0::DOUBLE * count(*) FILTER (restorable) / count(*) AS restorable_percent, (SELECT count(*) FROM areas) AS n_patches,
  (SELECT coalesce(max(area), 0) FROM areas) AS largest_patch, (SELECT count(*) FROM front) AS frontier_cells,
  (SELECT count(DISTINCT component_id) FROM comp) AS n_components, 5.0::DOUBLE AS dispersal, 20 AS budget, round({_IIC}, 10) AS iic,
  coalesce(string_agg(DISTINCT CASE WHEN class_code = 35 THEN '35' END, ';'), '') AS unknown_codes, count(*) FILTER (class_code = 35) AS unknown_cells,
  CASE WHEN count(*) FILTER (class_code = 35) > 0 THEN 'REVIEW' ELSE 'OK' END AS status,
  CASE WHEN count(*) FILTER (class_code = 35) > 0 THEN 'unknown_class' ELSE '' END AS notes FROM m""",
    "window_scan": _with(
        _GRID,
        """,
size AS (SELECT h, w, h * 2 // 5 AS nh, w * 2 // 5 AS nw, greatest(1, h * 2 // 5 // 2) AS sy, greatest(1, w * 2 // 5 // 2) AS sx FROM dim),
win AS (SELECT a * sy AS y0, b * sx AS x0, nh, nw FROM size, (SELECT unnest(range(1000)) AS a), (SELECT unnest(range(1000)) AS b)
        WHERE a * sy + nh <= h AND b * sx + nw <= w)
""",
    )
    + "SELECT y0::INT AS y0, x0::INT AS x0, count(*) AS n_cells, count(*) FILTER (habitat) AS habitat_cells, count(*) FILTER (restorable) AS restorable_cells, count(*) FILTER (class_code IN (31, 40, 33, 0)) AS locked_cells FROM win JOIN m ON y >= y0 AND y < y0 + nh AND x >= x0 AND x < x0 + nw GROUP BY 1, 2",
    "window_structure": _with(_GRID, _WINDOWS) + "SELECT * EXCLUDE (y0, x0) FROM structure",
    "window_topk": _with(_GRID, _WINDOWS) + "SELECT *, row_number() OVER (ORDER BY score DESC, y0, x0)::INT AS rank FROM structure WHERE score >= 0 ORDER BY score DESC, y0, x0 LIMIT 5",
    "scenario_grid": "SELECT * FROM (VALUES ('1:1'), ('1:2'), ('1:3')) AS c(cost_scenario) CROSS JOIN (VALUES (10), (20), (30)) AS b(budget)",
    "scenario_cost_merge": f"SELECT cost_scenario, land_scenario, class_code, cost FROM {_SCENARIO_COSTS} CROSS JOIN {_LANDS} UNION ALL SELECT DISTINCT cost_scenario, 's2', c, 3 FROM {_SCENARIO_COSTS} CROSS JOIN (VALUES (31), (40)) AS x(c)",
    "run_slugs": f"SELECT cost_scenario, budget, land_scenario, rl_preset, 'maskableppo' || CASE land_scenario WHEN 'main' THEN '' ELSE '_land_' || land_scenario END || CASE rl_preset WHEN 'default' THEN '' ELSE '_preset_' || rl_preset END || '_cost_' || replace(cost_scenario, ':', '-') || '_budget' || budget || '_steps50000_seed0' AS run_name FROM (VALUES ('1:1'), ('1:2'), ('1:3')) AS c(cost_scenario) CROSS JOIN (VALUES (10), (20), (30)) AS b(budget) CROSS JOIN {_LANDS} CROSS JOIN (VALUES ('default'), ('s2-tuned')) AS p(rl_preset)",
    "episode_summary": _with(_FACTS, ", g AS (SELECT *, 0.0::DOUBLE AS iic_initial FROM f), s AS (SELECT resolution, method, " + _SUMMARY + " FROM g GROUP BY 1, 2) ") + "SELECT resolution, method, " + ", ".join(f"round({c}, 4) AS {c}" for c in _MEASURES) + " FROM s",
    "seed_summary": _with(_FACTS, ", g AS (SELECT *, 0.0::DOUBLE AS iic_initial FROM f), s AS (SELECT resolution, method, seed, " + _SUMMARY + " FROM g GROUP BY 1, 2, 3) ")
    + "SELECT resolution, method, "
    + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _MEASURES if c != "std_iic_gain")
    + ", round(stddev_samp(iic_gain), 4) AS std_iic_gain FROM s GROUP BY 1, 2",
    "results_upsert": _with(_FACTS) + "SELECT resolution, method, seed, o_orderkey, cents FROM (SELECT *, row_number() OVER (PARTITION BY resolution, method, seed ORDER BY o_orderkey % 2 DESC, o_orderkey DESC) AS k FROM f WHERE o_orderkey % 2 = 0 OR seed < 3) WHERE k = 1",
    "results_schema_evolution": _with(_FACTS) + "SELECT resolution, 'main' AS land_scenario, CASE WHEN method = 'bridge' THEN 'default' ELSE '' END AS rl_preset, 20 AS budget, 0 AS timesteps, seed::VARCHAR AS seeds, CASE WHEN method = 'bridge' THEN 'MaskablePPO' ELSE method END AS method, count(*) AS n_rows, sum(cents)::BIGINT AS gain FROM f GROUP BY ALL",
    "results_uniqueness": _with(_FACTS) + "SELECT resolution, method, seed, count(*) AS n_rows FROM f GROUP BY 1, 2, 3 HAVING count(*) <> 1",
    "planning_headroom": _with(
        _FACTS,
        """, g AS (SELECT resolution, seed, method, sum(cents)::DOUBLE / sum(cost) AS gain FROM f GROUP BY 1, 2, 3),
p AS (SELECT resolution, seed, max(gain) FILTER (method = 'naive') AS n, max(gain) FILTER (method = 'cost') AS c, max(gain) FILTER (method = 'bridge') AS b FROM g GROUP BY 1, 2),
q AS (SELECT *, greatest(n, c) AS best FROM p)
""",
    )
    + "SELECT resolution, seed, round(n, 4) AS gain_naive, round(c, 4) AS gain_cost, round(b, 4) AS gain_bridge, round(b - n, 4) AS vs_naive_absolute, round(100 * (b - n) / nullif(n, 0), 4) AS vs_naive_percent, round(b - c, 4) AS vs_cost_absolute, round(100 * (b - c) / nullif(c, 0), 4) AS vs_cost_percent, round(b - best, 4) AS vs_best_absolute, round(100 * (b - best) / nullif(best, 0), 4) AS vs_best_percent, round(greatest(0, 100 * (b - best) / nullif(best, 0)), 4) AS positive_headroom_percent FROM q",
    "step_rewards": _with(_STEPS, ", d AS (SELECT *, iic - coalesce(lag(iic) OVER w, 0) AS g, lead(step) OVER w IS NULL AS last FROM e WINDOW w AS (PARTITION BY episode ORDER BY step)) ")
    + "SELECT episode, step, round(CASE WHEN invalid THEN -0.05 ELSE g END, 4)::DOUBLE AS plain, round(100 * CASE WHEN invalid THEN -0.05 ELSE g / greatest(cost, 1e-9) END, 4)::DOUBLE AS per_cost, round(CASE WHEN invalid THEN 0 WHEN last THEN iic ELSE 0 END, 4)::DOUBLE AS at_end FROM d",
    "truncation_runs": _with(
        _STEPS,
        """, d AS (SELECT *, lag(action) OVER w AS a, lag(invalid) OVER w AS i FROM e WINDOW w AS (PARTITION BY episode ORDER BY step)),
r AS (SELECT *, sum(CASE WHEN invalid AND coalesce(i, false) AND action = a THEN 0 ELSE 1 END) OVER (PARTITION BY episode ORDER BY step) AS run FROM d)
""",
    )
    + "SELECT episode, min(step) AS first_step, count(*) AS length, count(*) >= 3 AS truncated FROM r WHERE invalid GROUP BY episode, run",
    "trailing_reward": _with(_STEPS) + "SELECT episode, step, round(avg(iic) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS trailing FROM e",
    "best_checkpoint": _with(_STEPS) + "SELECT episode, step, iic FROM (SELECT *, max(iic) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) WHERE top IS NULL OR iic > top",
    "training_progress": _with(_STEPS) + "SELECT episode, step, round(least(step / 40.0::DOUBLE, 1), 6) AS share, round(step / s, 6) AS steps_per_second, round(greatest(40 - step, 0) / (step / s), 4) AS seconds_left FROM (SELECT *, step * 0.5::DOUBLE + cost AS s FROM e) WHERE step % 8 = 0 OR step >= 40",
    "doc_word_counts": rf"SELECT doc_id, length(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'))::BIGINT AS n_words, length(t)::BIGINT AS n_chars FROM (SELECT doc_id, {_BODY} AS t FROM documents)",
    "doc_citations": rf"SELECT doc_id, length(regexp_extract_all(t, '\[\d+(?:\s*[-,]\s*\d+)*\]'))::BIGINT AS square, length(regexp_extract_all(t, '\([A-Z][^()]{{1,60}},\s*20\d{{2}}\)'))::BIGINT AS author_year FROM (SELECT doc_id, {_BODY} AS t FROM documents)",
    "doc_markers": _markers("documents", "doc_id", "text", ["contoh", "misalnya", "format baku", "universitas xyz", "azkia informasia", "deteksi sel kanker", "the", "license"]),
    "xml_markers": _markers("pages", "page_id", "html", ["w:instrText", "<w:ins", "<w:del", "<p"]),
    "doc_paragraphs": "SELECT doc_id, n AS paragraph, substr(trim(p), 1, 1000) AS body FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)) WHERE n >= 2 AND n < 6 AND trim(p) <> ''",
    "weighted_value_counts": "SELECT source, sum(n_chars)::BIGINT AS weight FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "doc_table_preview": "SELECT conv_id, k AS \"row\", substr(replace(coalesce(role, ''), chr(10), ' / '), 1, 250) || ' | ' || substr(replace(coalesce(text, ''), chr(10), ' / '), 1, 250) AS line FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 12",
    "step_totals": _with(_STEPS) + "SELECT episode, count(*) AS n_steps, count(*) FILTER (NOT invalid) AS n_planted, count(*) FILTER (invalid) AS n_invalid, coalesce(sum(cost) FILTER (NOT invalid), 0)::DOUBLE AS cost_used FROM e GROUP BY 1",
    "mask_sets": _with(_GRID) + "SELECT 'landscape' AS part, cell_id FROM m WHERE habitat OR restorable UNION ALL SELECT 'frontier', cell_id FROM front UNION ALL SELECT 'interior', cell_id FROM m WHERE restorable AND cell_id NOT IN (SELECT cell_id FROM front) UNION ALL SELECT 'locked', cell_id FROM m WHERE NOT habitat AND NOT restorable",
    "result_attributes": _with(_FACTS) + "SELECT CASE WHEN method = 'bridge' THEN 'MaskablePPO' ELSE method END AS method, sum(cents)::BIGINT AS gain, '48x96' AS resolution, 's2' AS land_scenario, '1:2' AS cost_scenario, 45 AS budget, CASE WHEN method = 'bridge' THEN 's2-tuned' ELSE '' END AS rl_preset, CASE WHEN method = 'bridge' THEN 50000 ELSE 0 END AS timesteps, CASE WHEN method = 'bridge' THEN '0-1-2' ELSE '' END AS seeds FROM f GROUP BY method",
    "bridge_routes_frames": _with(_GRID, _PATCH, _edges(2), _HOP, _COMPONENT, _BRIDGE) + "SELECT cost, a, b FROM bridge",
    "bridge_route": _with(_GRID, _PATCH, _edges(2), _HOP, _COMPONENT, _BRIDGE) + "SELECT cell_id FROM route",
    "bridge_first_action": _with(_GRID, _PATCH, _edges(2), _HOP, _COMPONENT, _BRIDGE, _GAIN)
    + "SELECT cell_id FROM cgain WHERE cell_id IN (SELECT cell_id FROM route) OR NOT EXISTS (SELECT * FROM route) ORDER BY round(gain / cost, 12) DESC, cell_id LIMIT 1",
    "random_rollout": _random_episodes("SELECT '1:2' AS config, 13 AS c1, 21 AS c2, 1.0::DOUBLE AS p1, 2.0::DOUBLE AS p2, 20.0::DOUBLE AS budget", 20)
    + "SELECT seed, spent AS cost, len(planted)::INT AS n_planted, greatest(steps, 1)::INT AS steps, 0::INT AS invalid, n_patches::INT AS n_patches, largest::INT AS largest_patch, round(iic, 10) AS iic_final, array_to_string(planted, ' ') AS plant_order FROM final",
    "scenario_random": _random_episodes("SELECT s || '|' || b AS config, 13 AS c1, 21 AS c2, 1.0::DOUBLE AS p1, p2::DOUBLE AS p2, b::DOUBLE AS budget FROM (VALUES ('1:1', 1), ('1:2', 2), ('1:3', 3)) AS t(s, p2), (VALUES (10), (20), (30)) AS u(b)", 20)
    + f"SELECT split_part(config, '|', 1) AS cost_scenario, split_part(config, '|', 2)::INT AS budget, 'Random Valid Action' AS method, round({_IIC}, 10) AS iic_initial, round(avg(iic), 10) AS iic_final, round(avg(iic - {_IIC}), 10) AS iic_gain, round(stddev_samp(iic - {_IIC}), 10) AS std_iic_gain, round(avg(spent), 6) AS cost_used, round(avg(len(planted)), 6)::DOUBLE AS cells_planted, round(avg(n_patches), 6)::DOUBLE AS n_patches, round(avg(largest), 6)::DOUBLE AS largest_patch, 0.0::DOUBLE AS invalid_action_rate FROM final GROUP BY config",
    "candidate_gains": _with(_GRID, _PATCH, _edges(2), _HOP, _GAIN) + "SELECT cell_id, round(gain, 10) AS gain, cost FROM cgain",
    "greedy_first_action": _with(_GRID, _PATCH, _edges(2), _HOP, _GAIN) + "SELECT cell_id, round(gain, 10) AS gain FROM cgain ORDER BY cgain.gain DESC, cell_id LIMIT 1",
    "greedy_cost_first_action": _with(_GRID, _PATCH, _edges(2), _HOP, _GAIN) + "SELECT cell_id, round(round(gain / cost, 12), 10) AS ratio FROM cgain ORDER BY round(gain / cost, 12) DESC, cell_id LIMIT 1",
}

_TRACE = "iic_initial, iic_final, 0::INT AS invalid, greatest(steps, 1)::INT AS steps, spent AS cost, {n}::INT AS n_planted, n_patches::INT AS n_patches, largest::INT AS largest_patch, {order} AS plant_order"


def _all_episodes(greedy: str, random: str, steps: int) -> str:
    """Episodes of all policies: config, method, seed and what an episode records."""
    mine = _greedy_episodes(_GRID + _LAND, greedy, steps, 5) + "SELECT split_part(ep, '/', 1) AS config, method, 0::INT AS seed, " + _TRACE.format(n="steps", order="planted") + " FROM last"
    drawn = _random_episodes(random, 20) + f"SELECT config, 'random' AS method, seed::INT AS seed, {_IIC} AS iic_initial, " + _TRACE.format(n="len(planted)", order="array_to_string(planted, ' ')").replace("iic_initial, iic_final", "iic AS iic_final") + " FROM final"
    return f"SELECT * FROM ({mine}) UNION ALL SELECT * FROM ({drawn})"


_ONE = _all_episodes(
    "SELECT '1:2/' || method AS ep, 0 AS g, method, 0 AS seed, 20.0::DOUBLE AS budget, 1.0::DOUBLE AS p1, 2.0::DOUBLE AS p2 FROM (VALUES ('naive'), ('cost'), ('bridge')) AS t(method)",
    "SELECT '1:2' AS config, 13 AS c1, 21 AS c2, 1.0::DOUBLE AS p1, 2.0::DOUBLE AS p2, 20.0::DOUBLE AS budget",
    20,
)
_EVERY = _all_episodes(
    "SELECT s || '|' || b || '/' || method AS ep, 0 AS g, method, 0 AS seed, b::DOUBLE AS budget, 1.0::DOUBLE AS p1, p2::DOUBLE AS p2 FROM (VALUES ('1:1', 1), ('1:2', 2), ('1:3', 3)) AS t(s, p2), (VALUES (10), (20), (30)) AS u(b), (VALUES ('naive'), ('cost'), ('bridge')) AS v(method)",
    "SELECT s || '|' || b AS config, 13 AS c1, 21 AS c2, 1.0::DOUBLE AS p1, p2::DOUBLE AS p2, b::DOUBLE AS budget FROM (VALUES ('1:1', 1), ('1:2', 2), ('1:3', 3)) AS t(s, p2), (VALUES (10), (20), (30)) AS u(b)",
    30,
)
_MEANS = ", ".join(f"round({x}, 10)::DOUBLE AS {n}" for x, n in (
    ("avg(iic_initial)", "iic_initial"), ("avg(iic_final)", "iic_final"), ("avg(iic_final - iic_initial)", "iic_gain"), ("stddev_samp(iic_final - iic_initial)", "std_iic_gain"), ("avg(cost)", "cost_used"),
    ("avg((iic_final - iic_initial) / nullif(cost, 0))", "iic_per_unit"), ("avg(n_planted)", "cells_planted"), ("avg(n_patches)", "n_patches"), ("avg(largest_patch)", "largest_patch"), ("avg(invalid / steps)", "invalid_action_rate"),
))
ORACLE_SQL["episode_rollout"] = f"SELECT 'part' AS raster_id, * REPLACE (round(iic_initial, 10) AS iic_initial, round(iic_final, 10) AS iic_final) FROM ({_ONE})"
ORACLE_SQL["policy_comparison"] = f"SELECT config, method, {_MEANS} FROM ({_ONE}) GROUP BY config, method"
ORACLE_SQL["scenario_results"] = f"""SELECT 'default' AS resolution, 'main' AS land_scenario, '' AS rl_preset, split_part(config, '|', 1) AS cost_scenario, split_part(config, '|', 2)::INT AS budget, 0 AS timesteps, '' AS seeds,
  CASE method WHEN 'random' THEN 'Random Valid Action' WHEN 'naive' THEN 'Greedy Naive' WHEN 'cost' THEN 'Greedy Cost' ELSE 'Bridge Planner' END AS method, 0.0::DOUBLE AS training_seconds, {_MEANS} FROM ({_EVERY}) GROUP BY config, method"""
ORACLE_SQL["candidate_check"] = (
    _greedy_episodes(
        _GRID + _WINDOWS + """,
best AS MATERIALIZED (SELECT raster_id, score, y0 || ',' || x0 AS win FROM structure WHERE score >= 0 ORDER BY score DESC, y0, x0 LIMIT 5),
land AS MATERIALIZED (SELECT raster_id AS g, w.cell, y, x, habitat, restorable, code FROM w JOIN best USING (win))
""",
        "SELECT raster_id || '/' || method || seed AS ep, raster_id AS g, method, seed, 20.0::DOUBLE AS budget, 1.0::DOUBLE AS p1, 2.0::DOUBLE AS p2 FROM best, (SELECT 'naive' AS method, 0 AS seed UNION ALL SELECT 'random', unnest(range(5)))",
        20,
        5,
    )
    + """, won AS (SELECT g AS raster_id, avg(iic_final - iic_initial) FILTER (method = 'random') AS gain_random, avg(iic_final - iic_initial) FILTER (method = 'naive') AS gain_greedy FROM last GROUP BY g)
SELECT raster_id, round(score, 9) AS score, round(gain_random, 10) AS gain_random, round(gain_greedy, 10) AS gain_greedy, round(gain_greedy - gain_random, 10) AS gap, gain_greedy - gain_random < 0.3 * greatest(gain_greedy, 1e-9) AS passed FROM won JOIN best USING (raster_id)"""
)
ORACLE_SQL["greedy_rollout"] = (
    _greedy_episodes(_GRID + _LAND, "SELECT method AS ep, 0 AS g, method, 0 AS seed, 20.0::DOUBLE AS budget, 1.0::DOUBLE AS p1, 2.0::DOUBLE AS p2 FROM (VALUES ('naive'), ('cost')) AS t(method)", 20, 5)
    + "SELECT method, spent AS cost, steps AS n_planted, greatest(steps, 1) AS steps, n_patches::INT AS n_patches, largest::INT AS largest_patch, round(iic_final, 10) AS iic_final, planted AS plant_order FROM last"
)

# Sources, sinks, streams and run settings: the same rows from the tables themselves.
ORACLE_SQL |= {
    "npy_roundtrip": _with(_GRID) + "SELECT cell_id, y, x, class_code FROM cells",
    "npy_rows": _with(_GRID) + "SELECT y, string_agg(class_code::VARCHAR, ' ' ORDER BY x) AS classes FROM cells GROUP BY y",
    "geotiff_roundtrip": _with(_GRID) + "SELECT cell_id, y, x, class_code FROM cells",
    "geotiff_metadata": _with(_GRID) + "SELECT 'part' AS raster_id, h::INT AS height, w::INT AS width, -9999.0::DOUBLE AS nodata, 'EPSG:32748' AS crs, 100.0::DOUBLE AS \"left\", -5.0::DOUBLE AS bottom, (100 + w)::DOUBLE AS \"right\", (h - 5)::DOUBLE AS top FROM dim",
    "results_csv_roundtrip": _with(_FACTS) + "SELECT resolution, method, seed::VARCHAR AS seeds, 's2' AS land_scenario, '' AS rl_preset, 20 AS budget, sum(cents)::DOUBLE AS iic_gain, sum(cost)::DOUBLE AS cost_used FROM f GROUP BY resolution, method, seed",
    "output_names": "SELECT land_scenario, with_resolution, 'results_' || CASE land_scenario WHEN 'main' THEN '' ELSE land_scenario || '_' END || CASE WHEN with_resolution THEN 'multires' ELSE 'scenario' END || '.csv' AS file_name FROM (VALUES ('main'), ('s2')) AS l(land_scenario) CROSS JOIN (VALUES (false), (true)) AS r(with_resolution)",
    "console_report": _with(
        _GRID,
        """,
line AS (SELECT 0 AS line, 'class_code' AS a, 'n_cells' AS b, 'percent' AS c UNION ALL
         SELECT row_number() OVER (ORDER BY class_code), class_code::VARCHAR, n::VARCHAR, round(100.0::DOUBLE * n / sum(n) OVER (), 2)::VARCHAR
         FROM (SELECT class_code, count(*) AS n FROM cells GROUP BY 1)),
wide AS (SELECT max(length(a))::INT AS wa, max(length(b))::INT AS wb FROM line)
""",
    )
    + "SELECT line::INT AS line, rpad(a, wa, ' ') || '  ' || rpad(b, wb, ' ') || '  ' || c AS text FROM line, wide",
    "docx_fonts": r"SELECT font, sum(n)::BIGINT AS weight FROM (SELECT CASE k % 3 WHEN 0 THEN 'Arial' WHEN 1 THEN '(style/default)' ELSE 'Courier' END AS font, length(regexp_replace(p, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS n FROM (SELECT unnest(ps) AS p, unnest(range(len(ps))) AS k FROM (SELECT string_split(coalesce(text, ''), chr(10)) AS ps FROM documents))) GROUP BY font",
    "block_growth": _with(
        _GRID,
        """,
anchor AS (SELECT cell_id, y, x, cost FROM front WHERE cost <= 3),
next AS (SELECT a.cell_id, arg_min(b.cell_id, CASE WHEN b.y < a.y THEN 0 WHEN b.y > a.y THEN 1 WHEN b.x < a.x THEN 2 ELSE 3 END) AS planted
         FROM anchor a JOIN m b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.restorable AND b.cost <= 3 - a.cost GROUP BY a.cell_id)
""",
    )
    + "SELECT cell_id, 0 AS nth, cell_id AS planted FROM anchor UNION ALL SELECT cell_id, 1, planted FROM next",
    "method_choices": """SELECT methods, learned, without_learned, land_scenario, rl_preset,
  CASE WHEN without_learned AND learned <> '' OR rl_preset = 's2-tuned' AND land_scenario <> 's2' THEN 'error'
       ELSE CASE WHEN methods <> '' THEN methods WHEN learned <> '' THEN '' ELSE 'random naive cost' END || '|' ||
            CASE WHEN without_learned THEN '' WHEN learned = 'both' OR learned = '' AND methods = '' THEN 'ppo mask' ELSE learned END END AS runs
  FROM (VALUES (''), ('random'), ('naive bridge')) AS a(methods) CROSS JOIN (VALUES (''), ('ppo'), ('mask'), ('both')) AS b(learned) CROSS JOIN (VALUES (false), (true)) AS c(without_learned)
  CROSS JOIN (VALUES ('main', 'default'), ('main', 's2-tuned'), ('s2', 's2-tuned')) AS d(land_scenario, rl_preset)""",
    "preset_values": "SELECT rl_preset, option, CASE WHEN rl_preset = 'default' THEN base ELSE coalesce(own, base) END AS value FROM (VALUES ('default'), ('s2-tuned')) AS p(rl_preset) CROSS JOIN (VALUES ('rate', '0.3', '0.1'), ('episodes', '60', NULL), ('entropy', '0.01', '0.003'), ('eval_every', '10', NULL), ('select_best', 'False', 'True'), ('reward_per_cost', 'False', 'True')) AS o(option, base, own)",
    "stream_windows": "SELECT user_id AS episode, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n_steps, count(*) FILTER (event_type = 'error') AS n_invalid, sum(round(value, 4)::DECIMAL(18, 4))::DOUBLE AS reward FROM events GROUP BY user_id, date_trunc('hour', ts)",
}
