"""Queries of grid geometry, derived grids, coordinates, regridding and graphs, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridbrook.functions import keyed
from gridbrook.operators import graph, grid, nearest
from gridbrook.plans.catalog import CELLS, FACTOR, NET, POLYGON, SPEC, _add, _cells, _network, _r, _t

FLAT = replace(SPEC, spherical=False)
#: Points out of customer: on the grid's extent, cell borders included.
POINTS = "p AS (SELECT c_custkey AS id, 5 + (c_custkey % 640) / 40.0 AS x, 40 + (c_custkey % 480) / 40.0 AS y FROM customer)"


def _points(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (5 + F.col("c_custkey") % 640 / 40.0).alias("x"), (40 + F.col("c_custkey") % 480 / 40.0).alias("y"))


@_add("cell_bounds", f"WITH {CELLS} SELECT i, j, 5 + (i - 1) * 0.25 AS west, 5 + i * 0.25 AS east, 40 + (j - 1) * 0.25 AS south, 40 + j * 0.25 AS north FROM cells")
def _(spark, d):
    return _cells(spark, d).select("i", "j", SPEC.bounds().alias("b")).select("i", "j", "b.*")


@_add("longitudes", "SELECT c_custkey, ((((x - 13 + 180) % 360) + 360) % 360) - 180 + 13 AS near FROM (SELECT c_custkey, c_custkey % 1440 - 720.5 AS x FROM customer)")
def _(spark, d):
    return _t(spark, d, "customer").select("c_custkey", SPEC.normalized_longitude(F.col("c_custkey") % 1440 - 720.5).alias("near"))


@_add("in_cell", f"WITH {POINTS} SELECT id, x >= 5 + (id % 64) * 0.25 - 1e-4 AND x <= 5.25 + (id % 64) * 0.25 + 1e-4 AND y >= 40 + (id // 7 % 48) * 0.25 - 1e-4 AND y <= 40.25 + (id // 7 % 48) * 0.25 + 1e-4 AS inside FROM p")
def _(spark, d):
    p = _points(spark, d).withColumn("i", F.col("id") % 64 + 1).withColumn("j", F.floor(F.col("id") / 7) % 48 + 1)
    return p.select("id", FLAT.contains(F.col("x"), F.col("y")).alias("inside"))


@_add("cell_of_point", f"""WITH {CELLS}, {POINTS}, k AS (SELECT i, j, row_number() OVER (ORDER BY j, i) AS packed_id FROM cells),
q AS (SELECT id, least(64, greatest(1, ceil((x - 5) / 0.25))) AS i, least(48, greatest(1, ceil((y - 40) / 0.25))) AS j FROM p)
SELECT id, packed_id FROM q LEFT JOIN k USING (i, j)""")
def _(spark, d):
    return grid.cells_at(_points(spark, d), _cells(spark, d), FLAT).select("id", "packed_id")


@_add("in_quad", """SELECT s_suppkey, 10 * y - x >= 0 AND -2 * (y - 1) - 5 * (x - 10) >= 0 AND -7 * (y - 6) + (x - 8) >= 0 AND -1 * (y - 5) + 5 * (x - 1) >= 0 AS inside
FROM (SELECT s_suppkey, s_suppkey % 11 AS x, s_suppkey % 7 AS y FROM supplier)""")
def _(spark, d):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    p = F.struct((F.col("s_suppkey") % 11).cast("double").alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("y"))
    return _t(spark, d, "supplier").select("s_suppkey", grid.in_quad(p, corner(0, 0), corner(10, 1), corner(8, 6), corner(1, 5)).alias("inside"))


@_add("line_crossing", "SELECT s_suppkey, round(3 / (m + 0.5), 6) AS x, round(3 * m / (m + 0.5), 6) AS y FROM (SELECT s_suppkey, s_suppkey % 5 + 1.0 AS m FROM supplier)")
def _(spark, d):
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    m = F.col("s_suppkey") % 5 + 1
    at = grid.crossing(corner(F.lit(0), F.lit(0)), corner(F.lit(1), m), corner(F.lit(0), F.lit(3)), corner(F.lit(2), F.lit(2)))
    return _t(spark, d, "supplier").select("s_suppkey", at.alias("a")).select("s_suppkey", _r(F.col("a.x"), 6).alias("x"), _r(F.col("a.y"), 6).alias("y"))


@_add("grid_predicates", f"""WITH {CELLS} SELECT count(*) < 64 * 48 AS has_mask, count(*) FILTER (value IS NULL) > 0 AS any_missing, true AS same_mask, false AS same_as_part, true AS covered, false AS covered_by_part, true AS filled, false AS periodic FROM cells""")
def _(spark, d):
    cells = _cells(spark, d)
    coarse, spec = grid.derive_coarse(cells, SPEC, FACTOR)
    coarse = coarse.select(F.col("i").alias("ci"), F.col("j").alias("cj"))

    def holds(check, *args):
        try:
            check(*args)
        except ValueError:
            return False
        return True

    row = (
        grid.has_mask(cells, SPEC), grid.any_missing(cells), grid.same_mask(cells, cells), grid.same_mask(cells, cells.where("i > 5")), holds(grid.check_covered, cells, SPEC, coarse, spec),
        holds(grid.check_covered, cells, SPEC, coarse.where("ci > 2"), spec), holds(grid.check_filled, cells, SPEC, coarse, spec), SPEC.periodic,
    )
    return spark.createDataFrame([row], "has_mask boolean, any_missing boolean, same_mask boolean, same_as_part boolean, covered boolean, covered_by_part boolean, filled boolean, periodic boolean")


@_add("flip", f"WITH {CELLS} SELECT i, (49 - j)::INTEGER AS j, round(value, 6) AS value, 40 + j * 0.25 - 0.125 AS y FROM cells")
def _(spark, d):
    cells, spec = grid.flip(_cells(spark, d), SPEC)
    return cells.select("i", "j", _r(F.col("value"), 6).alias("value"), spec.y().alias("y"))


@_add("swap", f"WITH {CELLS} SELECT CASE i WHEN 3 THEN 7 WHEN 7 THEN 3 ELSE i END AS i, j, round(value, 6) AS value FROM cells")
def _(spark, d):
    return grid.swap(_cells(spark, d), "i", 3, 7).select("i", "j", _r(F.col("value"), 6).alias("value"))


@_add("crop", f"WITH {CELLS} SELECT (i - 12)::INTEGER AS i, (j - 8)::INTEGER AS j, round(value, 6) AS value, 5 + i * 0.25 - 0.125 AS x, 40 + j * 0.25 - 0.125 AS y FROM cells WHERE 5 + i * 0.25 - 0.125 BETWEEN 8 AND 15 AND 40 + j * 0.25 - 0.125 BETWEEN 42 AND 48")
def _(spark, d):
    cells, spec = grid.crop(_cells(spark, d), SPEC, 8, 15, 42, 48)
    return cells.select("i", "j", _r(F.col("value"), 6).alias("value"), spec.x().alias("x"), spec.y().alias("y"))


@_add("crop_points", f"WITH {POINTS} SELECT id FROM p WHERE x BETWEEN 8 AND 15 AND y BETWEEN 42 AND 48")
def _(spark, d):
    return grid.crop_points(_points(spark, d), 8, 15, 42, 48).select("id")


AREA = "6371228.0 * 6371228.0 * radians(0.25) * 2 * sin(radians(0.25) / 2) * cos(radians(40 + j * 0.25 - 0.125))"


@_add("total_area", f"WITH {CELLS} SELECT round(sum({AREA}) / 1e9, 4) AS area FROM cells")
def _(spark, d):
    return grid.total_area(_cells(spark, d), SPEC).select(_r(F.col("area") / 1e9).alias("area"))


@_add("derive_coarse", f"WITH {CELLS} SELECT ci::INTEGER AS i, cj::INTEGER AS j, round(sum({AREA}) / 1e6, 4) AS area, count(*) AS n FROM f GROUP BY ci, cj")
def _(spark, d):
    return grid.derive_coarse(_cells(spark, d), SPEC, FACTOR)[0].select("i", "j", _r(F.col("cell_area") / 1e6).alias("area"), "n")


@_add("derive_fine", f"WITH {CELLS} SELECT ((i - 1) * 2 + a)::INTEGER AS i, ((j - 1) * 2 + b)::INTEGER AS j, 5 + ((i - 1) * 2 + a) * 0.125 - 0.0625 AS x FROM cells, range(1, 3) s(a), range(1, 3) t(b)")
def _(spark, d):
    cells, spec = grid.derive_fine(_cells(spark, d), SPEC, 2)
    return cells.select("i", "j", spec.x().alias("x"))


@_add("upscale_coords", f"WITH {CELLS} SELECT ci::INTEGER AS ci, cj::INTEGER AS cj, round(avg(10 + i * 0.5 + j * 0.1), 6) AS lon, round(avg(40 + j * 0.2), 6) AS lat FROM f GROUP BY ci, cj")
def _(spark, d):
    cells = _cells(spark, d).select("i", "j", (10 + F.col("i") * 0.5 + F.col("j") * 0.1).alias("lon"), (40 + F.col("j") * 0.2).alias("lat"))
    return grid.upscale_coords(cells, SPEC, FACTOR).select("ci", "cj", _r(F.col("lon"), 6).alias("lon"), _r(F.col("lat"), 6).alias("lat"))


def _coords(spark):
    return grid.full_index(spark, FLAT).select("i", "j", (10 + F.col("i") * 0.5).alias("lon"), (40 + F.col("j") * 0.2).alias("lat"))


@_add("corner_coords", "SELECT a::INTEGER AS a, b::INTEGER AS b, round(10 + (a - 0.5) * 0.5, 6) AS lon, round(40 + (b - 0.5) * 0.2, 6) AS lat FROM range(1, 66) s(a), range(1, 50) t(b)")
def _(spark, d):
    return grid.corner_coords(_coords(spark), FLAT).select("a", "b", _r(F.col("lon"), 6).alias("lon"), _r(F.col("lat"), 6).alias("lat"))


@_add("downscale_coords", "SELECT i::INTEGER AS i, j::INTEGER AS j, round(10 + ((i - 0.5) / 4 + 0.5) * 0.5, 6) AS lon, round(40 + ((j - 0.5) / 4 + 0.5) * 0.2, 6) AS lat FROM range(1, 257) s(i), range(1, 193) t(j)")
def _(spark, d):
    return grid.downscale_coords(_coords(spark), FLAT, 4).select("i", "j", _r(F.col("lon"), 6).alias("lon"), _r(F.col("lat"), 6).alias("lat"))


@_add("cell_fraction", f"WITH {CELLS} SELECT round(sum(CASE WHEN klass = 2 THEN w ELSE 0 END) / sum(w), 6) AS value FROM f WHERE ci = 3 AND cj = 2")
def _(spark, d):
    return grid.cell_fraction(_cells(spark, d), SPEC, FACTOR, 3, 2, 2, value="klass").select(_r(F.col("value"), 6).alias("value"))


@_add("up_factor_one", f"WITH {CELLS} SELECT i AS ci, j AS cj, round(value, 6) AS mean, 0.0::DOUBLE AS spread, CASE WHEN klass = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS share, ((j - 1) * 64 + i)::BIGINT AS place FROM cells")
def _(spark, d):
    cells = _cells(spark, d)
    one = lambda op, to, **k: grid.upscale(cells, SPEC, 1, op, **k).withColumnRenamed("value", to)
    out = one("a_mean", "mean").join(one("var", "spread"), ["ci", "cj"]).join(one("fraction", "share", value="klass", class_id=2), ["ci", "cj"]).join(one("maxloc", "place"), ["ci", "cj"])
    return out.withColumn("mean", _r(F.col("mean"), 6))


@_add("connected_mask_at", f"""WITH RECURSIVE {CELLS}, k AS (SELECT i, j FROM cells WHERE (i + j) % 11 <> 0),
seed AS (SELECT i, j FROM k ORDER BY 6371228.0 * acos(least(1.0, sin(radians(40 + j * 0.25 - 0.125)) * sin(radians(44.23)) + cos(radians(40 + j * 0.25 - 0.125)) * cos(radians(44.23)) * cos(radians(9.31 - (5 + i * 0.25 - 0.125))))), (j - 1) * 64 + i LIMIT 1),
r AS (SELECT i, j FROM seed UNION SELECT b.i, b.j FROM r a JOIN k b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1) SELECT i, j FROM r""")
def _(spark, d):
    return grid.connected_mask_at(_cells(spark, d).where("(i + j) % 11 <> 0").select("i", "j"), SPEC, 9.31, 44.23)


@_add("fill_ids", f"""WITH {CELLS}, k AS (SELECT i, j, row_number() OVER (ORDER BY j, i) AS source_id FROM cells),
b AS (SELECT a.i, a.j FROM cells a LEFT JOIN cells b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY a.i, a.j HAVING count(b.i) < 8),
t AS (SELECT (x % 64 + 1)::INTEGER AS i, (x // 64 + 1)::INTEGER AS j FROM range(64 * 48) r(x)),
n AS (SELECT t.i, t.j, k.source_id, row_number() OVER (PARTITION BY t.i, t.j ORDER BY (t.i - b.i) * (t.i - b.i) + (t.j - b.j) * (t.j - b.j), k.source_id) AS r FROM t CROSS JOIN b JOIN k ON k.i = b.i AND k.j = b.j)
SELECT t.i, t.j, coalesce(k.source_id, n.source_id) AS source_id FROM t LEFT JOIN k USING (i, j) JOIN n ON n.i = t.i AND n.j = t.j AND n.r = 1""")
def _(spark, d):
    return nearest.fill_ids(_cells(spark, d), grid.full_index(spark, SPEC), SPEC, index_distance=True)


TARGET = grid.GridSpec(22, 16, xll=5.0317, yll=40.0711, cellsize=0.7013)
CENTRES = "c AS (SELECT i, j, (j - 1) * 64 + i AS id, 5 + i * 0.25 - 0.125 AS x, 40 + j * 0.25 - 0.125 AS y, value FROM cells), t AS (SELECT (k % 22 + 1)::INTEGER AS i, (k // 22 + 1)::INTEGER AS j, 5.0317 + (k % 22 + 1) * 0.7013 - 0.35065 AS x, 40.0711 + (k // 22 + 1) * 0.7013 - 0.35065 AS y FROM range(22 * 16) r(k))"


@_add("regrid_nearest", f"""WITH {CELLS}, {CENTRES} SELECT i, j, round(value, 6) AS value FROM (SELECT t.i, t.j, c.value, row_number() OVER (PARTITION BY t.i, t.j ORDER BY (t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y), c.id) AS k FROM t, c) WHERE k = 1""")
def _(spark, d):
    return nearest.regrid(_cells(spark, d), FLAT, grid.full_index(spark, TARGET), TARGET).select("i", "j", _r(F.col("value"), 6).alias("value"))


@_add("regrid_derived_mask", f"""WITH {CELLS}, {CENTRES} SELECT t.i, t.j, round(c.value, 6) AS value FROM t JOIN c ON c.i = ceil((t.x - 5) / 0.25) AND c.j = ceil((t.y - 40) / 0.25)""")
def _(spark, d):
    return nearest.regrid(_cells(spark, d), FLAT, grid.full_index(spark, TARGET), TARGET, derive_mask=True).select("i", "j", _r(F.col("value"), 6).alias("value"))


ODD_POINTS = "p AS (SELECT c_custkey AS id, 5 + (c_custkey * 37 % 1601) / 100.03 AS x, 40 + (c_custkey * 53 % 1201) / 100.07 AS y, c_acctbal AS v FROM customer)"


def _odd_points(spark, d):
    c = F.col("c_custkey")
    return _t(spark, d, "customer").select(c.alias("point_id"), (5 + c * 37 % 1601 / 100.03).alias("x"), (40 + c * 53 % 1201 / 100.07).alias("y"), F.col("c_acctbal").alias("value"))


@_add("points_in_polygon", f"""WITH {ODD_POINTS} SELECT id FROM p WHERE (18 - 6) * (y - 41) - (43 - 41) * (x - 6) >= 0 AND (20 - 18) * (y - 43) - (50 - 43) * (x - 18) >= 0
  AND (9 - 20) * (y - 50) - (51 - 50) * (x - 20) >= 0 AND (6 - 9) * (y - 51) - (41 - 51) * (x - 9) >= 0""")
def _(spark, d):
    return grid.points_in_polygon(_odd_points(spark, d), POLYGON).select(F.col("point_id").alias("id"))


@_add("grid_to_points", f"""WITH {CELLS}, {CENTRES}, {ODD_POINTS} SELECT point_id, round(value, 6) AS value FROM (SELECT p.id AS point_id, c.value, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.id) AS k FROM p, c) WHERE k = 1""")
def _(spark, d):
    return nearest.grid_to_points(_cells(spark, d), FLAT, _odd_points(spark, d)).select("point_id", _r(F.col("value"), 6).alias("value"))


@_add("points_to_grid", f"""WITH {CELLS}, {CENTRES}, {ODD_POINTS} SELECT i, j, value FROM (SELECT c.i, c.j, p.v AS value, row_number() OVER (PARTITION BY c.i, c.j ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), p.id) AS k FROM c, p) WHERE k = 1""")
def _(spark, d):
    return nearest.points_to_grid(_odd_points(spark, d), _cells(spark, d), FLAT)


@_add("nearest_by_cells", f"""WITH {ODD_POINTS} SELECT target_id, source_id FROM (SELECT a.id AS target_id, b.id AS source_id, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS k FROM p a, p b WHERE a.id % 3 = 0 AND b.id % 3 <> 0) WHERE k = 1""")
def _(spark, d):
    p = _odd_points(spark, d)
    return nearest.nearest(p.where("point_id % 3 = 0").withColumnRenamed("point_id", "target_id"), p.where("point_id % 3 <> 0").withColumnRenamed("point_id", "source_id"), ["x", "y"], most=0).select("target_id", "source_id")


# graphs

@_add("graph_degrees", f"WITH {NET} SELECT n.id, (SELECT count(*) FROM e WHERE e.dst = n.id) AS n_sources, (SELECT count(*) FROM e WHERE e.src = n.id) AS n_targets FROM n")
def _(spark, d):
    return graph.degrees(*_network(spark, d))


@_add("graph_branching", f"WITH {NET} SELECT dst AS id, list_sort(list(src))::VARCHAR AS sources FROM e GROUP BY dst")
def _(spark, d):
    down = _network(spark, d)[0].select("id", F.floor(F.col("id") / 2).alias("down"))
    return graph.upstream_lists(graph.from_down(down)).select("id", F.concat(F.lit("["), F.array_join(F.col("sources").cast("array<string>"), ", "), F.lit("]")).alias("sources"))


@_add("graph_neighbours", f"WITH {NET} SELECT 's' AS kind, dst AS id, src AS other FROM e WHERE dst % 5 = 0 UNION ALL SELECT 't', src, dst FROM e WHERE src % 5 = 0")
def _(spark, d):
    nodes, edges = _network(spark, d)
    ids = nodes.where("id % 5 = 0")
    return graph.sources(edges, ids).select(F.lit("s").alias("kind"), "id", F.col("source").alias("other")).unionByName(graph.targets(edges, ids).select(F.lit("t").alias("kind"), "id", F.col("target").alias("other")))


@_add("graph_adjacency", f"WITH {NET}, k AS (SELECT id, row_number() OVER (ORDER BY id)::INTEGER AS k FROM n) SELECT b.k AS \"row\", a.k AS \"column\" FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst")
def _(spark, d):
    return graph.adjacency(*_network(spark, d))


LEVELS = f"WITH RECURSIVE {NET}, r AS (SELECT id, 1 AS level FROM n WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id), l AS (SELECT id, max(level) AS level FROM r GROUP BY id)"


@_add("graph_levels_from_roots", f"WITH RECURSIVE {NET}, r AS (SELECT id, 1 AS level FROM n WHERE id NOT IN (SELECT src FROM e) UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.id) SELECT id, max(level)::INTEGER AS level FROM r GROUP BY id")
def _(spark, d):
    return graph.levels(*_network(spark, d), from_roots=True)


@_add("graph_levels_by_rounds", f"{LEVELS} SELECT id, level::INTEGER AS level FROM l")
def _(spark, d):
    return graph.levels(*_network(spark, d), task_edges=0)


@_add("graph_order_reversed", f"{LEVELS} SELECT id, ((SELECT max(level) FROM l) + 1 - level)::INTEGER AS level FROM l")
def _(spark, d):
    return graph.order(*_network(spark, d), reverse=True)


@_add("graph_sorted", f"{LEVELS} SELECT row_number() OVER (ORDER BY level, id) AS place, id FROM l")
def _(spark, d):
    return graph.sorted_order(graph.order(*_network(spark, d)))


@_add("graph_traverse", f"WITH RECURSIVE {NET}, r AS (SELECT 5::BIGINT AS id UNION SELECT e.src FROM r JOIN e ON e.dst = r.id WHERE r.id % 7 <> 0) SELECT id FROM r")
def _(spark, d):
    found = graph.traverse(_network(spark, d)[1], [5], lambda node: graph.SKIP_CHILDREN if node % 7 == 0 else graph.CONTINUE)
    return spark.createDataFrame([(n,) for n in found], "id long")


@_add("graph_components", f"WITH {NET}, c AS (SELECT src AS a, dst AS b FROM e WHERE src % 3 <> 0), v AS (SELECT a AS node FROM c UNION SELECT b FROM c) SELECT node, (SELECT min(x.node) FROM v x WHERE x.node IN (SELECT unnest(up) FROM (SELECT list(y) AS up FROM (WITH RECURSIVE u AS (SELECT v.node AS y UNION SELECT c.b FROM u JOIN c ON c.a = u.y) SELECT y FROM u)))) AS component FROM v")
def _(spark, d):
    edges = _network(spark, d)[1].where("src % 3 <> 0").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graph.components(edges)


@_add("keyed_lookup", "SELECT c_custkey, coalesce(n_name, 'none') AS name, n_name IS NOT NULL AS known FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON n_nationkey = c_nationkey")
def _(spark, d):
    table = _t(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    rows = keyed.lookup(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), table, "c_nationkey", "name", "none")
    return keyed.has(rows, table, "c_nationkey", "known").select("c_custkey", "name", "known")
