"""Queries that write a table in a source's format to the shared folder, read it back, and return what was read; each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridbrook.operators import grid, nearest
from gridbrook.operators.tables import new_path
from gridbrook.plans.catalog import CELLS, SPEC, _add, _cells, _r, _t
from gridbrook.sources import datasets, files, netcdf

FLAT = grid.GridSpec(64, 48, xll=5.0, yll=40.0, cellsize=0.25)
DOWN = grid.GridSpec(64, 48, xll=5.0, yll=40.0, cellsize=0.25, top_down=True)
#: Days of lineitem by line number (a layer) and return flag as cells of a small grid.
STEPS = "s AS (SELECT l_shipdate::DATE::TIMESTAMP AS ts, (l_suppkey % 4 + 1)::INTEGER AS i, (l_partkey % 3 + 1)::INTEGER AS j, l_linenumber AS layer, sum(l_quantity) AS q, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2, 3, 4), a AS (SELECT ts, row_number() OVER (ORDER BY ts)::INTEGER AS t_idx, lag(ts) OVER (ORDER BY ts) AS lower FROM (SELECT DISTINCT ts FROM s))"


def _steps(spark, d):
    own = _t(spark, d, "lineitem").select(F.to_date("l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("i"), (F.col("l_partkey") % 3 + 1).cast("int").alias("j"), F.col("l_linenumber").alias("layer"), "l_quantity", "l_tax")
    return own.groupBy("ts", "i", "j", "layer").agg(F.sum("l_quantity").alias("q"), F.max("l_tax").alias("tax"))


_WRITTEN: dict = {}


def _dataset(spark, d, where: str = "true"):
    """Written once for each session and input; a window reads only its folders."""
    key = spark.sparkContext.applicationId, d, where
    if key not in _WRITTEN:
        _WRITTEN[key] = new_path(spark, "dataset")
        datasets.write(_steps(spark, d).where(where), _WRITTEN[key])
    return datasets.Dataset(spark, _WRITTEN[key])


def _file(spark, name: str) -> str:
    return f"{new_path(spark, 'files')}/{name}"


@_add("text_matrix", "SELECT k AS row, a, b FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS k, p_size::DOUBLE AS a, p_retailprice AS b FROM part)")
def _(spark, d):
    path = _file(spark, "matrix")
    files.write_text(_t(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("v")), "p_partkey", "v", path)
    return files.load_text(spark, path).select("row", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


@_add("text_shape", "SELECT count(*) AS n, 2 AS width FROM part")
def _(spark, d):
    path = _file(spark, "matrix")
    files.write_text(_t(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("v")), "p_partkey", "v", path)
    return spark.createDataFrame([files.shape(spark, path)], "n long, width int")


@_add("namelist", "SELECT 'run' AS grp, 4 AS count, 2.5::DOUBLE AS factor, true AS quiet, 'x y' AS name")
def _(spark, d):
    told = files.read_namelist("&run\n count = 4 ! comment\n factor = 2.5d0\n quiet = .true.\n name = 'x y'\n/\n")
    r = told["run"]
    return spark.createDataFrame([("run", r["count"], r["factor"], r["quiet"], r["name"])], "grp string, count int, factor double, quiet boolean, name string")


@_add("ascii_grid", f"WITH {CELLS} SELECT i, j, round(value, 3) AS value FROM cells")
def _(spark, d):
    lines = grid.unpack(_cells(spark, d).select("i", "j", _r(F.col("value"), 3).alias("value")), DOWN, missing=-9999.0)
    rows = lines.groupBy("j").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda c: c["value"].cast("decimal(18,3)").cast("string")), " ").alias("value"))
    head = spark.createDataFrame([(k - 10, x) for k, x in enumerate(["ncols 64", "nrows 48", "xllcorner 5.0", "yllcorner 40.0", "cellsize 0.25", "NODATA_value -9999.000"])], "j int, value string")
    path = _file(spark, "grid.asc")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("j").select("value").write.text(path)
    cells, spec = files.read_ascii_grid(spark, path)
    if spec != DOWN:
        raise ValueError("the header was not read back")
    return cells.select("i", "j", _r(F.col("value"), 3).alias("value"))


@_add("grid_dataset_read", f"WITH {STEPS} SELECT t_idx, s.ts, i, j, layer, q FROM s JOIN a USING (ts) WHERE ts = (SELECT min(ts) FROM s WHERE ts >= TIMESTAMP '1995-06-14 18:00:00')")
def _(spark, d):
    return _dataset(spark, d).read("1995-06-14 18:00:00").select("t_idx", "ts", "i", "j", "layer", "q")


@_add("grid_dataset_chunk", f"WITH {STEPS} SELECT t_idx, s.ts, lower, i, j, layer, q, tax FROM s JOIN a USING (ts) WHERE ts > TIMESTAMP '1995-06-01' AND ts <= TIMESTAMP '1995-07-01'")
def _(spark, d):
    return _dataset(spark, d).read_chunk("1995-06-01 00:00:00", "1995-07-01 00:00:00").select("t_idx", "ts", "lower", "i", "j", "layer", "q", "tax")


@_add("grid_dataset_chunk_by_ids", f"WITH {STEPS} SELECT t_idx, s.ts, i, j, layer, q FROM s JOIN a USING (ts) WHERE t_idx BETWEEN 100 AND 119")
def _(spark, d):
    return _dataset(spark, d).read_chunk_by_ids(100, 20).select("t_idx", "ts", "i", "j", "layer", "q")


@_add("grid_dataset_layer", f"WITH {STEPS} SELECT s.ts, i, j, q FROM s WHERE ts > TIMESTAMP '1995-06-01' AND ts <= TIMESTAMP '1995-07-01' AND layer = 2")
def _(spark, d):
    return _dataset(spark, d).read_layer(2, "1995-06-01 00:00:00", "1995-07-01 00:00:00").select("ts", "i", "j", "q")


@_add("grid_dataset_axis", f"WITH {STEPS} SELECT t_idx, lower, ts FROM a")
def _(spark, d):
    return _dataset(spark, d).time_axis().select("t_idx", "lower", "ts")


@_add("grid_dataset_times", f"WITH {STEPS} SELECT (SELECT t_idx FROM a WHERE ts >= TIMESTAMP '1995-06-15 10:00:00' ORDER BY ts LIMIT 1) AS t_idx, (SELECT count(*) FROM a WHERE ts > TIMESTAMP '1995-06-01' AND ts <= TIMESTAMP '1995-07-01') AS n, 'i int, j int, layer int, q double, tax double' AS meta, 4 AS place")
def _(spark, d):
    data = _dataset(spark, d)
    n = data.chunk_times("1995-06-01 00:00:00", "1995-07-01 00:00:00").count()
    meta = ", ".join(" ".join(x) for x in data.meta())
    return spark.createDataFrame([(data.time_index("1995-06-15 10:00:00"), n, meta, data.var_index("q"))], "t_idx int, n long, meta string, place int")


@_add("grid_dataset_packed", f"WITH {STEPS}, g AS (SELECT * FROM s WHERE layer = 1 AND ts = (SELECT min(ts) FROM s WHERE ts >= TIMESTAMP '1995-06-15' AND layer = 1)) SELECT 'packed' AS kind, row_number() OVER (ORDER BY j, i) AS place, q AS value FROM g UNION ALL SELECT 'matrix', (j - 1) * 4 + i, q FROM range(1, 5) x(i) CROSS JOIN range(1, 4) y(j) LEFT JOIN g USING (i, j)")
def _(spark, d):
    data, spec = _dataset(spark, d, where="layer = 1"), grid.GridSpec(4, 3)
    packed = data.read_packed("1995-06-15 00:00:00", spec, "q").select(F.lit("packed").alias("kind"), F.col("packed_id").alias("place"), "value")
    whole = data.read_packed("1995-06-15 00:00:00", spec, "q", packed=False).select(F.lit("matrix").alias("kind"), ((F.col("j") - 1) * 4 + F.col("i")).cast("long").alias("place"), "value")
    return packed.unionByName(whole)


@_add("output_steps", """WITH u AS (SELECT c_nationkey, c_custkey % 6 // 2 AS step, c_acctbal, c_custkey FROM customer)
SELECT (step + 1)::INTEGER AS t_idx, (TIMESTAMP '2001-01-01' + INTERVAL 1 DAY * (step + 1)::INTEGER)::TIMESTAMP AS ts, c_nationkey, round(avg(c_acctbal), 4) AS balance, sum(c_custkey)::BIGINT AS keys, trunc(avg(c_custkey))::BIGINT AS middle FROM u GROUP BY step, c_nationkey""")
def _(spark, d):
    rows = _t(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("keys"), F.col("c_custkey").alias("middle"))
    out = datasets.Output(spark, new_path(spark, "output"), ["c_nationkey"], {"balance": "mean", "keys": "sum", "middle": "mean"})
    for step in range(3):
        for part in (2 * step, 2 * step + 1):  # several updates a step
            out.update(rows.where(F.col("c_custkey") % 6 == part))
        out.write(f"2001-01-0{step + 2} 00:00:00")
    data = out.close()
    return data.read_chunk("2001-01-01 00:00:00", "2001-02-01 00:00:00").select("t_idx", "ts", "c_nationkey", _r(F.col("balance")).alias("balance"), "keys", "middle")


@_add("output_static", "SELECT n_nationkey, n_regionkey FROM nation")
def _(spark, d):
    path = new_path(spark, "output")
    out = datasets.Output(spark, path, ["n_nationkey"], {"n_regionkey": "sum"})
    out.write_static(_t(spark, d, "nation").select("n_nationkey", "n_regionkey"), "regions")
    return spark.read.parquet(f"{path}/static/regions")


SERIES = "p AS (SELECT l_suppkey % 20 AS point_id, l_shipdate::DATE::TIMESTAMP AS ts, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


def _series(spark, d):
    return _t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("point_id"), F.to_date("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.sum("l_quantity").alias("q"))


@_add("points_dataset_chunk", f"WITH {SERIES} SELECT point_id, ts, q FROM p WHERE ts > TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1996-02-01'")
def _(spark, d):
    path = new_path(spark, "points")
    datasets.write(_series(spark, d), path)
    return datasets.Dataset(spark, path).read_chunk("1996-01-01 00:00:00", "1996-02-01 00:00:00").select("point_id", "ts", "q")


@_add("points_dataset_series", f"WITH {SERIES} SELECT point_id, ts, q FROM p WHERE point_id IN (3, 7)")
def _(spark, d):
    path = new_path(spark, "points")
    datasets.write(_series(spark, d), path, by_key="point_id")
    return datasets.Dataset(spark, path).read_series("point_id", [3, 7]).select("point_id", "ts", "q")


@_add("points_ids", f"WITH {SERIES} SELECT DISTINCT point_id FROM p")
def _(spark, d):
    path = new_path(spark, "points")
    datasets.write(_series(spark, d), path, by_key="point_id")
    return datasets.Dataset(spark, path).ids("point_id")


@_add("point_places", "SELECT c_nationkey AS point_id, k AS place FROM (SELECT DISTINCT c_nationkey FROM customer) LEFT JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey)::INTEGER AS k FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = c_nationkey")
def _(spark, d):
    points = _t(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("point_id"))
    return datasets.id_places(points, _t(spark, d, "customer").select(F.col("c_nationkey").alias("point_id")).distinct())


@_add("restart", f"WITH {CELLS} SELECT i, j, round(value, 6) AS value, klass, 5 + i * 0.25 - 0.125 AS x FROM cells")
def _(spark, d):
    path = new_path(spark, "restart")
    datasets.to_restart(_cells(spark, d), SPEC, path)
    cells, spec = datasets.from_restart(spark, path)
    return cells.select("i", "j", _r(F.col("value"), 6).alias("value"), "klass", spec.x().alias("x"))


def _netcdf(spark, d) -> str:
    path = _file(spark, "grid.nc")
    netcdf.grid_to_netcdf(_cells(spark, d).select("i", "j", "value", F.col("klass").cast("double").alias("klass")), FLAT, path, ["value", "klass"], attributes={"title": "prices"})
    return path


@_add("netcdf_grid", f"WITH {CELLS} SELECT i, j, round(value, 6) AS value, 5 + i * 0.25 - 0.125 AS x, 40 + j * 0.25 - 0.125 AS y FROM cells")
def _(spark, d):
    cells, spec = netcdf.grid_from_netcdf(spark, _netcdf(spark, d), "value")
    return cells.select("i", "j", _r(F.col("value"), 6).alias("value"), spec.x().alias("x"), spec.y().alias("y"))


@_add("netcdf_slab", f"WITH {CELLS} SELECT i, j, round(value, 6) AS value FROM cells WHERE j BETWEEN 10 AND 19")
def _(spark, d):
    rows = netcdf.load(spark, _netcdf(spark, d), "value").where("y >= 10 and y < 20")
    return rows.select(F.col("x").alias("i"), F.col("y").alias("j"), _r(F.col("value"), 6).alias("value"))


@_add("netcdf_hyperslab", f"WITH {CELLS} SELECT a::INTEGER AS i, b::INTEGER AS j, round(coalesce(value, -9999), 6) AS value FROM range(5, 25, 2) s(a) CROSS JOIN range(3, 18, 3) t(b) LEFT JOIN cells ON i = a AND j = b")
def _(spark, d):
    path = _netcdf(spark, d)
    slab = netcdf.read_slab(path, netcdf.read_header(path), "value", [2, 4], [5, 10], [3, 2])
    rows = [(5 + 2 * int(k), 3 + 3 * int(r), round(float(v), 6)) for (r, k), v in np.ndenumerate(slab)]
    return spark.createDataFrame(rows, "i int, j int, value double")


@_add("netcdf_header", "SELECT * FROM (VALUES ('x', 'x', 'x', 'm', 'prices'), ('y', 'y', 'y', 'm', 'prices'), ('value', 'y,x', NULL, NULL, 'prices'), ('klass', 'y,x', NULL, NULL, 'prices')) t(name, dims, axis, units, title)")
def _(spark, d):
    head = netcdf.read_header(_netcdf(spark, d))
    rows = [(v.name, ",".join(v.dims), netcdf.axis_of(v), v.cf_attributes().get("units"), head.attributes["title"]) for v in head.variables.values()]
    return spark.createDataFrame(rows, "name string, dims string, axis string, units string, title string")


@_add("netcdf_fill_value", f"WITH {CELLS} SELECT 64 * 48 - count(*) AS missing, -9999.0::DOUBLE AS fill, count(*) AS known FROM cells")
def _(spark, d):
    path = _netcdf(spark, d)
    head = netcdf.read_header(path)
    v, whole = head.variables["value"], netcdf.read_whole(path, head, "value")
    return netcdf.load(spark, path, "value").agg(F.lit(int((whole == v.fill_value()).sum())).cast("long").alias("missing"), F.lit(float(v.fill_value())).alias("fill"), F.count(F.lit(1)).alias("known"))


@_add("netcdf_aux", "SELECT i::INTEGER AS i, j::INTEGER AS j, 10 + i * 0.5 AS lon, 40 + j * 0.25 AS lat FROM range(1, 65) s(i), range(1, 49) t(j)")
def _(spark, d):
    path = _file(spark, "aux.nc")
    cells = grid.full_index(spark, FLAT).select("i", "j", (10 + F.col("i") * 0.5).alias("lon"), (40 + F.col("j") * 0.25).alias("lat"))
    netcdf.grid_to_netcdf(cells, FLAT, path, ["lon", "lat"])
    return netcdf.aux_from_netcdf(spark, path)


@_add("netcdf_points", "SELECT s_suppkey AS point_id, s_nationkey * 1.5 AS x, s_acctbal AS y FROM supplier")
def _(spark, d):
    path = _file(spark, "points.nc")
    netcdf.points_to_netcdf(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_nationkey") * 1.5).alias("x"), F.col("s_acctbal").alias("y")), path)
    return netcdf.points_from_netcdf(spark, path)


@_add("netcdf_regridded", f"""WITH {CELLS}, c AS (SELECT (j - 1) * 64 + i AS id, 5 + i * 0.25 - 0.125 AS x, 40 + j * 0.25 - 0.125 AS y, value FROM cells), p AS (SELECT s_suppkey AS id, 5.01 + s_suppkey % 97 / 6.1 AS x, 40.02 + s_suppkey % 89 / 7.6 AS y FROM supplier)
SELECT point_id, round(value, 6) AS value FROM (SELECT p.id AS point_id, c.value, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.id) AS k FROM p, c) WHERE k = 1""")
def _(spark, d):
    cells, spec = netcdf.grid_from_netcdf(spark, _netcdf(spark, d), "value")
    k = F.col("s_suppkey")
    points = _t(spark, d, "supplier").select(k.alias("point_id"), (5.01 + k % 97 / 6.1).alias("x"), (40.02 + k % 89 / 7.6).alias("y"))
    return nearest.grid_to_points(cells, spec, points).select("point_id", _r(F.col("value"), 6).alias("value"))
