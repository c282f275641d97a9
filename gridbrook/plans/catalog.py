"""Registry of the engine's queries over the test tables, each with the SQL that it is held against where SQL can express it."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbrook.functions import scalars as sc
from gridbrook.functions import statistics as st
from gridbrook.operators import graph, grid, nearest, sequence, timeaxis

QUERIES: dict = {}
ORACLE: dict = {}
SPEC = grid.GridSpec(64, 48, xll=5.0, yll=40.0, cellsize=0.25, spherical=True)
FACTOR = 4
POLYGON = [(6.0, 41.0), (18.0, 43.0), (20.0, 50.0), (9.0, 51.0)]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _r(c, digits: int = 4):
    return F.round(c, digits)


def _cells(spark, d):
    """A masked grid out of lineitem: prices by part and supplier."""
    own = _t(spark, d, "lineitem").select((F.col("l_partkey") % 64 + 1).cast("int").alias("i"), (F.col("l_suppkey") % 48 + 1).cast("int").alias("j"), "l_extendedprice", "l_quantity")
    return own.where("(i * 7 + j * 3) % 5 <> 0").groupBy("i", "j").agg((F.sum("l_extendedprice") / 7.0).alias("value"), (F.sum("l_quantity").cast("long") % 5).cast("int").alias("klass"))


CELLS = """cells AS (
  SELECT i, j, sum(l_extendedprice) / 7.0 AS value, (sum(l_quantity)::BIGINT % 5)::INTEGER AS klass FROM (
    SELECT (l_partkey % 64 + 1)::INTEGER AS i, (l_suppkey % 48 + 1)::INTEGER AS j, l_extendedprice, l_quantity FROM lineitem
  ) WHERE (i * 7 + j * 3) % 5 <> 0 GROUP BY i, j
), f AS (
  SELECT *, (i - 1) // 4 + 1 AS ci, (j - 1) // 4 + 1 AS cj, cos(radians(40.0 + j * 0.25 - 0.125)) AS w, (j - 1) * 64 + i AS id, max(klass) OVER (PARTITION BY (i - 1) // 4, (j - 1) // 4) AS top FROM cells
)"""


def _up(name: str, sql: str, cast: str = "double", column: str = "value", **options):
    kind = "INTEGER" if cast == "int" else "BIGINT" if cast == "long" else "DOUBLE"
    text = f"WITH {CELLS} SELECT ci::INTEGER AS ci, cj::INTEGER AS cj, {f'round({sql}, 6)' if cast == 'double' else sql}::{kind} AS value FROM f GROUP BY ci, cj"

    @_add(name, text)
    def run(spark, d):
        out = grid.upscale(_cells(spark, d), SPEC, FACTOR, value=column, **options)
        return out.select("ci", "cj", (_r(F.col("value"), 6) if cast == "double" else F.col("value").cast(cast)).alias("value"))


_up("up_a_mean", "sum(w * value) / sum(w)", op="a_mean")
_up("up_p_mean", "sqrt(sum(w * value * value) / sum(w))", op="p_mean", p=2.0)
_up("up_g_mean", "exp(sum(w * ln(value)) / sum(w))", op="g_mean")
_up("up_h_mean", "sum(w) / sum(w / value)", op="h_mean")
_up("up_min", "min(value)", op="min")
_up("up_max", "max(value)", op="max")
_up("up_sum", "sum(value)", op="sum")
_up("up_var_count", "var_pop(value)", op="var", weight="count")
_up("up_std_count", "stddev_pop(value)", op="std", weight="count")
_up("up_median", "median(value)", op="median")
_up("up_fraction", "sum(CASE WHEN klass = 2 THEN w ELSE 0 END) / sum(w)", op="fraction", column="klass", class_id=2)
_up("up_a_mean_whole", "sum(w * klass) / sum(w)", op="a_mean", column="klass")
_up("up_maxloc_first", "min(CASE WHEN klass = top THEN id END)", cast="long", op="maxloc", column="klass")
_up("up_maxloc_last", "max(CASE WHEN klass = top THEN id END)", cast="long", op="maxloc", column="klass", back=True)
_up("up_maxloc", "arg_max(id, value)", cast="long", op="maxloc")
_up("up_minloc", "arg_min(id, value)", cast="long", op="minloc")

ORACLE["up_var_area"] = f"""WITH {CELLS}, m AS (SELECT ci, cj, sum(w * value) / sum(w) AS m FROM f GROUP BY ci, cj)
SELECT ci::INTEGER AS ci, cj::INTEGER AS cj, round(sum(w * (value - m) * (value - m)) / sum(w), 2) AS value FROM f JOIN m USING (ci, cj) GROUP BY ci, cj"""


@_add("up_var_area")
def _(spark, d):
    return grid.upscale(_cells(spark, d), SPEC, FACTOR, op="var").select("ci", "cj", _r(F.col("value"), 2).alias("value"))


@_add("up_laf", f"""WITH {CELLS}, n AS (SELECT ci, cj, klass, count(*) AS n FROM f GROUP BY ci, cj, klass)
SELECT ci::INTEGER AS ci, cj::INTEGER AS cj, klass AS value FROM (SELECT *, row_number() OVER (PARTITION BY ci, cj ORDER BY n DESC, klass) AS k FROM n) WHERE k = 1""")
def _(spark, d):
    return grid.upscale(_cells(spark, d), SPEC, FACTOR, op="laf", value="klass")


COARSE = "coarse AS (SELECT ci, cj, sum(value) AS value, count(*) AS n FROM f WHERE (ci + cj) % 3 <> 0 GROUP BY ci, cj)"


def _coarse(spark, d):
    return grid.upscale(_cells(spark, d), SPEC, FACTOR, op="sum").where("(ci + cj) % 3 <> 0")


@_add("down_nearest", f"WITH {CELLS}, {COARSE} SELECT i, j, round(c.value, 4) AS value FROM f JOIN coarse c USING (ci, cj)")
def _(spark, d):
    return grid.downscale(_cells(spark, d), SPEC, FACTOR, _coarse(spark, d)).select("i", "j", _r(F.col("value")).alias("value"))


@_add("down_split", f"WITH {CELLS}, {COARSE} SELECT i, j, round(c.value / c.n, 4) AS value FROM f JOIN coarse c USING (ci, cj)")
def _(spark, d):
    return grid.downscale(_cells(spark, d), SPEC, FACTOR, _coarse(spark, d), "split").select("i", "j", _r(F.col("value")).alias("value"))


@_add("up_empty_zero", f"""WITH {CELLS} SELECT ci::INTEGER AS ci, cj::INTEGER AS cj, round(coalesce(sum(CASE WHEN i % 8 < 4 THEN value END), 0), 4) AS value FROM f GROUP BY ci, cj""")
def _(spark, d):
    cells = _cells(spark, d)
    active = grid.upscale(cells, SPEC, FACTOR, op="max")
    return grid.with_empty(grid.upscale(cells.where("i % 8 < 4"), SPEC, FACTOR, op="sum"), active).select("ci", "cj", _r(F.col("value")).alias("value"))


@_add("uncovered_mask", f"WITH {CELLS}, {COARSE} SELECT i, j FROM f WHERE NOT EXISTS (SELECT 1 FROM coarse c WHERE c.ci = f.ci AND c.cj = f.cj)")
def _(spark, d):
    return grid.uncovered(_cells(spark, d), SPEC, FACTOR, _coarse(spark, d))


@_add("unfilled_mask", f"""WITH {CELLS}, g AS (SELECT * FROM f WHERE i % 8 < 4) SELECT DISTINCT ci::INTEGER AS ci, cj::INTEGER AS cj FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.ci = f.ci AND g.cj = f.cj)""")
def _(spark, d):
    cells = _cells(spark, d)
    return grid.unfilled(cells.where("i % 8 < 4"), SPEC, FACTOR, grid.upscale(cells, SPEC, FACTOR, op="max"))


@_add("border_mask", f"""WITH {CELLS} SELECT a.i, a.j FROM cells a LEFT JOIN cells b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY a.i, a.j HAVING count(b.i) < 8""")
def _(spark, d):
    return grid.border_mask(_cells(spark, d), SPEC)


@_add("select_box", f"WITH {CELLS} SELECT i, j, round(value, 6) AS value FROM cells WHERE 5 + i * 0.25 - 0.125 BETWEEN 8 AND 15 AND 40 + j * 0.25 - 0.125 BETWEEN 42 AND 48")
def _(spark, d):
    return grid.select_box(_cells(spark, d), SPEC, 8, 15, 42, 48).select("i", "j", _r(F.col("value"), 6).alias("value"))


@_add("polygon_mask", f"""WITH {CELLS}, p AS (SELECT i, j, 5 + i * 0.25 - 0.125 AS x, 40 + j * 0.25 - 0.125 AS y FROM cells)
SELECT i, j FROM p WHERE (18 - 6) * (y - 41) - (43 - 41) * (x - 6) >= 0 AND (20 - 18) * (y - 43) - (50 - 43) * (x - 18) >= 0
  AND (9 - 20) * (y - 50) - (51 - 50) * (x - 20) >= 0 AND (6 - 9) * (y - 51) - (41 - 51) * (x - 9) >= 0""")
def _(spark, d):
    return grid.polygon_mask(_cells(spark, d), SPEC, POLYGON).select("i", "j")


@_add("connected_mask", f"""WITH RECURSIVE {CELLS}, k AS (SELECT i, j FROM cells WHERE (i + j) % 11 <> 0),
r AS (SELECT i, j FROM k WHERE i = 1 AND j = 1 UNION SELECT b.i, b.j FROM r a JOIN k b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1) SELECT i, j FROM r""")
def _(spark, d):
    return grid.connected_mask(_cells(spark, d).where("(i + j) % 11 <> 0").select("i", "j"), 1, 1)


@_add("pack_ids", f"WITH {CELLS} SELECT i, j, row_number() OVER (ORDER BY j, i) AS packed_id FROM cells")
def _(spark, d):
    return grid.pack_ids(_cells(spark, d)).select("i", "j", "packed_id")


@_add("unpack", f"""WITH {CELLS} SELECT (k % 64 + 1)::INTEGER AS i, (k // 64 + 1)::INTEGER AS j, round(coalesce(value, -9999), 6) AS value FROM range(64 * 48) t(k) LEFT JOIN cells c ON c.i = k % 64 + 1 AND c.j = k // 64 + 1""")
def _(spark, d):
    return grid.unpack(_cells(spark, d), SPEC, missing=-9999.0).select("i", "j", _r(F.col("value"), 6).alias("value"))


@_add("cell_area", f"""WITH {CELLS} SELECT i, j, round(6371228.0 * 6371228.0 * radians(0.25) * 2 * sin(radians(0.25) / 2) * cos(radians(40 + j * 0.25 - 0.125)) / 1e6, 4) AS area FROM cells""")
def _(spark, d):
    return _cells(spark, d).select("i", "j", _r(SPEC.area() / 1e6).alias("area"))


@_add("fill_missing", f"""WITH {CELLS}, b AS (SELECT * FROM cells WHERE klass <> 0),
p AS (SELECT a.i, a.j, b.value, row_number() OVER (PARTITION BY a.i, a.j ORDER BY (a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j), b.j, b.i) AS k FROM cells a, b)
SELECT i, j, round(value, 6) AS value FROM p WHERE k = 1""")
def _(spark, d):
    cells = _cells(spark, d)
    return nearest.fill_missing(cells, cells.where("klass <> 0").select("i", "j", "value")).select("i", "j", _r(F.col("value"), 6).alias("value"))


@_add("nearest_points", """WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT target_id, source_id FROM (SELECT a.id AS target_id, b.id AS source_id, row_number() OVER (PARTITION BY a.id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.id) AS k
FROM p a, p b WHERE a.id % 2 = 0 AND b.id % 2 = 1) WHERE k = 1""")
def _(spark, d):
    p = _t(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return nearest.nearest(p.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "target_id"), p.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "source_id"), list("xyz")).select("target_id", "source_id")


@_add("great_circle", """SELECT c_custkey, round(6371228.0 * acos(least(1.0, sin(radians(c_nationkey * 3.0)) * sin(radians(10.0)) + cos(radians(c_nationkey * 3.0)) * cos(radians(10.0)) * cos(radians(20.0 - c_custkey % 360)))), 2) AS metres FROM customer""")
def _(spark, d):
    return _t(spark, d, "customer").select("c_custkey", _r(nearest.great_circle(F.col("c_custkey") % 360, F.col("c_nationkey") * 3.0, F.lit(20.0), F.lit(10.0)), 2).alias("metres"))


# statistics

def _items(spark, d):
    return _t(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 1000 + F.col("l_tax") * 1e4).alias("y"))


ITEMS = "t AS (SELECT l_returnflag, l_extendedprice AS x, l_quantity * 1000 + l_tax * 1e4 AS y FROM lineitem), m AS (SELECT l_returnflag, avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, stddev_samp(y) AS sy, count(*) AS n FROM t GROUP BY 1)"


@_add("moments", f"""WITH {ITEMS} SELECT l_returnflag, round(any_value(mx), 4) AS average, round(any_value(sx * sx) / 1e4, 2) AS variance, round(any_value(sx), 4) AS stddev,
round(sum(power((x - mx) / sx, 3)) / any_value(n), 6) AS skewness, round(sum(power((x - mx) / sx, 4)) / any_value(n) - 3, 6) AS kurtosis FROM t JOIN m USING (l_returnflag) GROUP BY 1""")
def _(spark, d):
    x = F.col("x")
    return _items(spark, d).groupBy("l_returnflag").agg(_r(F.avg(x)).alias("average"), _r(st.variance(x) / 1e4, 2).alias("variance"), _r(F.stddev_samp(x)).alias("stddev"), _r(st.skewness(x), 6).alias("skewness"), _r(st.kurtosis(x), 6).alias("kurtosis"))


@_add("absdev", f"WITH {ITEMS} SELECT l_returnflag, round(avg(abs(x - mx)), 4) AS absdev FROM t JOIN m USING (l_returnflag) GROUP BY 1")
def _(spark, d):
    return st.absdev(_items(spark, d), ["l_returnflag"], "x").select("l_returnflag", _r(F.col("absdev")).alias("absdev"))


@_add("central_moments", f"WITH {ITEMS} SELECT l_returnflag, round(avg(power((x - mx) / 1e4, 2)), 6) AS m2, round(avg(power((x - mx) / 1e4, 3)), 6) AS m3, round(avg(power((x - mx) / 1e4, 4)), 6) AS m4 FROM t JOIN m USING (l_returnflag) GROUP BY 1")
def _(spark, d):
    rows = _items(spark, d).withColumn("x", F.col("x") / 1e4)
    return st.central_moments(rows, ["l_returnflag"], "x", [2, 3, 4]).select("l_returnflag", *(_r(F.col(f"m{k}"), 6).alias(f"m{k}") for k in (2, 3, 4)))


@_add("mixed_moment", f"WITH {ITEMS} SELECT l_returnflag, round(avg(power((x - mx) / 1e4, 2) * ((y - my) / 1e4)), 6) AS value FROM t JOIN m USING (l_returnflag) GROUP BY 1")
def _(spark, d):
    rows = _items(spark, d).select("l_returnflag", (F.col("x") / 1e4).alias("x"), (F.col("y") / 1e4).alias("y"))
    return st.mixed_moment(rows, ["l_returnflag"], "x", "y", 2, 1).select("l_returnflag", _r(F.col("value"), 6).alias("value"))


@_add("covariance_correlation", f"WITH {ITEMS} SELECT l_returnflag, round(avg((x - mx) * (y - my)) / 1e6, 4) AS covariance, round(avg((x - mx) * (y - my)) / any_value(sx * sy), 8) AS correlation FROM t JOIN m USING (l_returnflag) GROUP BY 1")
def _(spark, d):
    x, y = F.col("x"), F.col("y")
    return _items(spark, d).groupBy("l_returnflag").agg(_r(st.covariance(x, y) / 1e6).alias("covariance"), _r(st.correlation(x, y), 8).alias("correlation"))


SKILL = {"bias": st.bias, "mae": st.mae, "rmse": st.rmse, "nse": st.nse, "lnnse": st.lnnse, "kge": st.kge, "kge_no_correlation": st.kge_no_correlation, "kge_prime": st.kge_prime, "agreement": st.categorical_agreement}


@_add("skill", f"""WITH {ITEMS}, s AS (
  SELECT l_returnflag, any_value(mx) mx, any_value(my) my, any_value(sx) sx, any_value(sy) sy, corr(x, y) r, avg(abs(y - x)) mae, sqrt(avg((y - x) * (y - x))) rmse,
  1 - sum((y - x) * (y - x)) / sum((x - mx) * (x - mx)) nse, avg(CASE WHEN x = y THEN 1.0 ELSE 0 END) agreement FROM t JOIN m USING (l_returnflag) GROUP BY 1
), lm AS (SELECT l_returnflag, avg(ln(x)) AS lx FROM t WHERE x > 0 AND y > 0 GROUP BY 1),
l AS (SELECT l_returnflag, 1 - sum(power(ln(y) - ln(x), 2)) / sum(power(ln(x) - lx, 2)) AS lnnse FROM t JOIN lm USING (l_returnflag) WHERE x > 0 AND y > 0 GROUP BY 1)
SELECT l_returnflag, round(my - mx, 4) AS bias, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(nse, 6) AS nse, round(lnnse, 6) AS lnnse,
round(1 - sqrt(power(1 - my / mx, 2) + power(1 - sy / sx, 2) + power(1 - r, 2)), 6) AS kge, round(1 - sqrt(power(1 - my / mx, 2) + power(1 - sy / sx, 2)), 6) AS kge_no_correlation,
round(1 - sqrt(power(1 - my / mx, 2) + power(1 - (sy / my) / (sx / mx), 2) + power(1 - r, 2)), 6) AS kge_prime, round(agreement, 6) AS agreement FROM s JOIN l USING (l_returnflag)""")
def _(spark, d):
    x, y = F.col("x"), F.col("y")
    return _items(spark, d).groupBy("l_returnflag").agg(*(_r(f(x, y), 4 if k in ("bias", "mae", "rmse") else 6).alias(k) for k, f in SKILL.items()))


@_add("wnse", f"WITH {ITEMS} SELECT l_returnflag, round(1 - sum(x * (y - x) * (y - x)) / sum(x * (x - mx) * (x - mx)), 6) AS wnse FROM t JOIN m USING (l_returnflag) GROUP BY 1")
def _(spark, d):
    return st.wnse(_items(spark, d), ["l_returnflag"], "x", "y").select("l_returnflag", _r(F.col("wnse"), 6).alias("wnse"))


@_add("kge_np", f"""WITH {ITEMS}, r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, x) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2.0 AS ry,
row_number() OVER (PARTITION BY l_returnflag ORDER BY x) AS kx, row_number() OVER (PARTITION BY l_returnflag ORDER BY y) AS ky FROM t),
c AS (SELECT l_returnflag, corr(rx, ry) AS r FROM r GROUP BY 1),
a AS (SELECT a.l_returnflag, 1 - 0.5 * sum(abs(b.y / (n * my) - a.x / (n * mx))) AS a FROM r a JOIN r b ON a.l_returnflag = b.l_returnflag AND a.kx = b.ky JOIN m ON m.l_returnflag = a.l_returnflag GROUP BY 1)
SELECT l_returnflag, round(1 - sqrt(power(1 - a, 2) + power(1 - my / mx, 2) + power(1 - r, 2)), 6) AS kge_np FROM a JOIN c USING (l_returnflag) JOIN m USING (l_returnflag)""")
def _(spark, d):
    return st.kge_np(_items(spark, d), ["l_returnflag"], "x", "y").select("l_returnflag", _r(F.col("kge_np"), 6).alias("kge_np"))


@_add("spaef", f"""WITH t AS (SELECT l_extendedprice AS x, l_quantity * 1000 + l_tax * 1e4 AS y FROM lineitem), h AS (SELECT avg(x) mx, avg(y) my, stddev_samp(x) sx, stddev_samp(y) sy, corr(x, y) r FROM t),
z AS (SELECT least(100, greatest(1, floor(((x - mx) / sx + 6) / 0.12) + 1)) AS b, 1 AS p, 0 AS q FROM t, h UNION ALL SELECT least(100, greatest(1, floor(((y - my) / sy + 6) / 0.12) + 1)), 0, 1 FROM t, h),
c AS (SELECT b, sum(p) p, sum(q) q FROM z GROUP BY b), g AS (SELECT sum(least(p, q)) / sum(p) AS g FROM c)
SELECT round(1 - sqrt(power(r - 1, 2) + power((sy / my) / (sx / mx) - 1, 2) + power(g - 1, 2)), 4) AS spaef FROM h, g""")
def _(spark, d):
    return st.spaef(_items(spark, d), "x", "y").select(_r(F.col("spaef")).alias("spaef"))


PLACES = {1: None, 2: "n * 0.75", 3: "round(n * 0.75)", 4: "0.5 + n * 0.75", 5: "0.75 * (n + 1)", 6: "(n - 1) * 0.75 + 1", 7: "1.0/3 + 0.75 * (n + 1.0/3)", 8: "3.0/8 + 0.75 * (n + 0.25)"}
for _mode, _place in PLACES.items():
    _k = _place or "ceil(n * 0.75)"

    @_add(f"percentile_mode{_mode}", f"""WITH o AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
q AS (SELECT *, {_k} AS place FROM o), a AS (SELECT l_returnflag, max(CASE WHEN k = floor(place) THEN x END) AS a, max(CASE WHEN k = ceil(place) THEN x END) AS b, any_value(place - floor(place)) AS w FROM q GROUP BY 1)
SELECT l_returnflag, round(a + (b - a) * w, 4) AS percentile FROM a""")
    def _(spark, d, mode=_mode):
        return st.percentiles(_items(spark, d), ["l_returnflag"], "x", 75, mode).select("l_returnflag", _r(F.col("percentile")).alias("percentile"))


@_add("median", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1")
def _(spark, d):
    return _items(spark, d).groupBy("l_returnflag").agg(_r(F.median("x")).alias("median"))


@_add("histogram", """WITH c AS (SELECT least(20, greatest(1, floor((l_extendedprice - 5000) / 4000) + 1)) AS bin, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k::INTEGER AS bin, coalesce(n, 0) AS n FROM range(1, 21) t(k) LEFT JOIN c ON bin = k""")
def _(spark, d):
    return st.histogram(_items(spark, d), "x", 20, 5000.0, 85000.0)


@_add("linfit", """WITH s AS (SELECT l_returnflag, count(*) n, avg(l_quantity) mx, avg(l_extendedprice) my, var_pop(l_quantity) * count(*) sxx, var_pop(l_extendedprice) * count(*) syy, covar_pop(l_extendedprice, l_quantity) * count(*) sxy FROM lineitem GROUP BY 1),
e AS (SELECT *, sxy / sxx AS b, sign(sxy) * sqrt(syy / sxx) AS b2, (syy - sxy * sxy / sxx) / (n - 2) AS yx, (sxx - sxy * sxy / syy) / (n - 2) AS xy FROM s)
SELECT l_returnflag, round(my - b * mx, 4) AS a, round(b, 4) AS b, round(sqrt(yx * (1.0 / n + mx * mx / sxx)), 4) AS siga, round(sqrt(yx / sxx), 4) AS sigb, round((syy - b * sxy) / 1e9, 4) AS chi2,
round(my - b2 * mx, 4) AS a2, round(b2, 4) AS b2, round(sqrt(yx * (1.0 / n + mx * mx / sxx) + b2 * b2 * xy / n), 4) AS siga2, round((syy - 2 * b2 * sxy + b2 * b2 * sxx) / 1e9, 4) AS chi22 FROM e""")
def _(spark, d):
    q = _t(spark, d, "lineitem").groupBy("l_returnflag")
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    f, g = F.col("f"), F.col("g")
    return q.agg(st.linfit(x, y).alias("f"), st.linfit(x, y, True).alias("g")).select(
        "l_returnflag", *(_r(f[k]).alias(k) for k in ("a", "b", "siga", "sigb")), _r(f["chi2"] / 1e9).alias("chi2"), *(_r(g[k]).alias(f"{k}2") for k in ("a", "b", "siga")), _r(g["chi2"] / 1e9).alias("chi22")
    )


@_add("similarity_pd", f"""WITH {CELLS}, p AS (SELECT a.i, a.j, count(*) n, sum(CASE WHEN (b.value > a.value) <> (b.klass > a.klass) THEN 1 ELSE 0 END) dd, sum(CASE WHEN b.value > a.value THEN 1 ELSE 0 END) na, sum(CASE WHEN b.klass > a.klass THEN 1 ELSE 0 END) nb
FROM cells a JOIN cells b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY a.i, a.j)
SELECT round(1 - avg(dd * 1.0 / n), 6) AS pd, round(1 - avg(abs(na - nb) * 1.0 / n), 6) AS nndv FROM p""")
def _(spark, d):
    cells = _cells(spark, d)
    one = lambda k: grid.similarity(cells, k, "value", "klass").select(_r(F.col("value"), 6).alias(k))
    return one("pd").crossJoin(F.broadcast(one("nndv")))


# sequences

def _daily(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"))


DAILY = "s AS (SELECT l_returnflag, l_shipdate::DATE AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


@_add("cumsum", f"WITH {DAILY} SELECT l_returnflag, day, round(sum(q) OVER (PARTITION BY l_returnflag ORDER BY day), 2) AS cumsum FROM s")
def _(spark, d):
    return sequence.cumsum(_daily(spark, d), ["l_returnflag"], "day", "q").select("l_returnflag", "day", _r(F.col("cumsum"), 2).alias("cumsum"))


@_add("prefix_sum", f"WITH {DAILY} SELECT l_returnflag, day, round(10 + coalesce(sum(q) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0), 2) AS prefix_sum FROM s")
def _(spark, d):
    return sequence.prefix_sum(_daily(spark, d), ["l_returnflag"], "day", "q", shift=2, start=10).select("l_returnflag", "day", _r(F.col("prefix_sum"), 2).alias("prefix_sum"))


@_add("global_cumsum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS cumsum FROM orders")
def _(spark, d):
    return sequence.global_cumsum(_t(spark, d, "orders"), "o_orderkey", "o_totalprice", block=1024).select("o_orderkey", _r(F.col("cumsum"), 2).alias("cumsum"))


@_add("weekly_average", f"WITH {DAILY} SELECT l_returnflag, day, round(avg(q) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS weekly FROM s")
def _(spark, d):
    return sequence.weekly_average(_daily(spark, d), ["l_returnflag"], "day", "q").select("l_returnflag", "day", _r(F.col("weekly"), 6).alias("weekly"))


@_add("standard_score", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER w) / stddev_samp(l_extendedprice) OVER w, 6) AS score FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def _(spark, d):
    return sequence.standard_score(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_orderkey", "l_linenumber", _r(F.col("score"), 6).alias("score"))


@_add("autocorrelation", f"""WITH {DAILY}, m AS (SELECT l_returnflag, avg(q) mq, var_pop(q) v FROM s GROUP BY 1), y AS (SELECT *, lead(q, 3) OVER (PARTITION BY l_returnflag ORDER BY day) AS y FROM s)
SELECT l_returnflag, round(avg((q - mq) * (y - mq)) / any_value(v), 6) AS autocorrelation FROM y JOIN m USING (l_returnflag) GROUP BY 1""")
def _(spark, d):
    return sequence.autocorrelation(_daily(spark, d), ["l_returnflag"], "day", "q", 3).select("l_returnflag", _r(F.col("autocorrelation"), 6).alias("autocorrelation"))


@_add("mad", f"""WITH {DAILY}, c AS (SELECT l_returnflag, median(q) c FROM s GROUP BY 1), a AS (SELECT s.*, abs(q - c) a FROM s JOIN c USING (l_returnflag)), t AS (SELECT l_returnflag, median(a) * (2 / 0.6745) t FROM a GROUP BY 1)
SELECT l_returnflag, day, a <= t AS keep FROM a JOIN t USING (l_returnflag)""")
def _(spark, d):
    return sequence.mad(_daily(spark, d), ["l_returnflag"], "day", "q", z=2.0).select("l_returnflag", "day", "keep")


@_add("mad_clamp", f"""WITH {DAILY}, c AS (SELECT l_returnflag, median(q) c FROM s GROUP BY 1), a AS (SELECT s.*, c FROM s JOIN c USING (l_returnflag)), t AS (SELECT l_returnflag, median(abs(q - c)) * (2 / 0.6745) t FROM a GROUP BY 1)
SELECT l_returnflag, day, round(greatest(least(q, c + t), c - t), 4) AS clamped FROM a JOIN t USING (l_returnflag)""")
def _(spark, d):
    return sequence.mad_clamp(_daily(spark, d), ["l_returnflag"], "q", z=2.0).select("l_returnflag", "day", _r(F.col("clamped")).alias("clamped"))


@_add("newton_cotes", f"""WITH {DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY day) - 1 AS k, ((count(*) OVER (PARTITION BY l_returnflag) - 1) // 4) * 4 AS z FROM s)
SELECT l_returnflag, round(sum(q * CASE WHEN k = 0 OR k = z THEN 7 WHEN k % 4 = 0 THEN 14 WHEN k % 4 = 2 THEN 12 ELSE 32 END) * 2.0 / 45, 4) AS integral FROM k WHERE k <= z GROUP BY 1""")
def _(spark, d):
    return sequence.newton_cotes(_daily(spark, d), ["l_returnflag"], "day", "q").select("l_returnflag", _r(F.col("integral")).alias("integral"))


CEILING = f"""{DAILY}, w AS (SELECT *, avg(q) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM s),
o AS (SELECT l_returnflag, w, row_number() OVER (PARTITION BY l_returnflag ORDER BY w) AS i, 0.5 + 0.2 * count(*) OVER (PARTITION BY l_returnflag) AS place FROM w),
p AS (SELECT l_returnflag, max(CASE WHEN i = floor(place) THEN w END) AS a, max(CASE WHEN i = ceil(place) THEN w END) AS b, any_value(place - floor(place)) AS f FROM o GROUP BY 1),
t AS (SELECT l_returnflag, any_value(a + (b - a) * f) * count(*) / sum(q) AS top FROM s JOIN p USING (l_returnflag) GROUP BY 1)"""
BASEFLOW = f"""{CEILING}, k AS (SELECT s.*, top, row_number() OVER (PARTITION BY l_returnflag ORDER BY day) AS k FROM s JOIN t USING (l_returnflag)),
r AS (SELECT l_returnflag, day, k, q, (1 - 0.98) * top * q / (1 - 0.98 * top) AS b FROM k WHERE k = 1
UNION ALL SELECT k.l_returnflag, k.day, k.k, k.q, ((1 - top) * 0.98 * r.b + (1 - 0.98) * top * k.q) / (1 - 0.98 * top) FROM r JOIN k ON k.l_returnflag = r.l_returnflag AND k.k = r.k + 1)"""


@_add("baseflow_ceiling", f"WITH {CEILING} SELECT l_returnflag, round(top, 6) AS bfi_max FROM t")
def _(spark, d):
    return sequence.baseflow_ceiling(_daily(spark, d), ["l_returnflag"], "day", "q").select("l_returnflag", _r(F.col("bfi_max"), 6).alias("bfi_max"))


@_add("eckhardt", f"WITH RECURSIVE {BASEFLOW} SELECT l_returnflag, day, round(b, 6) AS baseflow FROM r")
def _(spark, d):
    return sequence.eckhardt(_daily(spark, d), ["l_returnflag"], "day", "q", 0.98).select("l_returnflag", "day", _r(F.col("baseflow"), 6).alias("baseflow"))


@_add("baseflow_index", f"WITH RECURSIVE {BASEFLOW} SELECT l_returnflag, round(sum(b) / sum(q), 6) AS bfi FROM r GROUP BY 1")
def _(spark, d):
    base = sequence.eckhardt(_daily(spark, d), ["l_returnflag"], "day", "q", 0.98)
    return base.groupBy("l_returnflag").agg(_r(sequence.baseflow_index(F.col("q"), F.col("baseflow")), 6).alias("bfi"))


@_add("eckhardt_fit")
def _(spark, d):
    return sequence.eckhardt_fit(_daily(spark, d), ["l_returnflag"], "day", "q").select("l_returnflag", _r(F.col("alpha"), 6).alias("alpha"), _r(F.col("bfi_max"), 6).alias("bfi_max"))


@_add("boxcox", "SELECT p_partkey, round((power(p_retailprice, 0.3) - 1) / 0.3, 6) AS y, round(ln(p_retailprice), 6) AS z FROM part")
def _(spark, d):
    return _t(spark, d, "part").select("p_partkey", _r(sequence.boxcox(F.col("p_retailprice"), 0.3), 6).alias("y"), _r(sequence.boxcox(F.col("p_retailprice"), 0), 6).alias("z"))


@_add("kernel_density", "SELECT x::DOUBLE AS point, round(sum(exp(-power((x - p_retailprice) / 50, 2) / 2)) / (count(*) * 50 * sqrt(2 * pi())), 8) AS density FROM part, range(900, 2000, 100) t(x) GROUP BY x")
def _(spark, d):
    return sequence.kernel_density(_t(spark, d, "part"), "p_retailprice", 50.0, [float(p) for p in range(900, 2000, 100)]).select(F.col("at").alias("point"), _r(F.col("density"), 8).alias("density"))


@_add("kernel_regression", "SELECT ((x - 5) // 10)::INTEGER AS i, round(sum(exp(-power((x - p_size) / 5.0, 2) / 2) * p_retailprice) / sum(exp(-power((x - p_size) / 5.0, 2) / 2)), 4) AS value FROM part, range(5, 50, 10) t(x) GROUP BY x")
def _(spark, d):
    return sequence.kernel_regression(_t(spark, d, "part"), ["p_size"], "p_retailprice", [5.0], [(p,) for p in range(5, 50, 10)]).select("i", _r(F.col("value")).alias("value"))


# order

@_add("rank_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey * 10 + l_linenumber)::INTEGER AS rank FROM lineitem")
def _(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return sequence.rank_index(rows, ["l_returnflag"], "l_quantity", "at").select("l_orderkey", "l_linenumber", "rank")


@_add("top_smallest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def _(spark, d):
    return sequence.top(_t(spark, d, "orders"), "o_totalprice", 50, "o_orderkey").select("o_orderkey", "o_totalprice")


@_add("top_largest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, d):
    return sequence.top(_t(spark, d, "orders"), "o_totalprice", 50, "o_orderkey", True).select("o_orderkey", "o_totalprice")


@_add("dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size)::INTEGER AS rank FROM part")
def _(spark, d):
    return sequence.dense_rank(_t(spark, d, "part"), ["p_brand"], "p_size").select("p_partkey", "rank")


@_add("first_occurrences", "SELECT p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def _(spark, d):
    return sequence.first_occurrences(_t(spark, d, "part"), "p_type", "p_partkey")


@_add("multiplicity", "SELECT p_partkey, count(*) OVER (PARTITION BY p_size) AS n FROM part")
def _(spark, d):
    return sequence.multiplicity(_t(spark, d, "part"), [], "p_size").select("p_partkey", "n")


@_add("nth_smallest", "SELECT p_brand, p_size FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS k FROM part) WHERE k = 7")
def _(spark, d):
    return sequence.nth(_t(spark, d, "part"), ["p_brand"], "p_size", 7)


@_add("average_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rank FROM part")
def _(spark, d):
    return st.average_rank(_t(spark, d, "part"), ["p_brand"], "p_size", "rank").select("p_partkey", F.col("rank").cast("double").alias("rank"))


@_add("argmax_argmin", "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS imax, arg_min(o_orderkey, o_totalprice) AS imin FROM orders GROUP BY 1")
def _(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(sequence.argmax("o_totalprice", "o_orderkey").alias("imax"), sequence.argmin("o_totalprice", "o_orderkey").alias("imin"))


@_add("append_pad", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, -9999 AS size FROM supplier UNION ALL SELECT p_partkey, p_name, -9999, p_size FROM part")
def _(spark, d):
    a = _t(spark, d, "supplier").selectExpr("s_suppkey as key", "s_name as name", "s_acctbal as balance")
    b = _t(spark, d, "part").selectExpr("p_partkey as key", "p_name as name", "p_size as size")
    return sequence.append(a, b, -9999)


# time

@_add("day_to_month", """WITH m AS (SELECT date_trunc('month', ts)::TIMESTAMP AS period, event_type, avg(value) AS value FROM events GROUP BY 1, 2), e AS (SELECT event_type, min(period) a, max(period) b FROM m GROUP BY 1),
r AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS period FROM e) SELECT event_type, r.period, round(value, 6) AS value FROM r LEFT JOIN m USING (event_type, period)""")
def _(spark, d):
    return timeaxis.aggregate(_t(spark, d, "events"), ["event_type"], "ts", "value", "month").select("event_type", "period", _r(F.col("value"), 6).alias("value"))


@_add("hour_to_day", """WITH m AS (SELECT date_trunc('day', ts)::TIMESTAMP AS period, sum(value) AS value FROM events GROUP BY 1), e AS (SELECT min(period) a, max(period) b FROM m),
r AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS period FROM e) SELECT r.period, round(value, 4) AS value FROM r LEFT JOIN m USING (period)""")
def _(spark, d):
    return timeaxis.aggregate(_t(spark, d, "events"), [], "ts", "value", "day", "sum").select("period", _r(F.col("value")).alias("value"))


def _spans(spark, d):
    own = _t(spark, d, "lineitem").select("l_returnflag", (F.unix_date(F.to_date("l_shipdate")).cast("long") % 400).alias("k"), "l_quantity")
    days = own.groupBy("l_returnflag", "k").agg(F.sum("l_quantity").alias("value"))
    weeks = spark.range(0, 56).select("id", (F.col("id") * 604800).alias("lower"), ((F.col("id") + 1) * 604800).alias("upper")).withColumnRenamed("id", "t")
    return days.select("l_returnflag", (F.col("k") * 86400).alias("lower"), ((F.col("k") + 1) * 86400).alias("upper"), "value"), weeks


for _m, _f in {"mean": "sum(value) / 7", "sum": "sum(value)", "min": "min(value)", "max": "max(value)"}.items():

    @_add(f"resample_{_m}", f"""WITH s AS (SELECT l_returnflag, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) % 400 AS k, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, k // 7 AS t, round(CASE WHEN count(*) = 7 THEN {_f} END, 4) AS value FROM s WHERE k // 7 < 56 GROUP BY 1, 2""")
    def _(spark, d, m=_m):
        source, target = _spans(spark, d)
        return timeaxis.resample_intervals(source, target, ["l_returnflag"], m).select("l_returnflag", "t", _r(F.col("value")).alias("value"))


def _instants(spark, d):
    own = _t(spark, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value", "event_id")
    s = own.where("event_id % 2 = 0").groupBy("event_type", "at").agg(F.max("value").alias("value"))
    return s, own.where("event_id % 2 = 1").select("event_type", "at").distinct()


INSTANT = "s AS (SELECT event_type, epoch_us(ts) AS us, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), t AS (SELECT DISTINCT event_type, epoch_us(ts) AS us FROM events WHERE event_id % 2 = 1)"
BOTH = f"{INSTANT}, p AS (SELECT t.event_type, t.us, s.us AS pa, s.value AS pv FROM t ASOF LEFT JOIN s ON t.event_type = s.event_type AND t.us >= s.us), n AS (SELECT t.event_type, t.us, s.us AS na, s.value AS nv FROM t ASOF LEFT JOIN s ON t.event_type = s.event_type AND t.us <= s.us)"
for _m, _f in {"previous": "pv", "nearest": "CASE WHEN na IS NULL OR p.us - pa <= na - p.us THEN pv ELSE nv END", "linear": "CASE WHEN pa = na THEN pv ELSE pv + (nv - pv) * (p.us - pa) / (na - pa) END"}.items():

    @_add(f"asof_{_m}", f"WITH {BOTH} SELECT event_type, p.us, round({_f}, 6) AS value FROM p JOIN n USING (event_type, us)")
    def _(spark, d, m=_m):
        return timeaxis.resample_instants(*_instants(spark, d), ["event_type"], m, bucket=86_400_000_000).select("event_type", F.col("at").alias("us"), _r(F.col("value"), 6).alias("value"))


@_add("time_chunk", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-03-01'")
def _(spark, d):
    return timeaxis.chunk(_t(spark, d, "orders"), "o_orderdate", "1995-01-01 00:00:00", "1995-03-01 00:00:00").select("o_orderkey")


@_add("dates", """SELECT o_orderkey, dayofyear(o_orderdate)::INTEGER AS doy, isodow(o_orderdate)::INTEGER AS weekday, day(last_day(o_orderdate))::INTEGER AS days_in_month,
(date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 1)::INTEGER AS ordinal, julian(o_orderdate::DATE)::BIGINT AS julian FROM orders""")
def _(spark, d):
    t = F.col("o_orderdate")
    return _t(spark, d, "orders").select("o_orderkey", F.dayofyear(t).alias("doy"), sc.week_day(t).alias("weekday"), sc.days_in_month(t).alias("days_in_month"), sc.ordinal(F.to_date(t)).alias("ordinal"), sc.julian_day(F.year(t), F.month(t), F.day(t)).alias("julian"))


@_add("calendars", """SELECT o_orderkey, (year(o_orderdate) * 360 + (month(o_orderdate) - 1) * 30 + day(o_orderdate) - 1)::BIGINT AS d360,
(year(o_orderdate) * 365 + [0,31,59,90,120,151,181,212,243,273,304,334][month(o_orderdate)] + day(o_orderdate) - 1)::BIGINT AS d365 FROM orders""")
def _(spark, d):
    t = F.col("o_orderdate")
    return _t(spark, d, "orders").select("o_orderkey", *(sc.julian_day(F.year(t), F.month(t), F.day(t), c).cast("long").alias(k) for k, c in (("d360", "360_day"), ("d365", "365_day"))))


# strings, polygons, polynomials

@_add("strings", r"""SELECT page_id, regexp_replace(url, '[ \t]', '', 'g') AS compressed, regexp_matches(url, '^https://.*/en/.*$') AS english, len(string_split(url, '/'))::INTEGER AS parts,
regexp_replace(url, '\bexample\b', 'sample', 'g') AS replaced, starts_with(url, 'https') AS secure FROM pages""")
def _(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", sc.compress(u).alias("compressed"), sc.glob_match(u, "https://*/en/*").alias("english"), F.size(sc.divide_string(u, "/")).alias("parts"), sc.replace_word(u, "example", "sample").alias("replaced"), sc.starts_with(u, "https").alias("secure"))


@_add("polynomial", "SELECT p_partkey, round(2 - 3.0 * (p_size / 10.0) + 0.5 * power(p_size / 10.0, 2), 6) AS value, round(-3.0 + 1.0 * (p_size / 10.0), 6) AS slope FROM part")
def _(spark, d):
    c = F.array(*map(F.lit, (2.0, -3.0, 0.5)))
    x = F.col("p_size") / 10.0
    return _t(spark, d, "part").select("p_partkey", _r(sc.polynomial(c, x), 6).alias("value"), _r(sc.polynomial(sc.derivative(c), x), 6).alias("slope"))


@_add("polygon_area", "SELECT p_partkey, round(p_size * (p_size + 1) / 2.0, 4) AS area, -1 AS turn, round(p_size / 3.0, 4) AS cx FROM part")
def _(spark, d):
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, s = F.lit(0.0), F.col("p_size")
    shape = F.array(corner(zero, zero), corner(s, zero), corner(zero, s + 1))
    return _t(spark, d, "part").select("p_partkey", _r(sc.polygon_area(shape)).alias("area"), sc.polygon_orientation(shape).alias("turn"), _r(sc.polygon_centre(shape).x).alias("cx"))


@_add("is_close", "SELECT l_orderkey, l_linenumber, abs(l_extendedprice - l_quantity * 1500) <= greatest(0.01 * greatest(abs(l_extendedprice), abs(l_quantity * 1500)), 1e-8) AS close FROM lineitem")
def _(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sc.is_close(F.col("l_extendedprice"), F.col("l_quantity") * 1500, rtol=0.01).alias("close"))


@_add("test_functions", """SELECT s_suppkey, round(a*a + b*b, 6) AS sphere, round(100 * power(b - a*a, 2) + power(1 - a, 2), 6) AS rosenbrock, round(power(a + 2*b - 7, 2) + power(2*a + b - 5, 2), 6) AS booth, round(power(a*a + b - 11, 2) + power(a + b*b - 7, 2), 6) AS himmelblau
FROM (SELECT s_suppkey, s_nationkey / 5.0 - 2 AS a, s_suppkey % 11 / 4.0 - 1 AS b FROM supplier)""")
def _(spark, d):
    xs = [F.col("s_nationkey") / 5.0 - 2, F.col("s_suppkey") % 11 / 4.0 - 1]
    return _t(spark, d, "supplier").select("s_suppkey", *(_r(sc.TEST_FUNCTIONS[k](xs), 6).alias(k) for k in ("sphere", "rosenbrock", "booth", "himmelblau")))


# graphs: a river network in which station k drains into k div 2

def _network(spark, d):
    nodes = _t(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("id"))
    return nodes, nodes.where("id > 1").select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"))


NET = "n AS (SELECT s_suppkey + 1 AS id FROM supplier), e AS (SELECT id AS src, id // 2 AS dst FROM n WHERE id > 1)"


@_add("graph_roots_leaves", f"WITH {NET} SELECT id, id NOT IN (SELECT src FROM e) AS is_root, id NOT IN (SELECT dst FROM e) AS is_leaf FROM n")
def _(spark, d):
    nodes, edges = _network(spark, d)
    mark = lambda df, c: df.withColumn(c, F.lit(True))
    out = nodes.join(mark(graph.roots(nodes, edges), "is_root"), "id", "left").join(mark(graph.leaves(nodes, edges), "is_leaf"), "id", "left")
    return out.fillna(False, ["is_root", "is_leaf"])


@_add("graph_dependencies", f"WITH RECURSIVE {NET}, r AS (SELECT 3::BIGINT AS id UNION SELECT e.src FROM r JOIN e ON e.dst = r.id) SELECT id FROM r WHERE id <> 3")
def _(spark, d):
    return graph.dependencies(_network(spark, d)[1], spark.range(3, 4))


@_add("graph_dependents", f"WITH RECURSIVE {NET}, r AS (SELECT 77::BIGINT AS id UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT id FROM r WHERE id <> 77")
def _(spark, d):
    return graph.dependents(_network(spark, d)[1], spark.range(77, 78))


@_add("graph_levels", f"WITH RECURSIVE {NET}, r AS (SELECT id, 1 AS level FROM n WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id) SELECT id, max(level)::INTEGER AS level FROM r GROUP BY id")
def _(spark, d):
    return graph.order(*_network(spark, d))


@_add("graph_subgraph", f"WITH RECURSIVE {NET}, r AS (SELECT 5::BIGINT AS id UNION SELECT e.src FROM r JOIN e ON e.dst = r.id) SELECT src, dst FROM e WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r)")
def _(spark, d):
    return graph.subgraph(_network(spark, d)[1], spark.range(5, 6))


def queries() -> dict:
    from gridbrook.plans import grid_queries, series_queries, source_queries  # noqa: F401  (they register their own)

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(ORACLE)
