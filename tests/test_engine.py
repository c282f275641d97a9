"""Goldens of single operators and the catalog against DuckDB at the smallest scale."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridbrook.functions import scalars as sc
from gridbrook.functions import statistics as st
from gridbrook.operators import calibrate, graph, grid, nearest, sequence, timeaxis
from gridbrook.plans import catalog
from gridbrook.sources import datasets, files, netcdf
from gridbrook.streaming import windows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_catalog(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if got[c].dtype.kind in "if":
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, rtol=1e-9, atol=1e-6), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_percentile_modes(spark):
    rows = spark.range(1, 11).select(F.col("id").cast("double").alias("x"))
    got = [st.percentiles(rows, [], "x", 75, m).first()[0] for m in range(1, 9)]
    assert np.allclose(got, [8, 7.5, 8, 8, 8.25, 7.75, 8.0833, 8.0625], atol=1e-4)


def test_moments(spark):
    rows = spark.range(1, 11).select(F.col("id").cast("double").alias("x"))
    assert st.absdev(rows, [], "x").first()[0] == 2.5
    assert st.central_moments(rows, [], "x", [2]).first()[0] == 8.25
    assert st.central_moment_variance(rows, [], "x", 2).first()[0] == pytest.approx((120.8625 - 8.25**2) / 10)


def test_scaling(spark):
    spec = grid.GridSpec(2, 2)
    cells = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (1, 2, 3.0), (2, 2, 4.0)], "i int, j int, value double")
    one = lambda op, **k: grid.upscale(cells, spec, 2, op, **k).first()["value"]
    assert [one("var"), one("std"), one("median"), one("a_mean"), one("sum"), one("maxloc")] == [1.25, math.sqrt(1.25), 2.5, 2.5, 10, 4]
    assert one("p_mean", p=2.0) == pytest.approx(math.sqrt(7.5)) and one("g_mean") == pytest.approx(24**0.25)
    fine = grid.downscale(cells, spec, 2, spark.createDataFrame([(1, 1, 8.0)], "ci int, cj int, value double"), "split")
    assert [r.value for r in fine.collect()] == [2.0] * 4
    down = grid.GridSpec(4, 3, top_down=True)
    assert grid.full_index(spark, down).select(*(c.alias(k) for c, k in zip(down.coarse_key(2), "ab")), "j").where("j = 1").first()["b"] == 1


def test_similarity(spark):
    a, b = [12, 4, 15, 17, 10, 2, 1, 11, 20], [7, 12, 5, 9, 11, 13, 12, 11, 7]
    cells = spark.createDataFrame([(k % 3 + 1, k // 3 + 1, float(x), float(y)) for k, (x, y) in enumerate(zip(a, b))], "i int, j int, a double, b double")
    assert grid.similarity(cells, "nndv").first()[0] == pytest.approx(0.29815, abs=1e-5)
    assert grid.similarity(cells, "pd").first()[0] == pytest.approx(0.08148, abs=1e-5)


def test_nearest(spark):
    src = spark.createDataFrame([(10, 0.0, 0.0), (20, 2.0, 0.0), (30, 0.0, 2.0), (5, 2.0, 2.0)], "source_id long, x double, y double")
    ask = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.7, 0.1), (3, 0.1, 1.8)], "target_id long, x double, y double")
    assert {r.target_id: r.source_id for r in nearest.nearest(ask, src, ["x", "y"]).collect()} == {1: 5, 2: 20, 3: 30}
    src = spark.createDataFrame([(2, 179.0, 0.0), (1, -179.0, 0.0), (3, 0.0, 40.0)], "source_id long, x double, y double")
    ask = spark.createDataFrame([(1, 0.0, 41.0)], "target_id long, x double, y double")
    assert nearest.nearest(ask, src, ["x", "y"], lonlat=True).first()["source_id"] == 3


def test_resampling(spark):
    s = spark.createDataFrame([(1, 0, 0.0), (1, 10, 10.0), (1, 20, 20.0)], "k int, at long, value double")
    t = spark.createDataFrame([(1, 5), (1, 15), (1, 20)], "k int, at long")
    got = {m: [r.value for r in timeaxis.resample_instants(s, t, ["k"], m).orderBy("at").collect()] for m in ("previous", "nearest", "linear")}
    assert got == {"previous": [0, 10, 20], "nearest": [0, 10, 20], "linear": [5, 15, 20]}
    hours = spark.range(48).select(F.lit(1).alias("k"), (F.col("id") * 3600).alias("lower"), ((F.col("id") + 1) * 3600).alias("upper"), F.when(F.col("id") < 24, 1.0).otherwise(3.0).alias("value"))
    days = spark.range(2).select(F.col("id").alias("t"), (F.col("id") * 86400).alias("lower"), ((F.col("id") + 1) * 86400).alias("upper"))
    assert [r.value for r in timeaxis.resample_intervals(hours, days, ["k"], "mean").orderBy("t").collect()] == pytest.approx([1, 3])
    assert timeaxis.decode_units("hours since 2001-02-03") == (3600, "2001-02-03 00:00:00")
    with pytest.raises(ValueError):
        timeaxis.decode_units("weeks since 2001-01-01")
    axis = timeaxis.axis(spark, "2001-01-01 00:00:00", "2001-04-01 00:00:00", "1 month")
    assert axis.count() == 3


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (5, 3), (1, 3), (5, 4), (2, 5), (2, 6), (4, 6)], "src long, dst long")
    nodes = spark.range(1, 7)
    sizes = graph.levels(nodes, edges).groupBy("level").count().orderBy("level").collect()
    assert [r["count"] for r in sizes] == [1, 1, 1, 2, 1]
    with pytest.raises(ValueError):
        graph.order(nodes, edges.union(spark.createDataFrame([(6, 1)], "src long, dst long")))


def test_calendars(spark):
    rows = spark.createDataFrame([(2000, 2, 29), (1582, 10, 4), (1582, 10, 15), (1, 1, 1)], "y int, m int, d int")
    n = sc.julian_day(F.col("y"), F.col("m"), F.col("d"))
    got = rows.select("y", "m", "d", n.alias("n"), sc.calendar_date(n).alias("c")).collect()
    assert [r.n for r in got] == [2451604, 2299160, 2299161, 1721424]
    assert all((r.c.year, r.c.month, r.c.day) == (r.y, r.m, r.d) for r in got)


def test_scalars(spark):
    row = spark.range(1).select(
        sc.replace_word(F.lit("cat concat cat"), "cat", "dog").alias("a"), sc.glob_match(F.lit("abc.txt"), "a?c*").alias("b"),
        F.round(sc.root(F.array(*map(F.lit, (-2.0, 0.0, 1.0))), F.lit(1.0)), 6).alias("c"), sc.linspace(0, 1, 5).alias("d"), sc.is_close(F.lit(1.0), F.lit(1.000001)).alias("e"),
        F.round(sc.ackley([F.lit(0.0), F.lit(0.0)]), 9).alias("f"), F.round(sc.goldstein_price([F.lit(0.0), F.lit(-1.0)]), 9).alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, abs(row.f), row.g) == ("dog concat dog", True, 1.414214, [0, 0.25, 0.5, 0.75, 1], True, 0, 3)


def test_optimizers(spark):
    cost = lambda s: ((s - [1.0, 2.0]) ** 2).sum(axis=1)
    low, high = [-5, -5], [5, 5]
    assert calibrate.dds(cost, [0, 0], low, high, 600)[1] < 1e-2
    assert calibrate.nelder_mead(cost, [0, 0])[1] < 1e-6
    assert calibrate.anneal(cost, [0, 0], low, high)[1] < 1e-2
    assert calibrate.sce(cost, low, high)[1] < 1e-4
    chains = calibrate.mcmc(spark, lambda p: -0.5 * float(((p - np.array([1.0, 2.0])) ** 2).sum()), [0, 0], low, high, chains=2, burn_in=500, samples=1500).cache()
    assert chains.selectExpr("avg(parameters[0])").first()[0] == pytest.approx(1, abs=0.3)
    assert calibrate.convergence(chains, 2).agg(F.max("r")).first()[0] < 1.2


def test_files(spark, tmp_path):
    spec = grid.GridSpec(3, 2, top_down=True)
    cells = spark.createDataFrame([(1, 1, 1.5), (3, 2, 2.5)], "i int, j int, value double")
    path = str(tmp_path / "a.asc")
    files.write_ascii_grid(cells, spec, path)
    files.register(spark)
    assert sorted(map(tuple, spark.read.format("asciigrid").option("path", path).load().collect())) == [(1, 1, 1.5), (3, 2, 2.5)]
    assert files.grid_spec(path) == spec
    (tmp_path / "m.txt").write_text("h\n1 2\n3 4\n")
    assert [r.v for r in files.load_text(spark, str(tmp_path / "m.txt"), skip=1).orderBy("row").collect()] == [[1, 2], [3, 4]]
    assert files.read_namelist("&a\n x = 1, 2 ! c\n y = 'z'\n/\n&b\n w = .true.\n/\n") == {"a": {"x": [1, 2], "y": "z"}, "b": {"w": True}}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    windows.run_once(windows.aggregate(stream, "ts", "value", ["event_type"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.event_type, r.lower): (r.n, round(r.total, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.event_type, r.lower): (r.n, round(r.total, 6)) for r in windows.aggregate(rows, "ts", "value", ["event_type"]).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_sequences(spark):
    rows = spark.createDataFrame([(t, float(v)) for t, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 1000])], "t long, x double")
    assert [r.keep for r in sequence.mad(rows, [], "t", "x").orderBy("t").collect()] == [True] * 8 + [False]
    assert sequence.newton_cotes(rows.where("t < 5"), [], "t", "x").first()[0] == pytest.approx(12)
    fit = sequence.eckhardt_fit(spark.range(400).select(F.lit(1).alias("k"), "id", (10 + F.sin(F.col("id") / 20)).alias("q")), ["k"], "id", "q").first()
    assert 0 <= fit.alpha <= 1 and 0 < fit.bfi_max <= 1


def test_fill_missing(spark):
    cells = catalog._cells(spark, DATA).toPandas()
    known = cells[cells.klass != 0].sort_values(["j", "i"])
    d2 = (cells.i.to_numpy()[:, None] - known.i.to_numpy()) ** 2 + (cells.j.to_numpy()[:, None] - known.j.to_numpy()) ** 2
    want = dict(zip(zip(cells.i, cells.j), known.value.to_numpy()[d2.argmin(axis=1)]))
    got = {(r.i, r.j): r.value for r in catalog.queries()["fill_missing"](spark, DATA).collect()}
    assert got.keys() == want.keys() and max(i for i, _ in got) > 16 and all(abs(got[k] - want[k]) < 1e-5 for k in want)


@pytest.mark.parametrize("top", [0.8, None])
def test_baseflow(spark, top):
    """Against a plain loop: the recurrence starts from 0, is not capped by the discharge, and passes over unknown days."""
    rng = np.random.default_rng(5)
    q = np.where(rng.random(300) < 0.1, np.nan, rng.gamma(2.0, 5.0, 300))
    rows = [(k, t, None if np.isnan(v) else float(v * (k + 1))) for k in (0, 1) for t, v in enumerate(q)] + [(None, 0, 4.0)]
    got = {(r.k, r.t): r.baseflow for r in sequence.eckhardt(spark.createDataFrame(rows, "k int, t int, q double"), ["k"], "t", "q", 0.97, top).collect()}
    assert len(got) == len(rows)
    known = q[~np.isnan(q)]
    if top is None:
        week = [np.nanmean(q[max(0, t - 3) : t + 4]) for t in range(300) if not np.isnan(q[t])]
        place = 0.5 + 0.2 * len(week)
        low, high = np.sort(week)[int(place) - 1], np.sort(week)[math.ceil(place) - 1]
        top = (low + (high - low) * (place - int(place))) * len(known) / known.sum()
    b = 0.0
    for t, v in enumerate(q):
        if np.isnan(v):
            assert got[1, t] == 0
        else:
            b = ((1 - top) * 0.97 * b + 0.03 * top * 2 * v) / (1 - 0.97 * top)
            assert got[1, t] == pytest.approx(b, rel=1e-9)
    assert any(got[0, t] > v for t, v in enumerate(q) if not np.isnan(v))


def test_nulls_stay(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("a", 8.0), (None, 1.0), (None, 2.0), (None, 6.0)], "g string, x double")
    ranks = {(r.g, r.x): r["rank"] for r in st.average_rank(rows, ["g"], "x", "rank").collect()}
    assert len(ranks) == 7 and ranks["a", None] is None and ranks[None, 6.0] == 3 and ranks["a", 8.0] == 3
    assert {(r.g, r.x): r["rank"] for r in sequence.dense_rank(rows, ["g"], "x").collect()} == {k: None if v is None else int(v) for k, v in ranks.items()}
    assert sequence.multiplicity(rows, ["g"], "x").count() == 7 and sequence.standard_score(rows, ["g"], "x").where("score is not null").count() == 6
    assert sequence.mad_clamp(rows, ["g"], "x").count() == 7 and sequence.mad(rows, ["g"], "x", "x").count() == 7
    keep = sequence.mad(spark.createDataFrame([(0, 1.0), (1, None), (2, 2.0), (3, 2.5), (4, None)], "t int, x double"), [], "t", "x", 50.0, 1).orderBy("t").collect()
    assert [r.keep for r in keep] == [False, False, True, False, True]
    assert sequence.newton_cotes(spark.range(3).select("id", F.col("id").cast("double").alias("x")), [], "id", "x").first()[0] is None


def test_linfit_second_model(spark):
    x = np.array([1.0, 2.0, 3.0, 4.0, 6.0, 9.0])
    y = np.array([2.0, 1.0, 4.0, 3.0, 8.0, 7.0])
    f = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double").agg(st.linfit(F.col("x"), F.col("y"), True).alias("f")).first().f
    sxx, syy, sxy = ((x - x.mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum(), ((x - x.mean()) * (y - y.mean())).sum()
    b = math.copysign(math.sqrt(syy / sxx), sxy)
    yx, xy = (syy - sxy**2 / sxx) / 4, (sxx - sxy**2 / syy) / 4
    assert (f.a, f.b, f.sigb) == pytest.approx((y.mean() - b * x.mean(), b, math.sqrt(yx / sxx)))
    assert f.siga == pytest.approx(math.sqrt(yx * (1 / 6 + x.mean() ** 2 / sxx) + b * b * xy / 6))


def test_unknown_sources_and_zeros(spark):
    s = spark.createDataFrame([(1, 0, 10, 4.0), (1, 10, 20, None)], "k int, lower long, upper long, value double")
    t = spark.createDataFrame([(1, 0, 20), (2, 0, 10)], "t int, lower long, upper long")
    assert {r.t: r.value for r in timeaxis.resample_intervals(s, t, ["k"], "mean").collect()} == {1: None, 2: 4.0}
    cells = spark.createDataFrame([(1, 1, 0.0), (2, 1, 4.0)], "i int, j int, value double")
    assert grid.upscale(cells, grid.GridSpec(2, 2), 2, "h_mean").first()["value"] == 0
    ask = spark.createDataFrame([(1, 1.0, None), (2, 0.0, 0.0)], "target_id long, x double, y double")
    src = spark.createDataFrame([(7, 0.0, 1.0), (None, 0.0, 0.0)], "source_id long, x double, y double")
    for most in (0, 10):
        assert {r.target_id: r.source_id for r in nearest.nearest(ask, src, ["x", "y"], most=most).collect()} == {1: None, 2: 7}
    assert [r.source_id for r in nearest.nearest(ask, src.limit(0), ["x", "y"]).collect()] == [None, None]


def test_asof_with_a_hot_series(spark):
    """One series holds nearly all rows; buckets give the results of one window."""
    rng = np.random.default_rng(2)
    src = [(0, int(t), float(v)) for t, v in zip(rng.choice(100_000, 3000, False), rng.random(3000))] + [(1, 50, 1.0)]
    ask = [(0, int(t)) for t in rng.choice(120_000, 3000, False) - 5000] + [(1, 10), (1, 90_000), (2, 5)]
    s, t = spark.createDataFrame(src, "k int, at long, value double"), spark.createDataFrame(ask, "k int, at long")
    for m in ("previous", "nearest", "linear"):
        one, many = ({(r.k, r.at): r.value for r in timeaxis.resample_instants(s, t, ["k"], m, bucket=b).collect()} for b in (None, 700))
        assert one == many and len(one) == len(ask)
    ordered = sorted((a, v) for k, a, v in src if k == 0)
    times = [a for a, _ in ordered]
    for (k, at), v in {(r.k, r.at): r.value for r in timeaxis.resample_instants(s, t, ["k"], "previous", bucket=700).collect()}.items():
        if k == 0:
            n = np.searchsorted(times, at, "right")
            assert v == (ordered[n - 1][1] if n else None)


def test_graph_rounds_agree(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (260, 2)) if a < b]
    edges, nodes = spark.createDataFrame(pairs, "src long, dst long"), spark.range(200)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.levels(nodes, edges)) == rows(graph.levels(nodes, edges, task_edges=0))
    start = spark.createDataFrame([(3,), (50,)], "id long")
    assert rows(graph.reach(edges, start)) == rows(graph.reach(edges, start, task_edges=0))
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    assert rows(graph.components(both)) == rows(graph.components(both, task_edges=0))
    loop = edges.union(spark.createDataFrame([(7, 7), (None, 3)], "src long, dst long"))
    assert (7,) not in [r[:1] for r in rows(graph.levels(nodes, loop))]
    assert graph.traverse(edges, [3], lambda n: graph.STOP_ALL, down=True) == [3]


def test_nearest_by_cells(spark):
    rng = np.random.default_rng(4)
    src = np.vstack([rng.normal(size=(200, 2)) * 0.01, rng.random((100, 2)) * 50, [[3.0, 3.0]] * 50])
    ask = np.vstack([rng.random((80, 2)) * 60 - 5, [[500.0, -300.0]], src[:20]])
    s = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(src)], "source_id long, x double, y double")
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(ask)], "target_id long, x double, y double")
    want = {i: int(((src - p) ** 2).sum(axis=1).argmin()) for i, p in enumerate(ask)}
    assert {r.target_id: r.source_id for r in nearest.nearest(t, s, ["x", "y"], most=0).collect()} == want
    lonlat = lambda most: {r.target_id: r.source_id for r in nearest.nearest(t, s, ["x", "y"], lonlat=True, most=most).collect()}
    assert lonlat(0) == lonlat(1000)


def test_masks(spark):
    whole = grid.GridSpec(8, 4, -180, -90, 45, spherical=True)
    assert whole.periodic and {r.j for r in grid.border_mask(grid.full_index(spark, whole), whole).collect()} == {1, 4}
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    points = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (0.0, 0.0)], "x double, y double")
    assert [r[0] for r in points.select(grid.inside(F.col("x"), F.col("y"), square)).collect()] == [1, 0, -1, 0]
    ring = spark.createDataFrame([(i, j) for i in range(1, 8) for j in range(1, 8) if max(abs(i - 4), abs(j - 4)) in (1, 3)], "i int, j int")
    assert grid.connected_mask(ring, 3, 3).count() == 8 and grid.connected_mask(ring, 1, 1).count() == 24 and grid.connected_mask(ring, 4, 4).count() == 0


def test_masked_goldens(spark):
    a, b = [12, 4, 15, 17, 10, 2, 1, 11, 20], [7, 12, 5, 9, 11, 13, 12, 11, 7]
    assert st.spaef(spark.createDataFrame([(float(x), float(y), k != 4) for k, (x, y) in enumerate(zip(a, b))], "x double, y double, m boolean"), "x", "y", "m").first()[0] is not None
    assert sequence.boxcox(F.lit(-1.0), 0.5) is not None
    assert spark.range(1).select(sequence.boxcox(F.lit(-1.0), 0.5)).first()[0] is None
    neg = spark.createDataFrame([(-2, 3, 4), (2, 3, 4)], "y int, m int, d int")
    for c in ("360_day", "365_day"):
        n = sc.julian_day(F.col("y"), F.col("m"), F.col("d"), c)
        rows = neg.select(n.alias("n"), sc.calendar_date(n, c).alias("c"), "y", "m", "d").collect()
        assert rows[0].n == -rows[1].n and all((r.c.year, r.c.month, r.c.day) == (r.y, r.m, r.d) for r in rows)


def test_kernels(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=120), 2)
    y = np.sin(x) + rng.normal(size=120) * 0.1
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    got = [r.density for r in sequence.kernel_density(rows, "x", 0.3, [-1.0, 0.5], cumulative=True).collect()]
    assert got == pytest.approx([np.mean([0.5 * math.erfc(-(p - v) / 0.3 / math.sqrt(2)) for v in x]) for p in (-1.0, 0.5)], abs=1e-6)

    def density_cost(h):
        d = x[:, None] - x
        phi = lambda z, s: np.exp(-z * z / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
        off = phi(d, h)[~np.eye(len(x), dtype=bool)].sum()
        return phi(d, h * math.sqrt(2)).sum() / len(x) ** 2 - 2 * off / (len(x) * (len(x) - 1))

    def regression_cost(h):
        k = np.exp(-(((x[:, None] - x) / h) ** 2) / 2)
        np.fill_diagonal(k, 0)
        return ((y - k @ y / k.sum(axis=1)) ** 2).mean()

    base = (4 / 3) ** 0.2 * len(x) ** -0.2 * x.std(ddof=1)
    for cost, args in ((density_cost, ("x",)), (regression_cost, ("x", "y"))):
        places = np.linspace(0.2 * base, 5 * base, 400)
        best = min(map(cost, places))
        assert cost(sequence.cross_validated_bandwidth(rows, *args)) <= best + 1e-3 * abs(best) + 1e-9


def test_order_statistics(spark):
    rows = spark.createDataFrame([("a", 5.0, 1), ("a", 2.0, 2), ("a", 2.0, 3), ("a", None, 4), ("b", 1.0, 5)], "g string, x double, k int")
    r = {x.g: x for x in sequence.nth_with_neighbours(rows, ["g"], "x", 2).collect()}
    assert (r["a"].element, r["a"].previous, r["a"].next) == (2.0, 2.0, 5.0) and "b" not in r
    assert {x.g: x.k for x in sequence.nth_index(rows, ["g"], "x", 2, "k").collect()} == {"a": 3}
    assert {x.g: (x.k, x.value) for x in sequence.median_element(rows, ["g"], "x", "k").collect()} == {"a": (3, 2.0), "b": (5, 1.0)}


def test_restarted_search(spark, tmp_path):
    cost = lambda s: ((s - [1.0, 2.0]) ** 2).sum(axis=1)
    state = str(tmp_path / "population")
    first = calibrate.sce(cost, [-5, -5], [5, 5], loops=2, spark=spark, state=state)[1]
    again = calibrate.sce(cost, [-5, -5], [5, 5], loops=30, spark=spark, state=state)[1]
    assert again <= first and again < 1e-4 and spark.read.parquet(state).agg(F.min("loop"), F.max("loop")).first()[0] == 1
    assert calibrate.mdds(cost, [0, 0], [-5, -5], [5, 5], 600)[1] < 1e-2
    assert calibrate.nelder_mead_xy(lambda p, x, y: float(((p[0] * x - y) ** 2).sum()), np.array([1.0, 2.0]), np.array([3.0, 6.0]), [1.0])[0][0] == pytest.approx(3, abs=1e-3)
    x = np.linspace(0, 1, 50)
    chains = calibrate.mcmc_stddev(spark, lambda p: 2 * x + 1 + np.sin(40 * x) * 0.1 - p[0] * x - p[1], [0, 0], [-5, -5], [5, 5], chains=2, burn_in=1000, samples=1500)
    assert chains.selectExpr("avg(parameters[0])").first()[0] == pytest.approx(2, abs=0.3)


def test_pruned_reads(spark, tmp_path):
    rows = spark.range(400).select(F.timestamp_seconds(F.lit(946684800) + F.col("id") * 86400).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).alias("point_id"), F.col("id").cast("double").alias("v"))
    path = str(tmp_path / "d")
    datasets.write(rows, path)
    data = datasets.Dataset(spark, path)
    one = data.read_chunk("2000-03-05 00:00:00", "2000-03-09 00:00:00")
    assert [r.v for r in one.orderBy("ts").collect()] == [65.0, 66.0, 67.0, 68.0]
    assert "PartitionFilters: [isnotnull(period" in one._jdf.queryExecution().toString() and len(one.inputFiles()) > 1
    used = spark.read.parquet(f"{path}/values").where("period = date'2000-03-01'").select(F.input_file_name()).distinct().count()
    assert one.select(F.input_file_name()).distinct().count() == used
    assert data.time_index("2000-03-05 12:00:00") == 66 and data.read_chunk_by_ids(66, 2).count() == 2 and data.read_chunk_by_ids(900, 2).count() == 0


def test_netcdf_refuses(spark, tmp_path):
    bad = tmp_path / "x.nc"
    bad.write_bytes(b"\x89HDF")
    with pytest.raises(ValueError):
        netcdf.read_header(str(bad))
    with pytest.raises(ValueError):
        netcdf.uniform_axis(np.array([1.0, 2.0, 4.0]))
    cells = spark.createDataFrame([(1, 1, 2.0), (2, 2, 4.0)], "i int, j int, value double")
    spec = grid.GridSpec(2, 2, 3.0, 4.0, 0.5, spherical=True, top_down=True)
    path = str(tmp_path / "g.nc")
    netcdf.grid_to_netcdf(cells, spec, path)
    rows, back = netcdf.grid_from_netcdf(spark, path, "value")
    assert back == spec and sorted(map(tuple, rows.collect())) == [(1, 1, 2.0), (2, 2, 4.0)]
    head = netcdf.read_header(path)
    assert netcdf.is_longitude(head.variables["x"]) and netcdf.is_latitude(head.variables["y"])
    with pytest.raises(ValueError):
        netcdf.read_slab(path, head, "value", [0, 0], [3, 1])


def test_time_units(spark):
    assert [timeaxis.units_for(s, t) for s, t in (("hourly", "end"), ("daily", "end"), ("monthly", "start"), ("hourly", "centre"), ("6", "end"), ("48", "end"))] == ["hours", "days", "days", "minutes", "hours", "days"]
    rows = spark.createDataFrame([(10,), (20,), (40,)], "v long")
    bounds = lambda s: [(r.lower, r.upper) for r in timeaxis.infer_bounds(rows, [], "v", s).orderBy("v").collect()]
    assert bounds("end") == [(0, 10), (10, 20), (20, 40)] and bounds("start") == [(10, 20), (20, 40), (40, 50)] and bounds("centre") == [(5, 15), (15, 25), (35, 45)]


def test_eckhardt_fit_all_low_days(spark):
    t = np.arange(3650)
    q = 10 + (4 + t % 365 / 200 + t // 365) * np.sin(t / 58.0) + np.random.default_rng(1).gamma(1.0, 1.0, 3650)
    fit = sequence.eckhardt_fit(spark.createDataFrame([(1, int(i), float(v)) for i, v in enumerate(q)], "k int, t int, q double"), ["k"], "t", "q").first()
    cost, days = sequence._misfit(q)
    places = np.linspace(0, 1, 2001)
    assert days > 1 and abs(fit.alpha - places[cost(places[:, None]).argmin()]) < 1e-3


def test_command_line(spark, tmp_path, capsys):
    from gridbrook.__main__ import main

    assert main(["--list", "up_*_mean"]) == 0 and capsys.readouterr().out.split()[:2] == ["up_a_mean", "sql"]
    assert main(["no_such", "x", "-q"]) == 2 and main(["up_sum", "-q"]) == 2
    assert main(["up_sum", DATA, "--output", str(tmp_path / "o"), "-q"]) == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 48


def test_roots_of_many_rows(spark):
    import time

    c = F.array(-F.col("id").cast("double"), F.lit(0.0), F.lit(1.0))
    one = [sc.root(c, F.col("id").cast("double"), steps=5000, method=m) for m in ("newton", "halley", "cubic")]
    start = time.time()
    far = spark.range(1, 2001).select("id", *(x.alias(k) for k, x in zip("abc", one))).agg(*(F.max(F.abs(F.col(k) - F.sqrt("id"))) for k in "abc")).first()
    assert max(far) < 1e-9 and time.time() - start < 30
    rows = spark.createDataFrame([([1.0, 1.0, 1.0], 0.0), ([None, 1.0], 2.0), (None, 2.0), ([-1.0, 1.0], None), ([], 1.5)], "c array<double>, x double")
    assert [r[0] for r in rows.select(sc.root(F.col("c"), F.col("x"), method="halley")).collect()] == [0.0, 2.0, 2.0, None, 1.5]
    assert [r[0] for r in rows.select(sc.root(F.col("c"), F.col("x"), method="halley", delta=1e-9)).collect()] == [None, None, None, None, 1.5]


def test_text_matrix_in_parts(spark, tmp_path):
    """Later parts are larger files and have several blocks; rows keep the order that they were written in."""
    rows = spark.range(0, 3000).select("id", F.array(F.col("id").cast("double"), F.pow(F.lit(10.0), F.col("id") / 10)).alias("v"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        files.write_text(rows, "id", "v", str(tmp_path / "m"))
        assert len(list((tmp_path / "m").glob("part-*"))) > 1
        assert [(r.row, r.v[0]) for r in files.load_text(spark, str(tmp_path / "m")).orderBy("row").collect()] == [(k + 1, k) for k in range(3000)]
        path = str(tmp_path / "lines.txt")
        open(path, "w").write("".join(f"{k}\n" + "\n" * (k % 3) for k in range(5000)))
        assert [r.v[0] for r in files.load_text(spark, path, skip=10).orderBy("row").collect()] == list(range(10, 5000))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def _most_rows_of_a_task(spark, run):
    """The most rows that one task read from a shuffle while ``run`` ran."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stage_list = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    before = stage_list().apply(0).stageId() if stage_list().size() else -1
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages, out = stage_list(), 0
    for k in range(stages.size()):
        stage = stages.apply(k)
        if stage.stageId() <= before:
            continue
        tasks = store.taskList(stage.stageId(), stage.attemptId(), 100000)
        for i in range(tasks.size()):
            found = tasks.apply(i).taskMetrics()
            if found.isDefined():
                out = max(out, found.get().shuffleReadMetrics().recordsRead())
    return out


def test_rank_index_of_a_large_group(spark):
    """One group is ordered by several tasks; nulls, descending order and null groups keep their places."""
    rows = spark.range(40000, numPartitions=8).select(F.when(F.col("id") >= 100, F.lit("a")).alias("g"), (F.col("id") * 7919 % 40000 % 5).alias("x"), (F.col("id") * 7919 % 40000).alias("at"))
    rows = rows.withColumn("x", F.when(F.col("x") != 3, F.col("x")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for down in (False, True):
            found = []
            assert _most_rows_of_a_task(spark, lambda: found.extend(sequence.rank_index(rows, ["g"], "x", "at", down).collect())) < 20000
            place: dict = {}
            for r in sorted(found, key=lambda r: ((r.x is None) == down, (-r.x if down else r.x) if r.x is not None else 0, r["at"])):
                place[r.g] = place.get(r.g, 0) + 1
                assert r["rank"] == place[r.g]
            assert place == {"a": 39900, None: 100}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_kge_np_of_a_large_group(spark, monkeypatch):
    """One group's values are ranked and walked along by several tasks, with the result of whole sorted series."""
    monkeypatch.setattr(st, "STRETCH", 3000, raising=False)
    rng = np.random.default_rng(3)
    x, y = rng.permutation(40000) + 1.0, np.where(rng.random(40000) < 0.5, 500.0, np.round(rng.gamma(2.0, 300.0, 40000)) + 1)
    rows = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = []
        assert _most_rows_of_a_task(spark, lambda: found.extend(st.kge_np(rows, [], "x", "y").collect())) < 35000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    r = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    a = 1 - 0.5 * np.abs(np.sort(y) / y.sum() - np.sort(x) / x.sum()).sum()
    assert found[0][0] == pytest.approx(1 - math.sqrt((1 - a) ** 2 + (1 - y.mean() / x.mean()) ** 2 + (1 - r) ** 2), abs=1e-9)


def test_registered_aggregates(spark):
    """Partial aggregates: no task reads a whole group; odd groups give what the functions of series give."""
    from gridbrook.functions import registry

    registry.register_all(spark)
    spark.range(40000, numPartitions=8).selectExpr("double(id) x", "double(id % 100) y").createOrReplaceTempView("one_group")
    assert _most_rows_of_a_task(spark, lambda: spark.sql("select kge(x, y), nse(x, y) from one_group").collect()) < 100
    nan, inf = math.nan, math.inf
    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.5), ("a", 4.0, 3.0), ("a", None, 3.0), ("a", nan, 1.0), ("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("level", 1.0, 2.0), ("level", 3.0, 2.0), ("zero", -1.0, 2.0), ("zero", 1.0, 3.0), ("none", None, 1.0), ("both", -1.0, 2.0), ("both", 1.0, -2.0)]
    spark.createDataFrame(rows, "g string, x double, y double").createOrReplaceTempView("odd_pairs")
    want = {"a": (0.323305, 0.517857), "flat": (nan, nan), "level": (nan, 0.0), "none": (nan, nan), "one": (nan, nan), "zero": (-inf, -5.5), "both": (nan, -8.0)}
    for r in spark.sql("select g, round(kge(x, y), 6) k, round(nse(x, y), 6) n from odd_pairs group by g having count(*) > 0 order by g").collect():
        assert (r.k, r.n) == pytest.approx(want[r.g], nan_ok=True)
        assert (registry._kge_series(*_series(rows, r.g)), registry._nse_series(*_series(rows, r.g))) == pytest.approx(want[r.g], nan_ok=True, abs=1e-6)
    assert spark.sql("select nse_window(x, y) over (partition by g) n from odd_pairs where g = 'a'").first().n == pytest.approx(0.517857, abs=1e-6)


def _series(rows, g):
    own = pd.DataFrame([r for r in rows if r[0] == g], columns=["g", "x", "y"]).astype({"x": float, "y": float})
    return own.x, own.y


def test_absent_subpackage():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and os.path.exists(DATA)
