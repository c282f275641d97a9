"""Queries of statistics, sequences, order, scalars, dates, optimizers and user-defined functions, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridbrook.functions import registry
from gridbrook.functions import scalars as sc
from gridbrook.functions import statistics as st
from gridbrook.operators import calibrate, sequence, timeaxis
from gridbrook.plans.catalog import DAILY, ITEMS, _add, _daily, _items, _r, _t
from gridbrook.streaming import windows

FLAG = ["l_returnflag"]


def _scaled(spark, d):
    return _items(spark, d).select("l_returnflag", (F.col("x") / 1e4).alias("x"), (F.col("y") / 1e4).alias("y"))


SCALED = "t AS (SELECT l_returnflag, l_extendedprice / 1e4 AS x, (l_quantity * 1000 + l_tax * 1e4) / 1e4 AS y FROM lineitem), m AS (SELECT l_returnflag, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM t GROUP BY 1), d AS (SELECT l_returnflag, n, x - mx AS dx, y - my AS dy FROM t JOIN m USING (l_returnflag))"


# statistics

@_add("central_moment_edges", "SELECT l_returnflag, 0.0::DOUBLE AS negative, 1.0::DOUBLE AS zero, 0.0::DOUBLE AS one FROM lineitem GROUP BY 1")
def _(spark, d):
    out = st.central_moments(_scaled(spark, d), FLAG, "x", [-1, 0, 1])
    return out.select("l_returnflag", F.col("m-1").alias("negative"), F.col("m0").alias("zero"), (_r(F.col("m1"), 9) + 0.0).alias("one"))


@_add("central_moment_variance", f"WITH {SCALED}, u AS (SELECT l_returnflag, any_value(n) AS n, avg(dx**2) AS u2, avg(dx**3) AS u3, avg(dx**4) AS u4, avg(dx**6) AS u6 FROM d GROUP BY 1) SELECT l_returnflag, round(1e6 * (u6 - u3 * u3 + 9 * u2 * u2 * u2 - 6 * u4 * u2) / n, 4) AS value FROM u")
def _(spark, d):
    return st.central_moment_variance(_scaled(spark, d), FLAG, "x", 3).select("l_returnflag", _r(1e6 * F.col("value")).alias("value"))


@_add("mixed_moment_variance", f"""WITH {SCALED}, u AS (SELECT l_returnflag, any_value(n) AS n, avg(dx**4 * dy**2) AS u42, avg(dx**2 * dy) AS u21, avg(dx * dy) AS u11, avg(dx**2) AS u20, avg(dy**2) AS u02, avg(dx**3 * dy) AS u31, avg(dx**2 * dy**2) AS u22 FROM d GROUP BY 1)
SELECT l_returnflag, round(1e6 * (u42 - u21 * u21 + 4 * u20 * u11 * u11 + u02 * u20 * u20 + 4 * u11 * u11 * u20 - 4 * u31 * u11 - 2 * u22 * u20) / n, 4) AS value FROM u""")
def _(spark, d):
    return st.mixed_moment_variance(_scaled(spark, d), FLAG, "x", "y", 2, 1).select("l_returnflag", _r(1e6 * F.col("value")).alias("value"))


@_add("moment", f"""WITH {ITEMS} SELECT l_returnflag, round(any_value(mx), 4) AS average, round(avg(power(x - mx, 2)) / 1e4, 2) AS variance, round(avg(power(x - mx, 3)) / power(avg(power(x - mx, 2)), 1.5), 6) AS skewness,
round(avg(power(x - mx, 4)) / power(avg(power(x - mx, 2)), 2) - 3, 6) AS kurtosis, round(sqrt(avg(power(x - mx, 2))), 4) AS stddev, round(avg(abs(x - mx)), 4) AS absdev FROM t JOIN m USING (l_returnflag) GROUP BY 1""")
def _(spark, d):
    m = st.moment(_items(spark, d), FLAG, "x", sample=False)
    return m.select("l_returnflag", _r(F.col("average")).alias("average"), _r(F.col("variance") / 1e4, 2).alias("variance"), *(_r(F.col(c), 6).alias(c) for c in ("skewness", "kurtosis")), *(_r(F.col(c)).alias(c) for c in ("stddev", "absdev")))


@_add("likelihoods", """WITH e AS (SELECT l_returnflag, sum(power(y - x, 2)) AS s, stddev_samp(y - x) AS sd, count(*) AS n FROM (SELECT l_returnflag, l_extendedprice / 1e6 AS x, l_quantity / 700 AS y FROM lineitem) GROUP BY 1)
SELECT l_returnflag, round(-0.5 * s / 4, 6) AS loglikelihood, round(exp(-0.5 * s / 400), 6) AS likelihood, round(sd, 6) AS stddev_new, round(-0.5 * s / (sd * sd) / n, 6) AS per_row, round(exp(-0.5 * s / 400), 6) AS of_stddev FROM e""")
def _(spark, d):
    x, y = F.col("l_extendedprice") / 1e6, F.col("l_quantity") / 700
    out = _t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        st.loglikelihood(x, y, 2.0).alias("a"), st.likelihood(x, y, 20.0).alias("b"), st.loglikelihood_stddev(x, y, 2.0).alias("c"), st.likelihood_stddev(x, y, 20.0).alias("e"), F.count(F.lit(1)).alias("n")
    )
    return out.select("l_returnflag", _r(F.col("a"), 6).alias("loglikelihood"), _r(F.col("b"), 6).alias("likelihood"), _r(F.col("c.stddev_new"), 6).alias("stddev_new"), _r(F.col("c.value_new") / F.col("n"), 6).alias("per_row"), _r(F.col("e.value"), 6).alias("of_stddev"))


@_add("skill_sums", f"""WITH {ITEMS} SELECT l_returnflag, round(sum(abs(y - x)) / 1e6, 4) AS sae, round(sum(power(y - x, 2)) / 1e12, 6) AS sse, round(avg(power(y - x, 2)) / 1e6, 4) AS mse,
round(1 - sqrt(power(0.5 * (1 - corr(x, y)), 2) + power(2 * (1 - any_value(sy / sx)), 2) + power(1 - any_value(my / mx), 2)), 6) AS kge_weighted FROM t JOIN m USING (l_returnflag) GROUP BY 1""")
def _(spark, d):
    x, y = F.col("x"), F.col("y")
    return _items(spark, d).groupBy("l_returnflag").agg(_r(st.sae(x, y) / 1e6).alias("sae"), _r(st.sse(x, y) / 1e12, 6).alias("sse"), _r(st.mse(x, y) / 1e6).alias("mse"), _r(st.kge_weighted(x, y, 0.5, 2.0, 1.0), 6).alias("kge_weighted"))


# sequences

@_add("mad_derivatives", f"""WITH {DAILY}, a AS (SELECT *, lead(q) OVER w - q AS d1, lag(q) OVER w + lead(q) OVER w - 2 * q AS d2, lag(q) OVER w IS NULL AS f, lead(q) OVER w IS NULL AS l FROM s WINDOW w AS (PARTITION BY l_returnflag ORDER BY day)),
c AS (SELECT l_returnflag, median(d1) c1, median(d2) c2 FROM a GROUP BY 1), t AS (SELECT l_returnflag, median(abs(d1 - c1)) * (1.5 / 0.6745) t1, median(abs(d2 - c2)) * (1.5 / 0.6745) t2 FROM a JOIN c USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, day, l OR abs(d1 - c1) <= t1 AS keep1, f OR l OR abs(d2 - c2) <= t2 AS keep2 FROM a JOIN c USING (l_returnflag) JOIN t USING (l_returnflag)""")
def _(spark, d):
    rows = sequence.mad(_daily(spark, d), FLAG, "day", "q", z=1.5, derivative=1, to="keep1")
    return sequence.mad(rows, FLAG, "day", "q", z=1.5, derivative=2, to="keep2").select("l_returnflag", "day", "keep1", "keep2")


@_add("mad_clamp_sides", f"""WITH {DAILY}, c AS (SELECT l_returnflag, median(q) c FROM s GROUP BY 1), t AS (SELECT l_returnflag, median(abs(q - c)) * (1 / 0.6745) t FROM s JOIN c USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, day, round(least(q, c + t), 4) AS upper, round(greatest(q, c - t), 4) AS lower FROM s JOIN c USING (l_returnflag) JOIN t USING (l_returnflag)""")
def _(spark, d):
    rows = sequence.mad_clamp(sequence.mad_clamp(_daily(spark, d), FLAG, "q", 1.0, "u", "upper"), FLAG, "q", 1.0, "l", "lower")
    return rows.select("l_returnflag", "day", _r(F.col("upper")).alias("upper"), _r(F.col("lower")).alias("lower"))


@_add("boxcox_inverse", "SELECT p_partkey, round(p_retailprice, 4) AS x, round(p_retailprice, 4) AS y FROM part")
def _(spark, d):
    x = F.col("p_retailprice")
    return _t(spark, d, "part").select("p_partkey", _r(sequence.inverse_boxcox(sequence.boxcox(x, 0.3), 0.3)).alias("x"), _r(sequence.inverse_boxcox(sequence.boxcox(x, 0), 0)).alias("y"))


@_add("kernel_density_nd", """SELECT ((x - 10) // 15)::INTEGER AS i, round(1e6 * sum(exp(-power((x - p_size) / 5.0, 2) / 2) * exp(-power((x * 20 + 900 - p_retailprice) / 80.0, 2) / 2)) / (count(*) * 5 * 80 * 2 * pi()), 6) AS density FROM part, range(10, 50, 15) t(x) GROUP BY x""")
def _(spark, d):
    points = [(p, p * 20 + 900) for p in range(10, 50, 15)]
    return sequence.kernel_density_nd(_t(spark, d, "part"), ["p_size", "p_retailprice"], [5.0, 80.0], points).select("i", _r(1e6 * F.col("density"), 6).alias("density"))


@_add("silverman", "SELECT round(power(4.0 / 3, 0.2) * power(count(*), -0.2) * stddev_samp(p_retailprice), 6) AS h FROM part")
def _(spark, d):
    return _t(spark, d, "part").agg(_r(sequence.silverman(F.col("p_retailprice")), 6).alias("h"))


# order

@_add("sorted_places", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def _(spark, d):
    return sequence.with_place(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "place")


@_add("ordered", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey")
def _(spark, d):
    return sequence.ordered(_t(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", descending=True)


NTH = "o AS (SELECT p_brand, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"


@_add("nth_with_neighbours", f"WITH {NTH} SELECT p_brand, max(CASE WHEN k = 7 THEN p_size END) AS element, max(CASE WHEN k = 6 THEN p_size END) AS previous, max(CASE WHEN k = 8 THEN p_size END) AS next FROM o WHERE n >= 7 GROUP BY 1")
def _(spark, d):
    return sequence.nth_with_neighbours(_t(spark, d, "part"), ["p_brand"], "p_size", 7)


@_add("nth_index", f"WITH {NTH} SELECT p_brand, p_partkey, p_size AS value FROM o WHERE k = 7")
def _(spark, d):
    return sequence.nth_index(_t(spark, d, "part"), ["p_brand"], "p_size", 7, "p_partkey")


@_add("median_element", f"WITH {NTH} SELECT p_brand, p_partkey, p_size AS value FROM o WHERE k = (n + 1) // 2")
def _(spark, d):
    return sequence.median_element(_t(spark, d, "part"), ["p_brand"], "p_size", "p_partkey")


@_add("distinct_ranked", "SELECT p_brand, p_size AS value, min(p_partkey) AS p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size)::INTEGER AS rank FROM part GROUP BY 1, 2")
def _(spark, d):
    return sequence.distinct_ranked(_t(spark, d, "part"), ["p_brand"], "p_size", "p_partkey")


@_add("distinct_smallest", "SELECT * FROM (SELECT p_brand, p_size AS value, min(p_partkey) AS p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size)::INTEGER AS rank FROM part GROUP BY 1, 2) WHERE rank <= 3")
def _(spark, d):
    return sequence.distinct_ranked(_t(spark, d, "part"), ["p_brand"], "p_size", "p_partkey", 3)


@_add("argmax_ties", "SELECT p_brand, min(p_partkey) FILTER (p_size = hi) AS imax, min(p_partkey) FILTER (p_size = lo) AS imin FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) hi, min(p_size) OVER (PARTITION BY p_brand) lo FROM part) GROUP BY 1")
def _(spark, d):
    return _t(spark, d, "part").groupBy("p_brand").agg(sequence.argmax("p_size", "p_partkey").alias("imax"), sequence.argmin("p_size", "p_partkey").alias("imin"))


@_add("permutation_in_place", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM part")
def _(spark, d):
    rows = sequence.permutation(_t(spark, d, "part").select("p_partkey"), "p_partkey", 1.0, 1, 1)
    return sequence.with_place(rows, "p_partkey", "p_partkey").select("p_partkey", "place")


@_add("append", "SELECT s_suppkey AS key, s_acctbal AS balance, -1 AS size FROM supplier UNION ALL SELECT p_partkey, -1.0, p_size FROM part")
def _(spark, d):
    a, b = _t(spark, d, "supplier").selectExpr("s_suppkey as key", "s_acctbal as balance"), _t(spark, d, "part").selectExpr("p_partkey as key", "p_size as size")
    return sequence.append(a, b, -1)


@_add("paste", "SELECT coalesce(s_suppkey, p_partkey) AS key, coalesce(s_acctbal, -1) AS balance, coalesce(p_size, -1) AS size FROM supplier FULL JOIN part ON s_suppkey = p_partkey")
def _(spark, d):
    a, b = _t(spark, d, "supplier").selectExpr("s_suppkey as key", "s_acctbal as balance"), _t(spark, d, "part").selectExpr("p_partkey as key", "p_size as size")
    return sequence.paste(a, b, "key", -1)


@_add("add_nodata_slice", "SELECT s_suppkey AS key, s_acctbal AS balance FROM supplier UNION ALL SELECT -1 - n_nationkey, -9999.0 FROM nation")
def _(spark, d):
    rows = _t(spark, d, "supplier").selectExpr("s_suppkey as key", "s_acctbal as balance")
    return sequence.add_nodata_slice(rows, _t(spark, d, "nation").selectExpr("cast(-1 - n_nationkey as long) as key"), ["balance"])


# scalars

@_add("float_predicates", """SELECT s_suppkey, x = 1 AS same, x <> 1 AS other, x >= 1 AS least, x <= 1 AS most, x NOT IN (3, 4) AS finite, x = 4 AS nan, x NOT IN (2, 3, 4) AS normal, coalesce(nullif(x, 2), -1)::DOUBLE AS filled FROM (SELECT s_suppkey, (s_suppkey % 5)::DOUBLE AS x FROM supplier)""")
def _(spark, d):
    k = F.col("s_suppkey") % 5
    x = F.when(k == 1, 1.0 + 1e-9).when(k == 3, sc.special_value("inf")).when(k == 4, sc.special_value("nan")).when(k == 2, sc.special_value("subnormal")).otherwise(F.lit(0.0))
    one, whole = F.lit(1.0), k.cast("double")
    near = F.when(k == 1, 1.0 + 1e-9).otherwise(whole)
    return _t(spark, d, "supplier").select("s_suppkey", sc.eq(near, one).alias("same"), sc.ne(near, one).alias("other"), sc.ge(near, one).alias("least"), sc.le(near, one).alias("most"), sc.is_finite(x).alias("finite"), sc.is_nan(x).alias("nan"), sc.is_normal(x).alias("normal"), sc.optval(F.nullif(whole, F.lit(2.0)), -1.0).alias("filled"))


@_add("ranges", "SELECT s_suppkey, round(list_sum(list_transform(range(0, 5), lambda k: 1 + k * (s_nationkey % 3) / 4.0)), 6) AS lin, (SELECT count(*) FROM range(0, 10, 3)) AS steps, least(5, greatest(1, s_nationkey // 5 + 1))::INTEGER AS at FROM supplier")
def _(spark, d):
    n = F.col("s_nationkey")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    by = [sc.linspace(1.0, 1.0 + k, 5) for k in range(3)]
    lin = F.when(n % 3 == 0, total(by[0])).when(n % 3 == 1, total(by[1])).otherwise(total(by[2]))
    return _t(spark, d, "supplier").select("s_suppkey", _r(lin, 6).alias("lin"), F.size(sc.arange(0.0, 10.0, 3.0)).cast("long").alias("steps"), sc.locate(F.array(*(F.lit(float(v)) for v in (0, 5, 10, 15, 20))), n.cast("double")).alias("at"))


@_add("more_strings", r"""SELECT p_partkey, printf('%.2f', p_retailprice) AS price, CASE WHEN p_size > 25 THEN 'T' ELSE 'F' END AS big, list_transform(string_split(p_brand, ''), lambda c: ascii(c))::VARCHAR AS codes, p_brand AS back, true AS same, true AS clean,
lower(p_brand) AS low, upper(p_brand) AS up, strpos(p_name, ' ')::INTEGER AS at, ends_with(p_brand, '1') AS one, false AS blank FROM part""")
def _(spark, d):
    b = F.col("p_brand")
    codes = sc.to_codes(b)
    return _t(spark, d, "part").select(
        "p_partkey", sc.to_text(F.col("p_retailprice"), 2).alias("price"), sc.truth_to_text(F.col("p_size") > 25).alias("big"), F.concat(F.lit("["), F.array_join(codes.cast("array<string>"), ", "), F.lit("]")).alias("codes"), sc.from_codes(codes).alias("back"),
        sc.equal_strings(b, F.concat(b, F.lit("  "))).alias("same"), sc.no_null(b).alias("clean"), sc.to_lower(b).alias("low"), sc.to_upper(b).alias("up"), F.instr("p_name", " ").alias("at"), sc.ends_with(b, "1").alias("one"), sc.is_blank(b).alias("blank"),
    )


@_add("more_dates", """SELECT o_orderkey, make_timestamp(2001, month(o_orderdate), 1, 6, 0, 0) AS replaced, date_diff('second', TIMESTAMP '1992-01-01', o_orderdate)::BIGINT AS seconds, o_orderdate + INTERVAL 90061 SECOND AS later,
round(date_diff('second', TIMESTAMP '1992-01-01', o_orderdate) * 1.5)::BIGINT AS longer, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, (date_trunc('week', o_orderdate) + INTERVAL 7 DAY)::TIMESTAMP AS next_week, (month(o_orderdate) = 1 AND day(o_orderdate) = 1) AS new_year FROM orders""")
def _(spark, d):
    t, start = F.col("o_orderdate"), F.lit("1992-01-01 00:00:00").cast("timestamp_ntz")
    gap = sc.delta(sc.seconds_between(start, t))
    return _t(spark, d, "orders").select(
        "o_orderkey", sc.replace_parts(t, year=2001, day=1, hour=6, minute=0, second=0).alias("replaced"), sc.delta_seconds(gap).alias("seconds"), sc.add_delta(t, sc.delta(F.lit(90061))).alias("later"),
        sc.delta_seconds(sc.scale_delta(gap, 1.5)).alias("longer"), sc.previous_new(t, "month").alias("month_start"), sc.next_new(t, "week").alias("next_week"), (sc.is_new(t, "year")).alias("new_year"),
    )


@_add("fractional_days", """SELECT event_id, (julian(ts::DATE)::BIGINT * 86400 + epoch_us(ts) // 1000000 % 86400 - 43200)::BIGINT AS seconds, year(ts)::INTEGER AS y, month(ts)::INTEGER AS m, day(ts)::INTEGER AS d, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS n,
date_diff('day', DATE '1900-01-01', ts::DATE)::BIGINT AS since_1900, ((year(ts) * 360 + (month(ts) - 1) * 30 + day(ts) - 1) * 86400 + epoch_us(ts) // 1000000 % 86400 - 43200)::BIGINT AS seconds_360 FROM events""")
def _(spark, d):
    t = F.col("ts")
    parts = [F.year(t), F.month(t), F.day(t), F.hour(t), F.minute(t), F.second(t)]
    n = sc.fractional_day(*parts)
    back = F.col("back")
    return _t(spark, d, "events").withColumn("back", sc.from_fractional_day(n)).select("event_id", F.round(n * 86400).cast("long").alias("seconds"), *(back[k].alias(a) for k, a in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"), ("minute", "n"))), sc.days_since_1900(*parts[:3]).cast("long").alias("since_1900"), F.round(sc.fractional_day(*parts, calendar="360_day") * 86400).cast("long").alias("seconds_360"))


@_add("cf_times", "SELECT o_orderkey, date_diff('hour', TIMESTAMP '1990-01-01 06:00:00', o_orderdate)::DOUBLE AS hours, o_orderdate AS back FROM orders")
def _(spark, d):
    units = "hours since 1990-01-01 06:00"
    n = timeaxis.encode_time(F.col("o_orderdate"), units)
    return _t(spark, d, "orders").select("o_orderkey", n.cast("double").alias("hours"), timeaxis.decode_time(n, units).alias("back"))


@_add("time_bounds", """WITH t AS (SELECT DISTINCT date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS v FROM orders) SELECT v, coalesce(lag(v) OVER (ORDER BY v), v - (SELECT b - a FROM (SELECT min(v) a FROM t), (SELECT v b FROM t ORDER BY v LIMIT 1 OFFSET 1))) AS lower, v AS upper FROM t""")
def _(spark, d):
    days = _t(spark, d, "orders").select(F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("v")).distinct()
    return timeaxis.infer_bounds(days, [], "v", "end").select("v", "lower", "upper")


@_add("time_steps", "SELECT s_nationkey, CASE s_nationkey % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'hourly' WHEN 2 THEN 'monthly' WHEN 3 THEN 'yearly' ELSE '6' END AS step FROM supplier GROUP BY 1")
def _(spark, d):
    keys = _t(spark, d, "supplier").select("s_nationkey").distinct()
    k = F.col("s_nationkey") % 5
    start = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    rows = keys.select("s_nationkey", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")).withColumn(
        "ts", F.when(k == 0, start + F.make_dt_interval("n")).when(k == 1, start + F.make_dt_interval(F.lit(0), F.col("n"))).when(k == 2, F.add_months(start, F.col("n")).cast("timestamp_ntz")).when(k == 3, F.add_months(start, 12 * F.col("n")).cast("timestamp_ntz")).otherwise(start + F.make_dt_interval(F.lit(0), 6 * F.col("n")))
    )
    return timeaxis.infer_step(rows, ["s_nationkey"], "ts")


@_add("polynomial_roots", "SELECT p_partkey, round(sqrt(p_size), 6) AS newton, round(sqrt(p_size), 6) AS halley, round(sqrt(p_size), 6) AS householder, 2 AS \"order\" FROM part")
def _(spark, d):
    c = F.array(-F.col("p_size").cast("double"), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    one = lambda m: _r(sc.root(c, F.col("p_size").cast("double"), method=m), 6)
    return _t(spark, d, "part").select("p_partkey", one("newton").alias("newton"), one("halley").alias("halley"), one("cubic").alias("householder"), sc.order(c).alias("order"))


@_add("poles", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN x - 180 ELSE 180 - x END AS shifted, 7 AS corners, round(80 + y + (180 - x) / (360 - 2 * x) * 2.0, 6) AS cut FROM (SELECT p_partkey, p_size, 100.0 + p_size AS x, p_size / 10.0 AS y FROM part)")
def _(spark, d):
    x, y = 100.0 + F.col("p_size"), F.col("p_size") / 10.0
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    shape = F.array(corner(x, 80 + y), corner(-x, 82 + y), corner(F.lit(0), F.lit(80)))
    closed = sc.with_pole(shape)
    return _t(spark, d, "part").select("p_partkey", sc.shifted_longitude(F.when(F.col("p_size") % 2 == 0, x).otherwise(-x)).alias("shifted"), F.size(closed).alias("corners"), _r(F.element_at(closed, 2)["y"], 6).alias("cut"))


@_add("random_numbers", "SELECT true AS inside, 0.5::DOUBLE AS mean, 0.3::DOUBLE AS spread, 1.0::DOUBLE AS normal_spread, count(*) AS n FROM lineitem")
def _(spark, d):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    u, g = sc.hashed_uniform(key, 7), sc.hashed_gaussian(key, 7)
    return _t(spark, d, "lineitem").agg(((F.min(u) >= 0) & (F.max(u) < 1)).alias("inside"), _r(F.avg(u), 1).alias("mean"), _r(F.stddev_samp(u), 1).alias("spread"), _r(F.stddev_samp(g), 1).alias("normal_spread"), F.count(F.lit(1)).alias("n"))


# calibration

LINE = "SELECT round(sqrt(avg(power(y - (regr.a + regr.b * x), 2))), 2) AS cost FROM (SELECT l_extendedprice / 1e4 AS y, l_quantity / 10 AS x FROM lineitem), (SELECT regr_intercept(l_extendedprice / 1e4, l_quantity / 10) AS a, regr_slope(l_extendedprice / 1e4, l_quantity / 10) AS b FROM lineitem) regr"


def _line(spark, d):
    data = _t(spark, d, "lineitem").select((F.col("l_extendedprice") / 1e4).alias("y"), (F.col("l_quantity") / 10).alias("x"))
    return calibrate.summary_objective(data, ["x"], "y", lambda p, x: p[0] + p[1] * x[:, 0])


SEARCHES = {
    "nelder_mead": lambda f: calibrate.nelder_mead(f, [0.0, 0.1], step=0.5),
    "dds": lambda f: calibrate.dds(f, [0.0, 0.1], [-20, -20], [20, 20], 20000),
    "mdds": lambda f: calibrate.mdds(f, [0.0, 0.1], [-20, -20], [20, 20], 8000),
    "anneal": lambda f: calibrate.anneal(f, [0.0, 0.1], [-20, -20], [20, 20], 20000, temperature=calibrate.initial_temperature(f, [0.0, 0.1], [-20, -20], [20, 20])),
    "sce": lambda f: calibrate.sce(f, [-20, -20], [20, 20]),
}
for _name, _search in SEARCHES.items():

    @_add(f"calibrate_{_name}", LINE)
    def _(spark, d, search=_search):
        """The least root mean square error of a straight line, which the search must reach to two decimals."""
        return spark.createDataFrame([(round(float(search(_line(spark, d))[1]), 2),)], "cost double")


@_add("calibrate_mcmc", "SELECT round(regr_slope(l_extendedprice / 1e4, l_quantity / 10), 1) + 0.0 AS slope, true AS agree FROM lineitem")
def _(spark, d):
    cost = _line(spark, d)
    chains = calibrate.mcmc(spark, lambda p: -0.5 * 4000 * float(cost(np.array([p]))[0]) ** 2, [0.0, 1.0], [-20, -20], [20, 20], chains=3, burn_in=2000, samples=4000)
    slope = chains.agg((_r(F.avg(F.col("parameters")[1]), 1) + 0.0).alias("slope"))
    return slope.crossJoin(F.broadcast(calibrate.convergence(chains, 2).agg((F.max("r") < 1.2).alias("agree"))))


@_add("cubic_cost", "SELECT round(avg(abs(y - (2 * x * x * x + 20 * x * x + 3 * x + 1))), 6) AS cost, round(0.025 * 20, 4)::DOUBLE AS low, 80.0::DOUBLE AS high FROM (VALUES (0.5, 5.725), (1.0, 21.7), (1.5, 49.175), (2.0, 88.9), (2.5, 141.625), (3.0, 208.1)) t(x, y)")
def _(spark, d):
    p = [2.0, 20.0, 3.0, 1.0]
    return spark.createDataFrame([(round(float(calibrate.cubic_cost(np.array([p]))[0]), 6), calibrate.cubic_range(p, 0)[0], calibrate.cubic_range(p, 1)[1])], "cost double, low double, high double")


# user-defined functions and streams

@_add("registered_functions", f"WITH {ITEMS} SELECT l_returnflag, round(1 - sqrt(power(1 - any_value(my / mx), 2) + power(1 - any_value(sy / sx), 2) + power(1 - corr(x, y), 2)), 6) AS kge, round(1 - sum(power(y - x, 2)) / sum(power(x - mx, 2)), 6) AS nse FROM t JOIN m USING (l_returnflag) GROUP BY 1")
def _(spark, d):
    registry.register_all(spark)
    _items(spark, d).createOrReplaceTempView("gridbrook_items")
    return spark.sql("select l_returnflag, round(kge(x, y), 6) as kge, round(nse(x, y), 6) as nse from gridbrook_items group by l_returnflag")


@_add("registered_table_function", "SELECT (k + 1)::INTEGER AS t, k * 3600 AS lower, (k + 1) * 3600 AS upper FROM range(48) r(k)")
def _(spark, d):
    registry.register_all(spark)
    return spark.sql("select t, lower, upper from time_axis(0, 3600, 48)")


@_add("stream_daily", """WITH w AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS lower, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM w""")
def _(spark, d):
    """All windows of a stream that has ended: complete mode, so that no window waits for the watermark."""
    from gridbrook.operators.tables import new_path

    folder = new_path(spark, "stream")
    _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    name = "stream_" + folder.rsplit("-", 1)[1]
    windows.aggregate(stream, "ts", "value", ["event_type"]).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("event_type", F.col("lower").cast("timestamp_ntz").alias("lower"), "n", _r(F.col("total")).alias("total"))


@_add("stream_recession", f"""WITH RECURSIVE {DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY day) AS k FROM s),
r AS (SELECT l_returnflag, day, k, 0.3 * q AS state FROM k WHERE k = 1 UNION ALL SELECT k.l_returnflag, k.day, k.k, 0.7 * r.state + 0.3 * k.q FROM r JOIN k ON k.l_returnflag = r.l_returnflag AND k.k = r.k + 1)
SELECT l_returnflag, day, round(state, 6) AS state FROM r""")
def _(spark, d):
    from gridbrook.operators.tables import new_path

    folder = new_path(spark, "stream")
    _daily(spark, d).coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    windows.run_once(windows.recession(stream, FLAG, "day", "q", 0.7, 0.3), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("l_returnflag", "day", _r(F.col("state"), 6).alias("state"))


# analytic test functions

AB = "(SELECT s_suppkey, s_nationkey / 7.3 - 2 AS a, s_suppkey % 11 / 3.7 - 1 AS b, s_suppkey % 7 / 3.1 - 1 AS c, s_nationkey % 5 / 1.9 - 1 AS d FROM supplier)"
TWO = {
    "beale": "power(1.5 - a + a * b, 2) + power(2.25 - a + a * b * b, 2) + power(2.625 - a + a * b * b * b, 2)", "matyas": "0.26 * (a * a + b * b) - 0.48 * a * b", "leon_cubic_valley": "100 * power(b - a * a * a, 2) + power(1 - a, 2)",
    "bohachevsky1": "a * a + 2 * b * b - 0.3 * cos(3 * pi() * a) - 0.4 * cos(4 * pi() * b) + 0.7", "bohachevsky2": "a * a + 2 * b * b - 0.3 * cos(3 * pi() * a) * cos(4 * pi() * b) + 0.3", "bohachevsky3": "a * a + 2 * b * b - 0.3 * cos(3 * pi() * a + 4 * pi() * b) + 0.3",
    "schaffer_f6": "0.5 + (power(sin(sqrt(a * a + b * b)), 2) - 0.5) / power(1 + 0.001 * (a * a + b * b), 2)", "drop_wave": "-(1 + cos(12 * sqrt(a * a + b * b))) / (0.5 * (a * a + b * b) + 2)", "griewank": "(a * a + b * b) / 200 - cos(a) * cos(b / sqrt(2)) + 1",
    "hump": "1.0316285 + 4 * a * a - 2.1 * power(a, 4) + power(a, 6) / 3 + a * b - 4 * b * b + 4 * power(b, 4)", "shubert": "(cos(2 * a + 1) + 2 * cos(3 * a + 2) + 3 * cos(4 * a + 3) + 4 * cos(5 * a + 4) + 5 * cos(6 * a + 5)) * (cos(2 * b + 1) + 2 * cos(3 * b + 2) + 3 * cos(4 * b + 3) + 4 * cos(5 * b + 4) + 5 * cos(6 * b + 5)) + 186.7309088310",
    "levy": "power(sin(pi() * (3 + a) / 4), 2) + power((a - 1) / 4, 2) * (1 + 10 * power(sin(pi() * (3 + a) / 4 + 1), 2)) + power((b - 1) / 4, 2) * (1 + power(sin(2 * pi() * (3 + b) / 4), 2))", "quartic": "power(a, 4) + 2 * a * a + a + 3", "oscillatory_parabola": "a * a - 10 * sin(a * a - 3 * a + 2) + 9.9779149346",
    "cosine_combo": "cos(a) + 5 * cos(1.6 * a) - 2 * cos(2 * a) + 5 * cos(4.5 * a) + 7 * cos(9 * a) + 14.6771885214", "penalty1": "0.00001 * (power(a - 1, 2) + power(b - 1, 2)) + power(a * a + b * b - 0.25, 2)",
    "schwefel": "-a * sin(sqrt(abs(a))) - b * sin(sqrt(abs(b))) + 837.9657745448676", "hilbert": "a * a + a * b + b * b / 3", "rotated_hyper_ellipsoid": "a * a + power(a + b, 2)", "axis_parallel_hyper_ellips": "a * a + 2 * b * b",
}
FOUR = {
    "wood": "100 * power(b - a * a, 2) + power(1 - a, 2) + 90 * power(d - c * c, 2) + power(1 - c, 2) + 10 * power(b + d - 2, 2) + 0.1 * power(b - d, 2)",
    "colville_polynomial": "100 * power(b - a * a, 2) + power(1 - a, 2) + 90 * power(d - c * c, 2) + power(1 - c, 2) + 10.1 * (power(b - 1, 2) + power(d - 1, 2)) + 19.8 * (b - 1) * (d - 1)",
    "ext_powell_singular_quartic": "power(a + 10 * b, 2) + 5 * power(c - d, 2) + power(b - 2 * c, 4) + 10 * power(a - d, 4)",
    "shekel_sqrn5": "10.1527236935 - 1 / (0.1 + power(a - 4, 2) + power(b - 4, 2) + power(c - 4, 2) + power(d - 4, 2)) - 1 / (0.2 + power(a - 1, 2) + power(b - 1, 2) + power(c - 1, 2) + power(d - 1, 2)) - 1 / (0.2 + power(a - 8, 2) + power(b - 8, 2) + power(c - 8, 2) + power(d - 8, 2)) - 1 / (0.4 + power(a - 6, 2) + power(b - 6, 2) + power(c - 6, 2) + power(d - 6, 2)) - 1 / (0.6 + power(a - 3, 2) + power(b - 7, 2) + power(c - 3, 2) + power(d - 7, 2))",
    "gregory_karney_tridia_matrix": "a * a + 2 * (b * b + c * c + d * d) - 2 * (a * b + b * c + c * d) - 2 * a + 4",
    "trigonometric": "power(5 - sin(a) - (cos(a) + cos(b) + cos(c) + cos(d)) - cos(a), 2) + power(6 - sin(b) - (cos(a) + cos(b) + cos(c) + cos(d)) - 2 * cos(b), 2) + power(7 - sin(c) - (cos(a) + cos(b) + cos(c) + cos(d)) - 3 * cos(c), 2) + power(8 - sin(d) - (cos(a) + cos(b) + cos(c) + cos(d)) - 4 * cos(d), 2)",
    "variably_dimensioned": "power(a - 1 + 2 * (b - 1) + 3 * (c - 1) + 4 * (d - 1), 2) * (1 + power(a - 1 + 2 * (b - 1) + 3 * (c - 1) + 4 * (d - 1), 2)) + power(a - 1, 2) + power(b - 1, 2) + power(c - 1, 2) + power(d - 1, 2)",
}


def _functions(name: str, table: dict, width: int) -> None:
    @_add(name, f"SELECT s_suppkey, {', '.join(f'round(({sql})::DOUBLE, 7) AS {k}' for k, sql in table.items())} FROM {AB}")
    def run(spark, d):
        from gridbrook.functions import test_functions

        k, n = F.col("s_suppkey"), F.col("s_nationkey")
        xs = [n / 7.3 - 2, k % 11 / 3.7 - 1, k % 7 / 3.1 - 1, n % 5 / 1.9 - 1][:width]
        every = test_functions.register()
        return _t(spark, d, "supplier").select("s_suppkey", *(_r(every[f](xs), 7).alias(f) for f in table))


_functions("test_functions_of_two", TWO, 2)
_functions("test_functions_of_four", FOUR, 4)
