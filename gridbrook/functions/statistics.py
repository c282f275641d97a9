"""Statistics as aggregate columns: use them in ``groupBy(...).agg(...)``.

Masks are nulls.  Sample moments divide by n - 1; covariance divides by n.  A group with too few values gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridbrook.operators.tables import join_by, running_sum, save


def masked(x: Column, mask: Column) -> Column:
    return F.when(mask, x)


def _n(x):
    return F.count(x)


def variance(x):
    return F.var_samp(x)


def skewness(x):
    n = _n(x)
    return F.when(n > 1, F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5)))


def kurtosis(x):
    n = _n(x)
    return F.when(n > 1, (F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3)


def covariance(x, y):
    return F.covar_pop(x, y)


def correlation(x, y):
    """Population covariance over sample deviations: Pearson's r times (n - 1) / n."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    return F.corr(x, y) * (n - 1) / n


def with_means(df: DataFrame, by: list[str], **columns: str) -> DataFrame:
    """``df`` with group means in new columns, by a join of the aggregate: no window over whole groups."""
    means = df.groupBy(*by).agg(*(F.avg(c).alias(k) for k, c in columns.items()))
    return join_by(df, means, by)


def absdev(df: DataFrame, by: list[str], x: str) -> DataFrame:
    return with_means(df, by, __m=x).groupBy(*by).agg(F.avg(F.abs(F.col(x) - F.col("__m"))).alias("absdev"))


def central_moments(df: DataFrame, by: list[str], x: str, orders: list[int]) -> DataFrame:
    """m<r> for each order: 0 for a negative one, 1 for 0, else the mean power of deviations, null for fewer than three values."""
    d = F.col(x) - F.col("__m")
    one = lambda r: F.lit(0.0) if r < 0 else F.lit(1.0) if r == 0 else F.when(F.count(x) > 2, F.avg(F.pow(d, F.lit(r))))
    return with_means(df, by, __m=x).groupBy(*by).agg(*(one(r).alias(f"m{r}") for r in orders))


def central_moment_variance(df: DataFrame, by: list[str], x: str, r: int) -> DataFrame:
    """Sampling variance of the r-th central moment."""
    m = central_moments(df, by, x, sorted({2, r - 1, r, r + 1, 2 * r}))
    n = df.groupBy(*by).agg(F.count(x).alias("n"))
    c = lambda k: F.lit(1.0) if k == 0 else F.lit(0.0) if k == 1 else F.col(f"m{k}")
    value = (c(2 * r) - c(r) * c(r) + r * r * c(r - 1) * c(r - 1) * c(2) - 2 * r * c(r + 1) * c(r - 1)) / F.col("n")
    rows = join_by(m, n, by)
    return rows.select(*by, value.alias("value"))


def mixed_moment(df: DataFrame, by: list[str], x: str, y: str, r: int, s: int) -> DataFrame:
    rows = with_means(df, by, __mx=x, __my=y)
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col(x) - F.col("__mx"), F.lit(r)) * F.pow(F.col(y) - F.col("__my"), F.lit(s))).alias("value"))


def mixed_moment_variance(df: DataFrame, by: list[str], x: str, y: str, r: int, s: int) -> DataFrame:
    """Sampling variance of the mixed central moment of orders r and s, null for fewer than three pairs."""
    rows = with_means(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, __mx=x, __my=y)
    dx, dy = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    u = lambda p, q: F.avg(F.pow(dx, F.lit(p)) * F.pow(dy, F.lit(q))) if min(p, q) >= 0 else F.lit(0.0)
    value = u(2 * r, 2 * s) - F.pow(u(r, s), 2) + r * r * u(2, 0) * F.pow(u(r - 1, s), 2) + s * s * u(0, 2) * F.pow(u(r, s - 1), 2)
    value = value + 2.0 * r * s * u(1, 1) * u(r - 1, s) * u(r, s - 1) - 2.0 * r * u(r + 1, s) * u(r - 1, s) - 2.0 * s * u(r, s + 1) * u(r, s - 1)
    return rows.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 2, value / F.count(F.lit(1))).alias("value"))


def moment(df: DataFrame, by: list[str], x: str, sample: bool = True) -> DataFrame:
    """average, variance, skewness, kurtosis, mean, stddev, absdev in one row a group; without ``sample`` variance divides by n."""
    rows = with_means(df, by, __m=x)
    c, n = F.col(x), F.count(x)
    spread = F.var_samp(c) if sample else F.var_pop(c)
    skew, kurt = (skewness(c), kurtosis(c)) if sample else (F.skewness(c), F.kurtosis(c))
    return rows.groupBy(*by).agg(
        F.avg(c).alias("average"), F.when(n > 1, spread).alias("variance"), F.when(n > 1, skew).alias("skewness"), F.when(n > 1, kurt).alias("kurtosis"),
        F.avg(c).alias("mean"), F.when(n > 1, F.sqrt(spread)).alias("stddev"), F.when(n > 1, F.avg(F.abs(c - F.col("__m")))).alias("absdev"),
    )


# skill of simulations y against observations x, over rows where both are known

def _pair(x, y):
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def bias(x, y):
    x, y = _pair(x, y)
    return F.avg(y) - F.avg(x)


def mae(x, y):
    return F.avg(F.abs(y - x))


def sae(x, y):
    return F.sum(F.abs(y - x))


def mse(x, y):
    return F.avg((y - x) * (y - x))


def sse(x, y):
    return F.sum((y - x) * (y - x))


def rmse(x, y):
    return F.sqrt(mse(x, y))


def nse(x, y):
    x, y = _pair(x, y)
    return 1 - F.sum((y - x) * (y - x)) / F.nullif(F.var_pop(x) * F.count(x), F.lit(0.0))


TINY = 2.2250738585072014e-308


def lnnse(x, y):
    ok = (x >= TINY) & (y >= TINY)
    return nse(F.ln(F.when(ok, x)), F.ln(F.when(ok, y)))


def wnse(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Nash-Sutcliffe efficiency with the observations as weights."""
    rows = with_means(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, __m=x)
    d, o = F.col(y) - F.col(x), F.col(x) - F.col("__m")
    return rows.groupBy(*by).agg((1 - F.sum(F.col(x) * d * d) / F.sum(F.col(x) * o * o)).alias("wnse"))


def _kge(x, y, variability: str, sr: float, sa: float, sb: float):
    x, y = _pair(x, y)
    b = F.avg(y) / F.avg(x)
    a = F.stddev_samp(y) / F.stddev_samp(x) if variability == "sd" else (F.stddev_samp(y) / F.avg(y)) / (F.stddev_samp(x) / F.avg(x))
    r = F.corr(x, y) if sr else F.lit(1.0)
    return 1 - F.sqrt(F.pow(sr * (1 - r), F.lit(2)) + F.pow(sa * (1 - a), F.lit(2)) + F.pow(sb * (1 - b), F.lit(2)))


def kge(x, y):
    return _kge(x, y, "sd", 1, 1, 1)


def kge_no_correlation(x, y):
    return _kge(x, y, "sd", 0, 1, 1)


def kge_prime(x, y):
    return _kge(x, y, "cv", 1, 1, 1)


def kge_weighted(x, y, sr, sa, sb):
    return _kge(x, y, "sd", sr, sa, sb)


def categorical_agreement(x, y):
    return F.avg((x == y).cast("double"))


def average_rank(df: DataFrame, by: list[str], x: str, to: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean rank, null for a null value: counts of values, then places, then a join back."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("__n"))
    up = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(to, F.coalesce(F.sum("__n").over(up), F.lit(0)) + (F.col("__n") + 1) / 2).drop("__n")
    return join_by(df, ranks, [*by, x], "left")


def _steps(rows: DataFrame, by: list[str], c: str) -> DataFrame:
    """(by, value, first and last place) of each distinct value: a sorted series of counts."""
    counts = rows.groupBy(*by, F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # read twice, and few values' ranks are broadcast to the rows
    return save(running_sum(counts, by, "v", "n", "last").withColumn("first", F.col("last") - F.col("n") + 1), "steps")


#: Places of a sorted series that one task walks along.
STRETCH = 1 << 18


def _runs(ends: DataFrame, by: list[str]) -> DataFrame:
    """(by, last, x, y, k): the stretches of places on which both sorted series are constant, out of their run ends.

    The value of the run that holds a place is that of the next end.  A series is cut into stretches of STRETCH places;
    each one gets the first values known behind it and the last end before it.
    """
    cut = ends.withColumn("__b", F.floor((F.col("last") - 1) / STRETCH))
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("last")))
    heads = cut.groupBy(*by, "__b").agg(known("x").alias("__x"), known("y").alias("__y"), F.max("last").alias("__to"))
    behind = Window.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    beside = heads.select(*by, "__b", *(F.last(c, True).over(behind).alias(c) for c in ("__x", "__y")), F.lead("__to").over(Window.partitionBy(*by).orderBy(F.desc("__b"))).alias("__from"))
    inside = Window.partitionBy(*by, "__b").orderBy(F.desc("last"))
    back = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = cut.select(*by, "__b", "last", *(F.last(c, True).over(back).alias(c) for c in ("x", "y")), F.lead("last").over(inside).alias("__before"))
    value = lambda c: F.coalesce(c, f"__{c}").alias(c)
    return join_by(own, beside, [*by, "__b"]).select(*by, "last", value("x"), value("y"), (F.col("last") - F.coalesce("__before", "__from", F.lit(0))).alias("k"))


def kge_np(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Non-parametric KGE: rank correlation and the distance of the sorted, scaled series.

    Values are counted first.  Ranks come from the counts, and the two sorted series are read as runs of equal values:
    between two neighbouring run ends of either series both are constant.  A large group is shared by many tasks.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    sx, sy = _steps(rows, by, "x"), _steps(rows, by, "y")
    mean = lambda s, c: s.select(*by, F.col("v").alias(c), ((F.col("first") + F.col("last")) / 2).alias(f"r{c}"))
    ranked = join_by(join_by(rows, mean(sx, "x"), [*by, "x"]), mean(sy, "y"), [*by, "y"])
    head = ranked.groupBy(*by).agg(F.corr("rx", "ry").alias("r"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("n"))
    ends = sx.select(*by, "last", F.col("v").alias("x"), F.lit(None).cast("double").alias("y")).unionByName(sy.select(*by, "last", F.lit(None).cast("double").alias("x"), F.col("v").alias("y")))
    ends = ends.groupBy(*by, "last").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    joined = join_by(_runs(ends, by), head, by)
    alpha = joined.groupBy(*by, "r", "mx", "my").agg((1 - 0.5 * F.sum(F.col("k") * F.abs(F.col("y") / (F.col("n") * F.col("my")) - F.col("x") / (F.col("n") * F.col("mx"))))).alias("a"))
    return alpha.select(*by, (1 - F.sqrt(F.pow(1 - F.col("a"), 2) + F.pow(1 - F.col("my") / F.col("mx"), 2) + F.pow(1 - F.col("r"), 2))).alias("kge_np"))


def bin_of(x: Column, bins: int, low: float, high: float) -> Column:
    """Histogram bin from 1; values out of range go to the outer bins."""
    return F.least(F.lit(bins), F.greatest(F.lit(1), (F.floor((x - low) / ((high - low) / bins)) + 1).cast("int")))


def histogram(df: DataFrame, x: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) for every bin."""
    counts = df.where(F.col(x).isNotNull()).groupBy(bin_of(F.col(x), bins, low, high).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0, ["n"])


def spaef(df: DataFrame, x: str, y: str, mask: str | None = None, histogram_masked_out: bool = True, bins: int = 100) -> DataFrame:
    """Spatial efficiency: correlation, ratio of variation, overlap of histograms of z-scores on [-6, 6].

    Means, deviations and correlation use rows with a true ``mask``; the histograms all rows, unless
    ``histogram_masked_out`` is false.
    """
    ok = F.lit(True) if mask is None else F.col(mask)
    mx, my = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    head = df.agg(F.avg(mx).alias("mx"), F.avg(my).alias("my"), F.stddev_samp(mx).alias("sx"), F.stddev_samp(my).alias("sy"), F.corr(mx, my).alias("r"))
    rows = (df if histogram_masked_out else df.where(ok)).crossJoin(F.broadcast(head))
    z = rows.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), ((F.col(x) - F.col("mx")) / F.col("sx")).alias("z")), F.struct(F.lit(1).alias("s"), ((F.col(y) - F.col("my")) / F.col("sy")).alias("z")))).alias("v"))
    bars = z.groupBy(bin_of(F.col("v.z"), bins, -6.0, 6.0).alias("b")).agg(F.sum(F.when(F.col("v.s") == 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("v.s") == 1, 1).otherwise(0)).alias("q"))
    overlap = bars.agg((F.sum(F.least("p", "q")) / F.sum("p")).alias("g"))
    b = (F.col("sy") / F.col("my")) / (F.col("sx") / F.col("mx"))
    return head.crossJoin(overlap).select((1 - F.sqrt(F.pow(F.col("r") - 1, 2) + F.pow(b - 1, 2) + F.pow(F.col("g") - 1, 2))).alias("spaef"))


def percentiles(df: DataFrame, by: list[str], x: str, k: float, mode: int = 1) -> DataFrame:
    """k-th percentile of each group by one of eight rules for its place among the sorted values.

    Equal values are counted first and places found by a running count, so no group is held in memory.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    up = Window.partitionBy(*by).orderBy("__x")
    rows = counts.withColumn("__to", F.sum("__c").over(up)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*by)))
    n, p = F.col("__n"), k / 100
    if mode == 1:
        place = F.ceil(n * F.lit(p) - 1e-9).cast("double")
    else:
        place = {2: n * p, 3: F.round(n * p), 4: 0.5 + n * p, 5: (n + 1) * p, 6: (n - 1) * p + 1, 7: 1 / 3 + (n + 1 / 3) * p, 8: 3 / 8 + (n + 1 / 4) * p}[mode]
    low = F.least(n, F.greatest(F.lit(1), F.floor(place)))
    high = F.least(n, F.greatest(F.lit(1), F.ceil(place)))
    to, start = F.col("__to"), F.col("__to") - F.col("__c")
    held = lambda at: F.max(F.when((start < at) & (at <= to), F.col("__x")))
    out = rows.groupBy(*by).agg(held(low).alias("__a"), held(high).alias("__b"), F.max(place - low).alias("__w"), F.max((low == high).cast("int")).alias("__same"))
    return out.select(*by, F.when(F.col("__same") == 1, F.col("__a")).otherwise(F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__w")).alias("percentile"))


def linfit(x, y, model2: bool = False):
    """struct(a, b, siga, sigb, chi2) of y = a + b x; model II takes the ratio of deviations as slope."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    x, y = _pair(x, y)
    b = F.signum(F.covar_pop(x, y)) * F.stddev_pop(y) / F.stddev_pop(x) if model2 else F.covar_pop(x, y) / F.var_pop(x)
    a = F.avg(y) - b * F.avg(x)
    chi2 = n * (F.var_pop(y) - 2 * b * F.covar_pop(x, y) + b * b * F.var_pop(x))
    sxx, syy, sxy = n * F.var_pop(x), n * F.var_pop(y), n * F.covar_pop(x, y)
    # both models take the scatter about the ordinary line; model II adds that of x about its own line to the error of a
    scatter = F.abs(syy - sxy * sxy / sxx) / (n - 2)
    siga2 = scatter * (1 / n + F.avg(x) * F.avg(x) / sxx)
    if model2:
        siga2 = siga2 + b * b * F.abs(sxx - sxy * sxy / syy) / (n - 2) / n
    return F.struct(a.alias("a"), b.alias("b"), F.sqrt(siga2).alias("siga"), F.sqrt(scatter / sxx).alias("sigb"), chi2.alias("chi2"))


def loglikelihood(x, y, sigma):
    """Of errors y - x with a given standard deviation."""
    return -0.5 * F.sum(F.pow((y - x) / sigma, 2))


def likelihood(x, y, sigma):
    return F.exp(loglikelihood(x, y, sigma))


def loglikelihood_stddev(x, y, sigma):
    """struct(value with ``sigma``, stddev of the errors, value with that)."""
    e, own = y - x, F.stddev_samp(y - x)
    return F.struct(loglikelihood(x, y, sigma).alias("value"), own.alias("stddev_new"), (-0.5 * F.sum(e * e) / F.nullif(own * own, F.lit(0.0))).alias("value_new"))


def likelihood_stddev(x, y, sigma):
    found = loglikelihood_stddev(x, y, sigma)
    return F.struct(F.exp(found["value"]).alias("value"), found["stddev_new"].alias("stddev_new"), F.exp(found["value_new"]).alias("value_new"))
