"""Operators on ordered sequences: running sums, outliers, scores, baseflow, kernels, ranks and top-k."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridbrook.functions.statistics import percentiles
from gridbrook.operators.calibrate import nelder_mead
from gridbrook.operators.tables import join_by, placed

#: Rows of a series that are folded as one array.
FOLD = 64


def _ordered(by, at):
    return Window.partitionBy(*by).orderBy(at)


def cumsum(df: DataFrame, by: list[str], at: str, x: str, to: str = "cumsum") -> DataFrame:
    """Running sum within each series."""
    return df.withColumn(to, F.sum(x).over(_ordered(by, at).rowsBetween(Window.unboundedPreceding, 0)))


def global_cumsum(df: DataFrame, at: str, x: str, to: str = "cumsum", block: int = 65536) -> DataFrame:
    """Running sum over one long series with a dense integer ``at``: sums of blocks, then sums within them."""
    rows = df.withColumn("__block", F.floor(F.col(at) / block))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__block").agg(F.sum(x).alias("__s")).select("__block", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    inside = F.sum(x).over(_ordered(["__block"], at).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(to, inside).join(starts, "__block").withColumn(to, F.col(to) + F.col("__start")).drop("__block", "__start")


def prefix_sum(df: DataFrame, by: list[str], at: str, x: str, shift: int = 1, start: float = 0, to: str = "prefix_sum") -> DataFrame:
    """Sum of the values ``shift`` and more places before, plus ``start``."""
    return df.withColumn(to, F.coalesce(F.sum(x).over(_ordered(by, at).rowsBetween(Window.unboundedPreceding, -shift)), F.lit(0)) + start)


def weekly_average(df: DataFrame, by: list[str], at: str, x: str, to: str = "weekly") -> DataFrame:
    """Centred mean of seven rows, cut at the ends; 0 where no value is known."""
    return df.withColumn(to, F.coalesce(F.avg(x).over(_ordered(by, at).rowsBetween(-3, 3)), F.lit(0.0)))


def standard_score(df: DataFrame, by: list[str], x: str, to: str = "score") -> DataFrame:
    """(x - mean) / sample deviation of the group; groups of fewer than three values have none."""
    stats = df.groupBy(*by).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"), F.count(x).alias("__n"))
    rows = join_by(df, stats, by)
    return rows.withColumn(to, F.when(F.col("__n") > 2, (F.col(x) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)))).drop("__m", "__s", "__n")


def autocorrelation(df: DataFrame, by: list[str], at: str, x: str, lag: int) -> DataFrame:
    """Mean product of deviations ``lag`` places apart over the population variance."""
    stats = df.groupBy(*by).agg(F.avg(x).alias("__m"), F.var_pop(x).alias("__v"))
    rows = df.withColumn("__y", F.lead(x, lag).over(_ordered(by, at)))
    rows = join_by(rows, stats, by)
    return rows.groupBy(*by).agg((F.avg((F.col(x) - F.col("__m")) * (F.col("__y") - F.col("__m"))) / F.max("__v")).alias("autocorrelation"))


def mad(df: DataFrame, by: list[str], at: str, x: str, z: float = 7.0, derivative: int = 0, to: str = "keep") -> DataFrame:
    """Outlier flags: false where a value (or difference) is further from its median than MAD * z / 0.6745.

    derivative 1 looks at forward differences (the last row of a series stays, whatever its value), 2 at second ones
    (both ends stay).  A null value, and a difference with one, give false.
    """
    w = _ordered(by, at)
    d = {0: F.col(x), 1: F.lead(x).over(w) - F.col(x), 2: F.lag(x).over(w) + F.lead(x).over(w) - 2 * F.col(x)}[derivative]
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    rows = df.withColumn("__d", d).withColumn("__e", {0: F.lit(False), 1: last, 2: first | last}[derivative])
    centred = join_by(rows, rows.groupBy(*by).agg(F.median("__d").alias("__c")), by).withColumn("__a", F.abs(F.col("__d") - F.col("__c")))
    limits = centred.groupBy(*by).agg((F.median("__a") * (z / 0.6745)).alias("__t"))
    return join_by(centred, limits, by).withColumn(to, F.col("__e") | F.coalesce(F.col("__a") <= F.col("__t"), F.lit(False))).drop("__d", "__e", "__c", "__a", "__t")


def mad_clamp(df: DataFrame, by: list[str], x: str, z: float = 7.0, side: str = "b", to: str = "clamped") -> DataFrame:
    """Values beyond median +- MAD * z / 0.6745 drawn to that limit; side u(pper), l(ower) or b(oth)."""
    centred = join_by(df, df.groupBy(*by).agg(F.median(x).alias("__c")), by)
    limits = centred.groupBy(*by).agg((F.median(F.abs(F.col(x) - F.col("__c"))) * (z / 0.6745)).alias("__t"))
    v = F.col(x)
    if side in "ub":
        v = F.least(v, F.col("__c") + F.col("__t"))
    if side in "lb":
        v = F.greatest(v, F.col("__c") - F.col("__t"))
    return join_by(centred, limits, by).withColumn(to, F.when(F.col(x).isNotNull(), v)).drop("__c", "__t")


def newton_cotes(df: DataFrame, by: list[str], at: str, x: str, dx: float = 1.0) -> DataFrame:
    """Integral of equidistant values by the closed five-point rule; points beyond the last full stretch are left out, fewer than five give null."""
    rows = df.withColumn("__k", F.row_number().over(_ordered(by, at)) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    last = F.floor((F.col("__n") - 1) / 4) * 4
    k = F.col("__k")
    weight = F.when((k == 0) | (k == last), 7.0).when(k % 4 == 0, 14.0).when(k % 4 == 2, 12.0).otherwise(32.0)
    return rows.where(k <= last).groupBy(*by).agg(F.when(F.max("__n") >= 5, F.sum(weight * F.col(x)) * (2 * dx / 45)).alias("integral"))


def linear_recurrence(df: DataFrame, by: list[str], at: str, x: str, carry: Column, gain: Column, to: str) -> DataFrame:
    """y_i = carry * y_(i-1) + gain * x_i in the order of ``at``, from 0; null values are passed over and give 0.

    carry and gain are constant within a series.  A series is cut into pieces of FOLD values that are folded by
    themselves; the ends of the pieces are folded in turn, and what they carry is added to the values of the next.
    """
    kept = [c for c in df.columns if c not in by]
    order = Window.partitionBy(*by).orderBy(at)
    rows = df.select("*", carry.cast("double").alias("__f"), gain.cast("double").alias("__g")).withColumn("__ok", F.col(x).isNotNull())
    rows = rows.withColumn("__k", F.sum(F.col("__ok").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    known = rows.where("__ok").withColumn("__p", F.floor(F.col("__k") / FOLD))
    item = F.struct(F.col("__k"), (F.col("__g") * F.col(x).cast("double")).alias("v"), F.struct(*kept).alias("row"))
    pieces = known.groupBy(*by, "__p").agg(F.max("__f").alias("__f"), F.sort_array(F.collect_list(item)).alias("__q"))
    fold = F.aggregate("__q", F.array().cast("array<double>"), lambda out, q: F.concat(out, F.array(q.v + F.col("__f") * F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0.0)))))
    pieces = pieces.withColumn("__y", fold)
    ends = pieces.groupBy(*by).agg(F.max("__f").alias("__f"), F.sort_array(F.collect_list(F.struct(F.col("__p"), F.element_at("__y", -1).alias("y"), F.size("__y").alias("n")))).alias("__e"))
    step = lambda out, e: F.concat(out, F.array(F.element_at(out, -1) * F.pow(F.col("__f"), e.n) + e.y))
    ends = ends.select(*by, F.posexplode(F.aggregate("__e", F.array(F.lit(0.0)), step)).alias("__at", "__c")).withColumn("__at", F.col("__at").cast("long"))
    told = join_by(pieces.withColumnRenamed("__p", "__at"), ends, [*by, "__at"])
    value = F.transform(F.arrays_zip("__q", "__y"), lambda z, i: F.struct(z["__q"]["row"].alias("row"), (z["__y"] + F.col("__c") * F.pow(F.col("__f"), i + 1)).alias("y")))
    found = told.select(*by, F.explode(value).alias("r")).select(*by, *(F.col(f"r.row.`{c}`").alias(c) for c in kept), F.col("r.y").alias(to))
    return found.unionByName(rows.where("not __ok").select(*by, *kept, F.lit(0.0).alias(to)))


def baseflow_ceiling(df: DataFrame, by: list[str], at: str, x: str) -> DataFrame:
    """(by, bfi_max): the 20 % percentile (rule 4) of the weekly means, held over all days, over the whole discharge."""
    weekly = weekly_average(df, by, at, x, "__week").where(F.col(x).isNotNull())
    low = percentiles(weekly, by, "__week", 20, 4)
    flow = df.groupBy(*by).agg((F.count(x) / F.sum(F.col(x).cast("double"))).alias("__per"))
    return join_by(low, flow, by).select(*by, (F.col("percentile") * F.col("__per")).alias("bfi_max"))


def eckhardt(df: DataFrame, by: list[str], at: str, x: str, alpha: float, bfi_max: float | None = None, to: str = "baseflow") -> DataFrame:
    """Baseflow of each series by the two-parameter recursive filter; ``bfi_max`` is derived where not given.  Days without a discharge have 0."""
    if bfi_max is None:
        rows, top = join_by(df, baseflow_ceiling(df, by, at, x).withColumnRenamed("bfi_max", "__b"), by), F.col("__b")
    else:
        rows, top = df, F.lit(float(bfi_max))
    under = 1 - alpha * top
    return linear_recurrence(rows, by, at, x, (1 - top) * alpha / under, (1 - alpha) * top / under, to).drop("__b")


def baseflow_index(flow: Column, base: Column) -> Column:
    return F.sum(base) / F.sum(flow)


def boxcox(x: Column, lam: float) -> Column:
    """Null where ``x`` is not positive."""
    known = F.when(x > 0, x)
    return F.ln(known) if lam == 0 else (F.pow(known, F.lit(lam)) - 1) / lam


def inverse_boxcox(y: Column, lam: float) -> Column:
    return F.exp(y) if lam == 0 else F.pow(y * lam + 1, F.lit(1 / lam))


def silverman(x: Column, dims: int = 1) -> Column:
    """Silverman's bandwidth of a sample."""
    return F.pow(F.lit(4 / (dims + 2)), F.lit(1 / (dims + 4))) * F.pow(F.count(x).cast("double"), F.lit(-1 / (dims + 4))) * F.stddev_samp(x)


def kernel_density(df: DataFrame, x: str, bandwidth: float, points: list[float], cumulative: bool = False) -> DataFrame:
    """(at, density) of a Gaussian kernel estimate at a bounded list of points, in one pass of partial sums."""
    z = lambda p: (F.lit(p) - F.col(x)) / bandwidth
    at = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("at"), F.lit(i).alias("i")) for i, p in enumerate(points))))
    if cumulative:
        one = [F.avg(_phi(z(p))).alias(f"d{i}") for i, p in enumerate(points)]
    else:
        one = [(F.sum(F.exp(-z(p) * z(p) / 2)) / (F.count(x) * (bandwidth * math.sqrt(2 * math.pi)))).alias(f"d{i}") for i, p in enumerate(points)]
    return df.agg(*one).select(at.alias("p"), F.array(*(f"d{i}" for i in range(len(points)))).alias("d")).select("p.at", F.element_at("d", F.col("p.i") + 1).alias("density"))


def _phi(z: Column) -> Column:
    """Standard normal distribution function (rational approximation, error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def kernel_density_nd(df: DataFrame, xs: list[str], bandwidths: list[float], points: list[tuple]) -> DataFrame:
    """(i, density) of a product of Gaussian kernels at a bounded list of points in any number of dimensions."""
    whole = math.prod(bandwidths) * (2 * math.pi) ** (len(xs) / 2)
    one = [(F.sum(_product_kernel(xs, bandwidths, p)) / (F.count(F.lit(1)) * whole)).alias(f"v{i}") for i, p in enumerate(points)]
    return df.agg(F.array(*one).alias("v")).select(F.posexplode("v").alias("i", "density"))


def _product_kernel(xs, bandwidths, point) -> Column:
    return F.exp(-sum((((F.lit(float(c)) - F.col(x)) / h) * ((F.lit(float(c)) - F.col(x)) / h) for c, x, h in zip(point, xs, bandwidths)), F.lit(0.0)) / 2)


def golden_section(cost, low: float, high: float, tolerance: float = 1e-3) -> float:
    """Place of the least cost on [low, high], for a cost with one valley; costs of a batch of places are asked together."""
    while high - low > tolerance * (abs(low) + abs(high)):
        places = np.linspace(low, high, 9)[1:-1]
        k = int(np.argmin(cost(places)))
        low, high = (low if k == 0 else places[k - 1]), (high if k == len(places) - 1 else places[k + 1])
    return (low + high) / 2


def _pair_sums(df: DataFrame, x: str, f) -> Column:
    """Sums of ``f`` over all pairs of distinct values with their counts: a bounded set of values, checked by the caller."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.alias("a").crossJoin(F.broadcast(counts.alias("b"))).agg(*f(F.col("a.v") - F.col("b.v"), F.col("a.n") * F.col("b.n")))


#: Distinct values (after binning) that cross-validation holds against each other.
MOST_VALUES = 20_000


def cross_validated_bandwidth(df: DataFrame, x: str, y: str | None = None, low: float = 0.2, high: float = 5.0) -> float:
    """Bandwidth between ``low`` and ``high`` times Silverman's with the least leave-one-out error.

    Without ``y`` the integrated squared error of the density, with it the mean squared error of the regression.
    Values are counted first; more than MOST_VALUES distinct ones raise, so bin them before.
    """
    own = df.where(F.col(x).isNotNull() & (F.col(y).isNotNull() if y else F.lit(True)))
    head = own.agg(silverman(F.col(x)).alias("h"), F.count(F.lit(1)).alias("n"), F.count_distinct(x).alias("k")).first()
    if head["k"] > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} distinct values: bin them first")
    n = head["n"]
    if y is None:
        def cost(hs):
            def sums(d, w):
                return [F.sum(w * (F.exp(-d * d / (4 * h * h)) / (2 * math.sqrt(math.pi) * h * n * n) - F.exp(-d * d / (2 * h * h)) * 2 / (math.sqrt(2 * math.pi) * h * n * (n - 1)))) for h in map(float, hs)]

            # pairs of a row with itself are in the first sum, not in the second
            return np.array(list(_pair_sums(own, x, sums).first())) + 2 / (math.sqrt(2 * math.pi) * np.asarray(hs) * (n - 1))
    else:
        c = own.groupBy(F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))

        def cost(hs):
            out = []
            for h in map(float, hs):
                k = F.exp(-F.pow((F.col("a.v") - F.col("b.v")) / h, 2) / 2)
                near = c.alias("a").crossJoin(F.broadcast(c.alias("b"))).groupBy(F.col("a.v").alias("v"), F.col("a.n").alias("n"), F.col("a.s").alias("s"), F.col("a.q").alias("q")).agg(F.sum(k * F.col("b.s")).alias("top"), F.sum(k * F.col("b.n")).alias("low"))
                # leaving a row out takes its own weight 1 away: y - (top - y) / (low - 1) = (y * low - top) / (low - 1)
                err = (F.col("low") * F.col("low") * F.col("q") - 2 * F.col("low") * F.col("top") * F.col("s") + F.col("n") * F.col("top") * F.col("top")) / F.pow(F.col("low") - 1, 2)
                out.append(near.agg(F.sum(F.when(F.col("low") > 1 + 1e-12, err).otherwise(F.col("q"))) / n).first()[0])
            return np.array(out)

    return golden_section(cost, low * head["h"], high * head["h"])


def kernel_regression(df: DataFrame, xs: list[str], y: str, bandwidths: list[float], points: list[tuple]) -> DataFrame:
    """(i, value): Nadaraya-Watson estimate at a bounded list of points in any number of dimensions."""
    out = []
    for i, p in enumerate(points):
        k = _product_kernel(xs, bandwidths, p)
        out.append((F.sum(k * F.col(y)) / F.nullif(F.sum(k), F.lit(0.0))).alias(f"v{i}"))
    return df.agg(F.array(*out).alias("v")).select(F.posexplode("v").alias("i", "value"))


# ranks and top-k

def rank_index(df: DataFrame, by: list[str], x: str, at: str, descending: bool = False, to: str = "rank") -> DataFrame:
    """Stable place of each row in the order of ``x``, from 1; a large group is ordered by many tasks."""
    out = placed(df, by, [F.desc(x) if descending else F.asc(x), F.asc(at)], to)
    return out.withColumn(to, F.col(to).cast("int"))


def top(df: DataFrame, x: str, k: int, at: str, descending: bool = False) -> DataFrame:
    """The k smallest (or largest) rows in order: a top-k on each partition and one merge, not a full sort."""
    return df.orderBy(F.desc(x) if descending else F.asc(x), at).limit(k)


def dense_rank(df: DataFrame, by: list[str], x: str, to: str = "rank") -> DataFrame:
    """Rank among distinct values, null for a null value: values are made distinct before they are ranked."""
    values = df.where(F.col(x).isNotNull()).select(*by, x).distinct().withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy(x)))
    return join_by(df, values, [*by, x], "left")


def first_occurrences(df: DataFrame, x: str, at: str) -> DataFrame:
    """One row for each value, its first in the order of ``at``."""
    return df.groupBy(x).agg(F.min(at).alias(at))


def multiplicity(df: DataFrame, by: list[str], x: str, to: str = "n") -> DataFrame:
    """How often the value of each row occurs: counted first and joined back, so hot values are not gathered."""
    return join_by(df, df.groupBy(*by, x).agg(F.count(F.lit(1)).alias(to)), [*by, x])


def nth(df: DataFrame, by: list[str], x: str, n: int) -> DataFrame:
    """n-th smallest value of each group."""
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("__c"))
    to = F.sum("__c").over(Window.partitionBy(*by).orderBy(x))
    return counts.withColumn("__to", to).where((F.col("__to") >= n) & (F.col("__to") - F.col("__c") < n)).select(*by, x)


def nth_with_neighbours(df: DataFrame, by: list[str], x: str, n: int) -> DataFrame:
    """(by, element, previous, next): the n-th smallest value and those beside it in the sorted group; by counts of values, so that no group is held."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    rows = counts.withColumn("__to", F.sum("__c").over(Window.partitionBy(*by).orderBy("__x")))
    held = lambda k: F.max(F.when((F.col("__to") >= k) & (F.col("__to") - F.col("__c") < k), F.col("__x")))
    return rows.groupBy(*by).agg(held(n).alias("element"), (held(n - 1) if n > 1 else F.lit(None).cast("double")).alias("previous"), held(n + 1).alias("next")).where("element is not null")


def nth_index(df: DataFrame, by: list[str], x: str, n: int, at: str) -> DataFrame:
    """(by, at, value) of the row at the n-th place in the order of ``x``, ties in the order of ``at``.

    Only rows that hold the n-th value are ordered.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*by).orderBy(x)) - F.col("__c")
    found = counts.withColumn("__before", before).where((F.col("__before") < n) & (F.col("__before") + F.col("__c") >= n))
    rows = join_by(df.select(*by, x, at), found, [*by, x]).withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(at)))
    return rows.where(F.col("__k") == n - F.col("__before")).select(*by, at, F.col(x).alias("value"))


def median_element(df: DataFrame, by: list[str], x: str, at: str | None = None) -> DataFrame:
    """(by, [at,] value) of the element in the middle, the lower one of an even number; ties in the order of ``at``."""
    n = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.floor((F.count(x) + 1) / 2).alias("__h"))
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("__c"))
    rows = join_by(counts.withColumn("__before", F.sum("__c").over(Window.partitionBy(*by).orderBy(x)) - F.col("__c")), n, by)
    found = rows.where("__before < __h and __before + __c >= __h")
    if at is None:
        return found.select(*by, F.col(x).alias("value"))
    own = join_by(df.select(*by, x, at), found, [*by, x]).withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(at)))
    return own.where("__k = __h - __before").select(*by, at, F.col(x).alias("value"))


def ordered(df: DataFrame, x: str, at: str, descending: bool = False) -> DataFrame:
    """All rows in the order of ``x``, ties in the order of ``at``: a range-partitioned sort."""
    return df.orderBy(F.desc(x) if descending else F.asc(x), at)


def with_place(df: DataFrame, x: str, at: str, to: str = "place") -> DataFrame:
    """Place of each row in the order of (``x``, ``at``) of the whole table, from 1."""
    return placed(df, [], [F.asc(x), F.asc(at)], to)


def distinct_ranked(df: DataFrame, by: list[str], x: str, at: str, most: int | None = None) -> DataFrame:
    """(by, rank, at, value): one row for each distinct value in ascending order, the first that holds it; the ``most`` smallest where given."""
    one = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("value")).agg(F.min(at).alias(at))
    out = one.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("value")))
    return (out if most is None else out.where(F.col("rank") <= most)).select(*by, "rank", at, "value")


def argmax(x: str, at: str) -> Column:
    """Aggregate: ``at`` of the largest value, ties to the smallest ``at``."""
    return F.min_by(at, F.struct(-F.col(x), F.col(at)))


def argmin(x: str, at: str) -> Column:
    return F.min_by(at, F.struct(F.col(x), F.col(at)))


def append(a: DataFrame, b: DataFrame, fill=None) -> DataFrame:
    """Rows of both; columns that one lacks are filled with ``fill`` (null where not given)."""
    have = lambda df, other: df.select("*", *(F.lit(fill).cast(other.schema[c].dataType).alias(c) for c in other.columns if c not in df.columns))
    return have(a, b).unionByName(have(b, a))


def paste(a: DataFrame, b: DataFrame, at: str, fill=None) -> DataFrame:
    """Columns of both side by side, rows that share the place ``at``; the shorter one is filled with ``fill``."""
    out = a.join(b, at, "full")
    return out if fill is None else out.fillna(fill)


def add_nodata_slice(df: DataFrame, slices: DataFrame, values: list[str], missing=-9999) -> DataFrame:
    """``df`` with rows of ``missing`` for keys that only ``slices`` has."""
    return df.unionByName(slices.select(*(c for c in df.columns if c not in values), *(F.lit(missing).cast(df.schema[c].dataType).alias(c) for c in values)))


def permutation(df: DataFrame, at: str, closeness: float, seed: int, n: int) -> DataFrame:
    """Rows in a random order; closeness 1 leaves them in place, 0 is uniform."""
    return df.orderBy(closeness * F.col(at) + (1 - closeness) * F.rand(seed) * n)


def _mode4(x: np.ndarray, share: float) -> float:
    """Percentile by linear interpolation, mode 4."""
    x, k = np.sort(x), 0.5 + len(x) * share
    a, b = (min(len(x), max(1, int(f(k)))) for f in (math.floor, math.ceil))
    return float(x[a - 1] + (x[b - 1] - x[a - 1]) * (k - a))


def _week(q: np.ndarray) -> np.ndarray:
    return pd.Series(q).rolling(7, center=True, min_periods=1).mean().to_numpy()


def _misfit(q: np.ndarray):
    """Squared relative distance of filtered to weekly flows, mean of all days below the 10 % percentile of the yearly minima; their number."""
    week = _week(q)
    low = week < _mode4(np.array([week[i : i + 365].min() for i in range(0, len(week), 365)]), 0.1)
    top = _mode4(_week(week), 0.2) * len(week) / week.sum()

    def cost(points: np.ndarray) -> np.ndarray:
        alpha = np.asarray(points, float)[:, 0]
        base, out = np.zeros(len(alpha)), np.empty((len(week), len(alpha)))
        for i, v in enumerate(week):
            base = out[i] = ((1 - top) * alpha * base + (1 - alpha) * top * v) / (1 - alpha * top)
        return ((out[low] / week[low, None] - 1) ** 2).mean(axis=0)

    return cost, int(low.sum())


def eckhardt_fit(df: DataFrame, by: list[str], at: str, x: str) -> DataFrame:
    """(by, alpha, bfi_max) of each series: alpha by Nelder-Mead on [0, 1] over all low-flow days, largest index from low flows.

    The search starts at 0.9 and stays there without a day below the percentile; series of up to 365 days have no alpha.
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf.sort_values(at)[x].to_numpy(float)
        cost, days = _misfit(q)
        alpha = float("nan") if len(q) <= 365 else float(nelder_mead(cost, [0.9], low=0.0, high=1.0)[0][0]) if days else 0.9
        out = pdf[by].head(1).copy()
        out["alpha"], out["bfi_max"] = alpha, float(_mode4(_week(q), 0.2) * len(q) / q.sum()) if q.sum() else float("nan")
        return out

    schema = ", ".join([*(f"{c} {dict(df.dtypes)[c]}" for c in by), "alpha double", "bfi_max double"])
    return df.groupBy(*by).applyInPandas(one, schema)
