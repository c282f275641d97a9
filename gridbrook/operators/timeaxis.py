"""Time axes, temporal aggregation and resampling by interval and as-of joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridbrook.operators.tables import join_by

SECONDS = {"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}
_UNITS = re.compile(r"^(days|hours|minutes|seconds) since (\d{1,4}-\d{1,2}-\d{1,2})(?:[ T](\d{1,2}:\d{2}(?::\d{2})?))?$")


def decode_units(units: str) -> tuple[int, str]:
    """Seconds of a unit and the reference time of "<unit> since <date> [<time>]"."""
    found = _UNITS.match(units.strip())
    if not found:
        raise ValueError(f"not a unit of time: {units!r}")
    clock = found[3] or "00:00:00"
    return SECONDS[found[1]], f"{found[2]} {clock if clock.count(':') == 2 else clock + ':00'}"


def decode_time(value: Column, units: str) -> Column:
    """Timestamp (without zone) of a number in ``units``."""
    step, start = decode_units(units)
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + value * step).cast("timestamp_ntz")


def encode_time(ts: Column, units: str) -> Column:
    step, start = decode_units(units)
    return (F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(F.lit(start))) / step


def axis(spark, start: str, end: str, step: str) -> DataFrame:
    """(t, lower, upper): consecutive intervals from ``start`` up to ``end``; step like "1 hour" or "1 month"."""
    times = F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"interval {step}"))).alias("lower")
    rows = spark.range(1).select(times).withColumn("upper", F.col("lower") + F.expr(f"interval {step}")).where(F.col("upper") <= F.lit(end).cast("timestamp_ntz"))
    return rows.withColumn("t", F.row_number().over(Window.orderBy("lower"))).select("t", "lower", "upper")


def aggregate(df: DataFrame, by: list[str], ts: str, x: str, unit: str, how: str = "mean", missing: float = -9999.0, skip_missing: bool = False) -> DataFrame:
    """(by, period, value) for each day or month of a series; null where a value is missing, unless they are skipped.

    Every period from the first to the last of the series has a row.
    """
    value = F.nullif(F.col(x), F.lit(missing))
    period = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    got = df.groupBy(*by, period.alias("period")).agg((F.avg(value) if how == "mean" else F.sum(value)).alias("value"), F.count(F.lit(1)).alias("__n"), F.count(value).alias("__k"))
    got = got.withColumn("value", F.when(F.lit(skip_missing) | (F.col("__n") == F.col("__k")), F.col("value"))).drop("__n", "__k")
    ends = got.groupBy(*by).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    every = ends.select(*by, F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("period"))
    return every.join(got, [*by, "period"], "left")


def resample_intervals(source: DataFrame, target: DataFrame, by: list[str], method: str = "mean", bucket: int = 86400) -> DataFrame:
    """Values of intervals [lower, upper) (seconds) drawn to the intervals of ``target`` (t, lower, upper).

    mean weighs by overlap over the target's length, sum shares a value by overlap over the source's, min and max
    take all that overlap.  Targets that known values of a series don't cover whole have null.  Both sides are cut into buckets of
    ``bucket`` seconds, so the overlap is a hash join on the bucket and a residual predicate, counted once in the
    bucket where the overlap starts.
    """
    cut = lambda df, lo, hi: df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket))))
    s = cut(source.select(*by, F.col("lower").alias("sl"), F.col("upper").alias("su"), "value"), "sl", "su")
    t = cut(target.select("t", F.col("lower").alias("tl"), F.col("upper").alias("tu")), "tl", "tu")
    start = F.greatest("sl", "tl")
    rows = s.join(t, "__b").where((F.col("sl") < F.col("tu")) & (F.col("su") > F.col("tl")) & (F.floor(start / bucket) == F.col("__b")))
    ov = F.least("su", "tu") - start
    width, own = F.col("tu") - F.col("tl"), F.col("su") - F.col("sl")
    agg = {"mean": F.sum(F.col("value") * ov / width), "sum": F.sum(F.col("value") * ov / own), "min": F.min("value"), "max": F.max("value")}[method]
    out = rows.groupBy(*by, "t").agg(agg.alias("value"), F.sum(F.when(F.col("value").isNotNull(), ov)).alias("__got"), F.max(width).alias("__w"))
    return out.select(*by, "t", F.when(F.col("__got") == F.col("__w"), F.col("value")).alias("value"))


def resample_instants(source: DataFrame, target: DataFrame, by: list[str], method: str = "previous", bucket: int | None = None) -> DataFrame:
    """As-of join: values at the times ``at`` of ``target`` from those at the times ``at`` of ``source``.

    previous takes the last value not later, nearest the closer one (ties to the earlier), linear the line between
    the neighbours; outside the range nearest is clamped and the others are null.  The two tables are united and read
    in order, forwards and backwards.  With ``bucket``, a width in units of ``at``, long series are cut there: a
    bucket takes what lies before and behind it from the first and last values of the others.
    """
    s = source.select(*by, "at", F.lit(0).alias("__k"), F.struct(F.col("at").alias("a"), F.col("value").alias("v")).alias("__s"))
    t = target.select(*by, "at", F.lit(1).alias("__k"), F.lit(None).cast(s.schema["__s"].dataType).alias("__s"))
    rows = s.unionByName(t)
    keys = by if bucket is None else [*by, "__b"]
    if bucket is not None:
        rows = rows.withColumn("__b", F.floor(F.col("at") / bucket).cast("long"))
    if bucket is not None:  # what lies before and behind a bucket is put into it as two more rows
        ends = rows.groupBy(*keys).agg(F.min("__s").alias("lo"), F.max("__s").alias("hi"))
        up = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        down = Window.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
        beside = ends.select(*keys, F.last("hi", True).over(up).alias("p"), F.last("lo", True).over(down).alias("n"))
        carried = beside.select(*keys, F.explode(F.array("p", "n")).alias("__s")).where("__s is not null")
        rows = rows.unionByName(carried.select(*by, F.col("__s.a").alias("at"), F.lit(0).alias("__k"), "__s", "__b"))
    back = Window.partitionBy(*keys).orderBy("at", "__k").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("at"), "__k").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__p", F.last("__s", True).over(back)).withColumn("__n", F.last("__s", True).over(ahead)).where("__k = 1")
    p, n, at = F.col("__p"), F.col("__n"), F.col("at")
    if method == "previous":
        value = p["v"]
    elif method == "nearest":
        value = F.when(n.isNull() | (at - p["a"] <= n["a"] - at), p["v"]).otherwise(n["v"])
    else:
        value = F.when(p["a"] == n["a"], p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * (at - p["a"]) / (n["a"] - p["a"]))
    return found.select(*by, "at", value.alias("value"))


def chunk(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows of the window (start, end]."""
    return df.where((F.col(ts) > F.lit(start).cast("timestamp_ntz")) & (F.col(ts) <= F.lit(end).cast("timestamp_ntz")))


def infer_bounds(df: DataFrame, by: list[str], value: str, stamp: str = "end") -> DataFrame:
    """(by, value, lower, upper): bounds of steps that are known by their end, start or centre.

    The first (or last) one is as long as the step between the first two; around centres half of that lies on either side,
    and a step of an odd number raises.  A series of one time has a step of 1.
    """
    w = Window.partitionBy(*by).orderBy(value)
    step = join_by(df.select(*by, value).distinct(), df.select(*by, value).distinct().groupBy(*by).agg(F.slice(F.array_sort(F.collect_set(value)), 1, 2).alias("__two")), by)
    step = step.withColumn("__d", F.coalesce(F.try_element_at("__two", F.lit(2)) - F.element_at("__two", 1), F.lit(1)).cast("long"))
    v = F.col(value)
    if stamp == "end":
        lower, upper = F.coalesce(F.lag(v).over(w), v - F.col("__d")), v
    elif stamp == "start":
        lower, upper = v, F.coalesce(F.lead(v).over(w), v + F.col("__d"))
    elif stamp == "centre":
        half = F.when(F.col("__d") % 2 == 0, F.floor(F.col("__d") / 2)).otherwise(F.raise_error(F.lit("bounds around centres need an even step")))
        lower, upper = v - half, v + half
    else:
        raise ValueError(f"no place of a time stamp: {stamp}")
    return step.withColumn("lower", lower).withColumn("upper", upper).select(*by, value, "lower", "upper")


def infer_step(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """(by, step): hourly, daily, a whole number of hours, monthly or yearly where all times start such a period, varying, or none for one time."""
    t = F.col(ts)
    gaps = df.select(*by, t, (F.unix_timestamp(t.cast("timestamp")) - F.unix_timestamp(F.lag(t).over(Window.partitionBy(*by).orderBy(t)).cast("timestamp"))).alias("__g"))
    new = lambda unit: F.min((F.date_trunc(unit, t).cast("timestamp_ntz") == t).cast("int"))
    out = gaps.groupBy(*by).agg(F.min("__g").alias("a"), F.max("__g").alias("b"), new("month").alias("m"), new("year").alias("y"))
    same = F.when(F.col("a") == 86400, "daily").when(F.col("a") == 3600, "hourly").when(F.col("a") % 3600 == 0, F.floor(F.col("a") / 3600).cast("string")).otherwise("varying")
    step = F.when(F.col("a").isNull(), "none").when(F.col("a") == F.col("b"), same).when(F.col("y") == 1, "yearly").when(F.col("m") == 1, "monthly").otherwise("varying")
    return out.select(*by, step.alias("step"))


def units_for(step: str, stamp: str = "end") -> str:
    """The coarsest unit in which time stamps of such steps are whole numbers."""
    hours = int(step) if step.isdigit() else {"hourly": 1, "daily": 24}.get(step)
    if stamp == "centre":
        return "minutes" if hours is not None and hours % 2 else "hours"
    return "days" if step in ("monthly", "yearly") or (hours is not None and hours % 24 == 0) else "hours"


def time_values(previous: Column, now: Column, units: str, stamp: str = "end") -> Column:
    """struct(lower, upper, stamp): a step's numbers in ``units``."""
    a, b = F.round(encode_time(previous, units)).cast("long"), F.round(encode_time(now, units)).cast("long")
    at = {"start": a, "end": b, "centre": F.floor((a + b) / 2)}[stamp]
    return F.struct(a.alias("lower"), b.alias("upper"), at.cast("long").alias("stamp"))
