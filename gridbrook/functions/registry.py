"""Functions for SQL: user-defined scalar, aggregate and table functions, registered in a session by name."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf


def _known(x: Column, y: Column) -> tuple[Column, Column]:
    """Both as doubles, null where either is null or not a number."""
    x, y = x.cast("double"), y.cast("double")
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return F.when(ok, x), F.when(ok, y)


def _over(a: Column, b: Column) -> Column:
    """Division of doubles by the rules of IEEE 754, whatever the session's ANSI mode."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * float("inf"))
    return F.when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def _kge(x: Column, y: Column) -> Column:
    """Not a number for fewer than two pairs and for a series without variation."""
    x, y = _known(x, y)
    sx, sy = F.stddev_samp(x), F.stddev_samp(y)
    r = F.covar_samp(x, y) / F.nullif(sx * sy, F.lit(0.0))
    found = 1 - F.sqrt(F.pow(1 - _over(F.avg(y), F.avg(x)), F.lit(2)) + F.pow(1 - _over(sy, sx), F.lit(2)) + F.pow(1 - r, F.lit(2)))
    return F.coalesce(found, F.lit(float("nan")))


def _nse(x: Column, y: Column) -> Column:
    x, y = _known(x, y)
    below = F.nullif(F.var_pop(x) * F.count(x), F.lit(0.0))
    return F.coalesce(1 - F.sum((y - x) * (y - x)) / below, F.lit(float("nan")))


class _Expression:
    """Builds the expression of a function of columns when the analyzer meets its name: no Python runs in the tasks."""

    def __init__(self, spark: SparkSession, name: str, f: Callable[..., Column]):
        self.spark, self.name, self.f, self.n = spark, name, f, f.__code__.co_argcount

    def apply(self, arguments):
        if arguments.size() != self.n:
            raise ValueError(f"{self.name} takes {self.n} arguments")
        make = self.spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
        out = self.f(*(Column(make.column(arguments.apply(k))) for k in range(self.n)))
        return self.spark._jsparkSession.expression(out._jc)

    def toString(self):
        return self.name

    class Java:
        implements = ["scala.Function1"]


def register_expression(spark: SparkSession, name: str, f: Callable[..., Column]) -> None:
    """Make ``f`` of columns, scalar or aggregate, known to SQL; aggregates are partial, so no group is gathered."""
    ensure_callback_server_started(spark.sparkContext._gateway)
    spark._jsparkSession.sessionState().functionRegistry().createOrReplaceTempFunction(name, _Expression(spark, name, f), "scala_udf")


def _kge_series(x: pd.Series, y: pd.Series) -> float:
    ok = x.notna() & y.notna()
    x, y = x[ok], y[ok]
    if len(x) < 2:
        return float("nan")
    return float(1 - np.sqrt((1 - y.mean() / x.mean()) ** 2 + (1 - y.std() / x.std()) ** 2 + (1 - np.corrcoef(x, y)[0, 1]) ** 2))


def _nse_series(x: pd.Series, y: pd.Series) -> float:
    ok = x.notna() & y.notna()
    x, y = x[ok], y[ok]
    below = ((x - x.mean()) ** 2).sum()
    return float(1 - ((y - x) ** 2).sum() / below) if below else float("nan")


def _great_circle(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    a, b = np.radians(lat1), np.radians(lat2)
    return 6371228.0 * np.arccos(np.minimum(1.0, np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(np.radians(lon2 - lon1))))


class _TimeAxis:
    """Rows (t, lower, upper) of ``n`` steps of ``step`` seconds from ``start``."""

    def eval(self, start: int, step: int, n: int):
        for k in range(n):
            yield k + 1, start + k * step, start + (k + 1) * step


def register_all(spark: SparkSession) -> list[str]:
    """Make kge, nse (aggregates), great_circle (scalar) and time_axis (table) known to SQL; returns their names.

    The aggregates are built-in expressions and need no Python workers.  An expression of several aggregates can't stand
    before OVER: kge_window and nse_window can, and hold a whole window in a worker.
    """
    register_expression(spark, "kge", _kge)
    register_expression(spark, "nse", _nse)
    spark.udf.register("kge_window", pandas_udf(_kge_series, "double"))
    spark.udf.register("nse_window", pandas_udf(_nse_series, "double"))
    spark.udf.register("great_circle", pandas_udf(_great_circle, "double"))
    spark.udtf.register("time_axis", udtf(_TimeAxis, returnType="t int, lower long, upper long"))
    return ["kge", "nse", "kge_window", "nse_window", "great_circle", "time_axis"]


def register_function(spark: SparkSession, name: str, f: Callable, returns: str, aggregate: bool = False) -> None:
    """Register a caller's function of pandas series (one value out of them with ``aggregate``: a worker then holds a whole group)."""
    if aggregate:
        def one(*columns: pd.Series):
            return f(*columns)

        one.__annotations__ = {"return": float}
        spark.udf.register(name, pandas_udf(one, returns, functionType=202))  # grouped aggregate
    else:
        spark.udf.register(name, pandas_udf(f, returns, functionType=200))  # scalar
