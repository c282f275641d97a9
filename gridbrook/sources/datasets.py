"""Grid and point data over time on Parquet, partitioned by the month (or day) of a step's end, so that windows of time prune folders.

A row has the end of its step ``ts``, its start ``lower``, the step's number ``t_idx`` from 1, its keys (cell or point,
and layer where there is one) and the variables.  Windows are (start, end].
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridbrook.operators.grid import GridSpec, pack_ids, unpack

TIME = ["t_idx", "lower", "ts"]


def write(df: DataFrame, path: str, ts: str = "ts", lower: str | None = None, by_key: str | None = None, unit: str = "month") -> None:
    """Write rows with a time each; steps are numbered in the order of time.

    Folders hold a ``unit`` of time (month or day, by the size of a step), or with ``by_key`` a series each.  Within
    them rows are sorted by time, so that statistics of the files prune further.
    """
    steps = df.select(F.col(ts).alias("ts")).distinct().withColumn("t_idx", F.row_number().over(Window.orderBy("ts")))
    start = F.col(lower) if lower else F.lag("ts").over(Window.orderBy("ts"))
    rows = df.withColumnRenamed(ts, "ts")
    if lower:
        rows = rows.withColumn("lower", start).join(F.broadcast(steps), "ts")
    else:
        rows = rows.join(F.broadcast(steps.withColumn("lower", start)), "ts")
    keys = [c for c in rows.columns if c not in TIME]
    rows = rows.select(*TIME, *keys).withColumn("period", F.to_date(F.date_trunc(unit, "ts")))
    if by_key:
        rows.drop("period").withColumn("series", F.col(by_key)).repartition("series").sortWithinPartitions("series", "ts").write.mode("overwrite").partitionBy("series").parquet(f"{path}/values")
    else:
        rows.repartition("period").sortWithinPartitions("period", "ts").write.mode("overwrite").partitionBy("period").parquet(f"{path}/values")
    # a small table of steps answers questions of time without a look at the values
    axis = steps.withColumn("lower", F.lag("ts").over(Window.orderBy("ts"))) if not lower else df.select(F.col(ts).alias("ts"), F.col(lower).alias("lower")).distinct().join(F.broadcast(steps), "ts")
    axis.select(*TIME).coalesce(1).write.mode("overwrite").parquet(f"{path}/axis")


class Dataset:
    """Reader of what ``write`` or ``Output`` left at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.values, self.axis = spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/axis")
        self._by_time = "period" in self.values.columns
        self.variables = [c for c in self.values.columns if c not in (*TIME, "period", "series")]

    def meta(self) -> list[tuple[str, str]]:
        """Names and types of the keys and variables."""
        return [(f.name, f.dataType.simpleString()) for f in self.values.schema if f.name in self.variables]

    def var_index(self, name: str) -> int:
        """Place of a variable, from 1."""
        return self.variables.index(name) + 1

    def time_axis(self) -> DataFrame:
        return self.axis.orderBy("t_idx")

    def _step(self, ts: str):
        at = F.lit(ts).cast("timestamp_ntz")
        return self.axis.where((F.coalesce(F.col("lower"), F.col("ts") - F.expr("interval 1 second")) < at) & (at <= F.col("ts"))).first()

    def time_index(self, ts: str) -> int | None:
        """Number of the step that holds the time: lower < time <= end."""
        found = self._step(ts)
        return found["t_idx"] if found else None

    def chunk_times(self, start: str, end: str) -> DataFrame:
        return self._window(self.axis, start, end).orderBy("t_idx")

    def _window(self, df: DataFrame, start: str, end: str) -> DataFrame:
        a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
        out = df.where((F.col("ts") > a) & (F.col("ts") <= b))
        return out.where(F.col("period").between(F.to_date(F.date_trunc("month", a)), F.to_date(b))) if "period" in df.columns else out

    def _plain(self, df: DataFrame) -> DataFrame:
        return df.select(*TIME, *self.variables)

    def read(self, ts: str) -> DataFrame:
        """Rows of the step that holds a time (lower < time <= end); none where no step does."""
        found = self._step(ts)
        at = F.lit(found["ts"] if found else None).cast("timestamp_ntz")
        rows = self.values.where(F.col("ts") == at)
        return self._plain(rows.where(F.col("period").between(F.to_date(F.date_trunc("month", at)), F.to_date(at))) if self._by_time else rows)

    def read_chunk(self, start: str, end: str) -> DataFrame:
        """Rows of the steps that end in (start, end]."""
        return self._plain(self._window(self.values, start, end))

    def read_chunk_by_ids(self, first: int, size: int) -> DataFrame:
        """Rows of ``size`` steps from the number ``first``; the steps' times prune folders."""
        ends = self.axis.where(F.col("t_idx").between(first, first + size - 1)).agg(F.min("ts"), F.max("ts")).first()
        if ends[0] is None:
            return self._plain(self.values.limit(0))
        rows = self.values.where(F.col("t_idx").between(first, first + size - 1))
        return self._plain(rows.where(F.col("period").between(F.lit(ends[0].date().replace(day=1)), F.lit(ends[1].date()))) if self._by_time else rows)

    def read_layer(self, layer: int, start: str, end: str, column: str = "layer") -> DataFrame:
        """One layer of a window of time."""
        return self.read_chunk(start, end).where(F.col(column) == layer)

    def read_packed(self, ts: str, spec: GridSpec, value: str, packed: bool = True) -> DataFrame:
        """A grid at one time, packed (packed_id, value) or as a matrix (i, j, value) over the whole grid."""
        rows = self.read(ts).select("i", "j", F.col(value).alias("value"))
        return pack_ids(rows).select("packed_id", "value") if packed else unpack(rows, spec)

    def read_series(self, key: str, ids: list) -> DataFrame:
        """Whole series of some keys, in the order of time; a layout by series reads only their folders."""
        rows = self.values.where(F.col("series").isin(*ids)) if "series" in self.values.columns else self.values.where(F.col(key).isin(*ids))
        return self._plain(rows).orderBy(key, "ts")

    def ids(self, key: str) -> DataFrame:
        return self.values.select(key).distinct().orderBy(key)


def id_places(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    """(id, place): place from 1 of each id among the points in the order of their ids, null for one that is not there."""
    from gridbrook.operators.sequence import dense_rank

    place = dense_rank(points.select(key).distinct(), [], key, "place")
    return ids.join(place, key, "left")


class Output:
    """Accumulates updates and writes a step at a time: sums, or means where the variable says so.

    ``variables`` maps names to "sum" or "mean".  Updates are kept as plans and aggregated once when a step is written;
    means of whole-number variables are cut to whole numbers.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], variables: dict[str, str]):
        self.spark, self.path, self.keys, self.variables = spark, path, keys, variables
        self.updates: DataFrame | None = None
        self.steps: list[tuple] = []
        self.last = None

    def update(self, df: DataFrame) -> None:
        own = df.select(*self.keys, *self.variables)
        self.updates = own if self.updates is None else self.updates.unionByName(own)

    def write(self, ts: str, lower: str | None = None) -> None:
        """Write what was accumulated as the step that ends at ``ts`` and start anew."""
        if self.updates is None:
            raise ValueError("no update since the last step")
        how = {"sum": F.sum, "mean": F.avg}
        one = lambda v: how[self.variables[v]](v).cast(self.updates.schema[v].dataType)  # noqa: E731  (a cast cuts the fraction off)
        rows = self.updates.groupBy(*self.keys).agg(*(one(v).alias(v) for v in self.variables))
        self.steps.append((len(self.steps) + 1, lower or self.last, ts))
        at, start = F.lit(ts).cast("timestamp_ntz"), F.lit(self.steps[-1][1]).cast("timestamp_ntz")
        rows = rows.select(F.lit(len(self.steps)).alias("t_idx"), start.alias("lower"), at.alias("ts"), *self.keys, *self.variables, F.to_date(F.date_trunc("month", at)).alias("period"))
        rows.write.mode("append").partitionBy("period").parquet(f"{self.path}/values")
        self.updates, self.last = None, ts

    def write_static(self, df: DataFrame, name: str) -> None:
        """A field without time."""
        df.write.mode("overwrite").parquet(f"{self.path}/static/{name}")

    def close(self) -> Dataset:
        rows = self.spark.createDataFrame(self.steps, "t_idx int, lower string, ts string")
        rows.select("t_idx", F.col("lower").cast("timestamp_ntz").alias("lower"), F.col("ts").cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/axis")
        return Dataset(self.spark, self.path)


def to_restart(cells: DataFrame, spec: GridSpec, path: str) -> None:
    """The whole state of a grid: its spec and its active cells with all their columns."""
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame([tuple(asdict(spec).values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double'}" for k, v in asdict(spec).items())).write.mode("overwrite").parquet(f"{path}/spec")


def from_restart(spark: SparkSession, path: str) -> tuple[DataFrame, GridSpec]:
    return spark.read.parquet(f"{path}/cells"), GridSpec(**spark.read.parquet(f"{path}/spec").first().asDict())
