"""Tables in the cluster's shared folder, which cut lineage and survive lost executors, and joins that keep null keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; in local mode, where unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="gridbrook-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and reread."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Delete tables that ``save`` wrote and no later plan reads."""
    for df in frames:
        path = getattr(df, "_saved_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``by``, null equal to null; without ``by`` each row of ``left`` meets the one row of ``right``."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    names = {c: f"__r_{c}" for c in by}
    other = right.select(*(F.col(c).alias(n) for c, n in names.items()), *(c for c in right.columns if c not in names))
    return left.join(other, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items())), how).drop(*names.values())


def placed(df: DataFrame, by: list[str], order: list[Column], to: str) -> DataFrame:
    """``df`` with the place of each row in the order of its group, from 1; groups of any length.

    Rows are range-partitioned, sorted and saved, so a group's rows in a partition have consecutive ids; the counts of
    the groups' parts (a row a group and one a partition more, at most) give each part its first place.
    """
    own = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    own = save(own.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()), "ordered")
    parts = own.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__k").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # saved, so that its size is known to the join
    parts = save(parts.select(*by, "__p", (before - F.col("__first") + 1).alias("__add")), "parts")
    return join_by(own, parts, [*by, "__p"]).withColumn(to, F.col("__k") + F.col("__add")).drop("__p", "__k", "__add")


def running_sum(df: DataFrame, by: list[str], order: str, x: str, to: str) -> DataFrame:
    """``df`` with the sum of ``x`` up to each row in the order of its group; groups of any length, ``order`` distinct within them.

    Rows are range-partitioned and saved; a group's part in a partition is summed by itself and gets the sum of the
    parts before it.
    """
    own = save(df.repartitionByRange(*by, order).withColumn("__p", F.spark_partition_id()), "ranges")
    parts = own.groupBy(*by, "__p").agg(F.sum(x).alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = save(parts.select(*by, "__p", before.alias("__add")), "parts")
    inside = F.sum(x).over(Window.partitionBy(*by, "__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return join_by(own.withColumn(to, inside), parts, [*by, "__p"]).withColumn(to, F.col(to) + F.col("__add")).drop("__p", "__add")
