"""What the operators of this subpackage share: tables in the cluster's shared folder and rows sent to Python in bounded batches."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridbrook.operators.graph import components  # noqa: F401  (used by the operators here)
from gridbrook.operators.tables import drop, new_path  # noqa: F401


#: Shuffle files of a query are deleted when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bloom filters (1 MB each, whatever the input) of a join's small side leave out most rows of its large side before those are shuffled.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


#: Bytes of the rows that Python is sent at once, so that long texts don't add up.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size; a worker gives back what a task leaves free.

    A plan reads the bound when it runs, so it is set on the session.
    """
    for k, v in BATCH_BYTES.items():
        df.sparkSession.conf.set(k, v)

    def bounded(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(bounded, schema)


def give_back() -> None:
    """Return freed memory to the system, which allocators keep otherwise: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """``conf`` holds inside; settings are put back after."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, BLOOM | {CLEAN: "true"}):  # the table stands for what was shuffled for it
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
