"""Keyed tables: dictionaries of a driver as small DataFrames, and lookups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridbrook.operators.tables import join_by


def lookup(df: DataFrame, table: DataFrame, key: str, to: str, default=None) -> DataFrame:
    """``df`` with the value of ``table`` (key, value) for each key, ``default`` where it has none."""
    found = join_by(df, table.select(F.col("key").alias(key), F.col("value").alias(to)), [key], "left")
    return found if default is None else found.withColumn(to, F.coalesce(to, F.lit(default)))


def has(df: DataFrame, table: DataFrame, key: str, to: str = "has") -> DataFrame:
    """``df`` with whether the table holds the key."""
    return join_by(df, table.select(F.col("key").alias(key), F.lit(True).alias(to)).distinct(), [key], "left").fillna(False, [to])


def with_entries(table: DataFrame, more: DataFrame) -> DataFrame:
    """The table with the entries of ``more``, which replace those with equal keys."""
    return table.join(more, "key", "left_anti").unionByName(more)


def without_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, "key", "left_anti")


def same_entries(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same keys with equal values."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
