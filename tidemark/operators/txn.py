"""Optimistic transactions as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.visibility import visible
from tidemark.schema import PUT


def conflicts(log: DataFrame, keys: DataFrame, snapshot: int) -> DataFrame:
    """Keys of a read (or write) set that anyone wrote after ``snapshot``: deletes and rewrites of the same value too."""
    later = log.filter(F.col("seq") > snapshot)
    return keys.select("key").distinct().join(later, "key", "left_semi")


def overlay(log: DataFrame, writes: DataFrame, snapshot: int) -> DataFrame:
    """What a transaction reads: its own last write per key (columns ord, key, op, value), else the snapshot."""
    own = writes.groupBy("key").agg(F.max_by(F.struct("op", "value"), "ord").alias("_w")).select("key", "_w.op", "_w.value")
    below = visible(log, snapshot).select("key", "value").join(own, "key", "left_anti")
    return below.unionByName(own.filter(F.col("op") == PUT).select("key", "value"))


def commit(log: DataFrame, writes: DataFrame, base: int) -> DataFrame:
    """The log after a batch (columns ord, key, op, value) committed behind ``base``."""
    return log.unionByName(writes.select("key", (F.lit(base).cast("bigint") + F.col("ord")).alias("seq"), "op", "value"))
