"""Ordered scans over live pairs: bounds, prefixes, seeks, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import prefix_end, text_prefix_end
from tidemark.operators import ordered
from tidemark.operators.visibility import visible


def within(log: DataFrame, *, start=None, end=None, start_exclusive: bool = False, end_inclusive: bool = False, prefix=None) -> DataFrame:
    """Rows whose key lies in the bounds; plain comparisons, so they reach the Parquet reader."""
    key = F.col("key")
    if start is not None:
        log = log.filter(key > F.lit(start) if start_exclusive else key >= F.lit(start))
    if end is not None:
        log = log.filter(key <= F.lit(end) if end_inclusive else key < F.lit(end))
    if prefix is not None:
        above = prefix_end(prefix) if isinstance(prefix, bytes) else text_prefix_end(prefix)
        log = log.filter(key >= F.lit(prefix))
        if above is not None:
            log = log.filter(key < F.lit(above))
        log = log.filter(F.startswith(key, F.lit(prefix)))
    return log


def scan(log: DataFrame, *, seq: int | None = None, reverse: bool = False, **bounds) -> DataFrame:
    """Live (key, value) within the bounds, in key order."""
    live = visible(within(log, **bounds), seq).select("key", "value")
    return live.orderBy(F.desc("key") if reverse else F.asc("key"))


def seek(log: DataFrame, key, *, seq: int | None = None, backward: bool = False) -> DataFrame:
    """The first live pair at or after ``key``, or the last at or before it: a top-1, not a sort."""
    bounds = {"end": key, "end_inclusive": True} if backward else {"start": key}
    return scan(log, seq=seq, reverse=backward, **bounds).limit(1)


def ends(log: DataFrame, seq: int | None = None) -> DataFrame:
    """first_key, last_key and n of the live keys."""
    return visible(log, seq).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("n"))


def neighbours(log: DataFrame, *, seq: int | None = None, **bounds) -> DataFrame:
    """Each live key with the keys before and after it; the ends of key ranges are handed on between them."""
    rows = ordered.ranged(visible(within(log, **bounds), seq).select("key"), F.asc("key"))
    parts = rows.groupBy("_part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    around = ordered.carried(parts, _prev=F.lag("hi").over(ordered.by_part()), _next=F.lead("lo").over(ordered.by_part()))
    order = Window.partitionBy("_part").orderBy("key")
    beside = rows.select("_part", "key", F.lag("key").over(order).alias("prev_key"), F.lead("key").over(order).alias("next_key")).join(around, "_part")
    return beside.select("key", F.coalesce("prev_key", "_prev").alias("prev_key"), F.coalesce("next_key", "_next").alias("next_key"))


def scan_positions(log: DataFrame, *, seq: int | None = None, reverse: bool = False, **bounds) -> DataFrame:
    """Live (key, value) with ``pos``, the place in the scan from 1."""
    live = visible(within(log, **bounds), seq).select("key", "value")
    return ordered.positions(live, F.desc("key") if reverse else F.asc("key"))
