"""Multi-version visibility: the newest version of each key at a sequence, tombstones hidden.

A key's history may be large (a hot key can hold a third of the log), so the
newest version is an aggregate, ``max_by`` over the sequence: it combines on the
map side, and no task ever sees a whole history.  Predicates on the key placed
above it are pushed below by the optimizer; the bound on the sequence is placed
below by these functions, since it does not commute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import DELETE, PUT


def newest(log: DataFrame, seq: int | Column | None = None) -> DataFrame:
    """One row per key: its version of the greatest sequence (<= seq), tombstones included."""
    if seq is not None:
        log = log.filter(F.col("seq") <= seq)
    rest = [c for c in log.columns if c not in ("key", "seq")]
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("_v")).select("key", "seq", *[F.col("_v")[c].alias(c) for c in rest])


def visible(log: DataFrame, seq: int | Column | None = None) -> DataFrame:
    """Live (key, seq, value) as of ``seq``; all of the log without one."""
    return newest(log, seq).filter(F.col("op") == PUT).select("key", "seq", "value")


def history(log: DataFrame, key) -> DataFrame:
    """All versions of a key, newest first."""
    return log.filter(F.col("key") == F.lit(key)).orderBy(F.desc("seq"))


def lookup(log: DataFrame, keys: DataFrame, seq: int | None = None) -> DataFrame:
    """status (Found, Deleted, NotFound) and value for a table of keys.

    The keys filter the log before the aggregation (a semi-join, which the
    planner broadcasts only when the table is small).
    """
    keys = keys.select("key").distinct()
    got = newest(log.join(keys, "key", "left_semi"), seq)
    status = F.when(F.col("op").isNull(), "NotFound").when(F.col("op") == DELETE, "Deleted").otherwise("Found")
    return keys.join(got, "key", "left").select("key", status.alias("status"), F.when(F.col("op") == PUT, F.col("value")).alias("value"))


def diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """Keys that differ between two sequences: change (added, removed, changed), old_value, new_value."""
    a = visible(log, old).select("key", F.col("seq").alias("old_seq"), F.col("value").alias("old_value"))
    b = visible(log, new).select("key", F.col("seq").alias("new_seq"), F.col("value").alias("new_value"))
    change = F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed").otherwise("changed")
    both = a.join(b, "key", "full")
    return both.filter(~F.col("old_seq").eqNullSafe(F.col("new_seq"))).select("key", change.alias("change"), "old_value", "new_value")
