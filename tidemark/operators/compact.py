"""Merging runs and dropping versions nobody can see."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.visibility import newest
from tidemark.schema import DELETE

#: bytes that an entry of a run counts beside its key and value
ENTRY = 16


def merge_runs(*runs: DataFrame) -> DataFrame:
    """All versions of some runs as one; order comes with the sorted write, not here."""
    return reduce(DataFrame.unionByName, runs)


def keep_newest(log: DataFrame) -> DataFrame:
    """One version per key, tombstones included."""
    return newest(log)


def snapshot_safe(log: DataFrame, oldest: int) -> DataFrame:
    """Versions that a read at any sequence >= ``oldest`` can need: all later ones, and per key the newest up to it."""
    base = newest(log.filter(F.col("seq") <= oldest))
    return log.filter(F.col("seq") > oldest).unionByName(base.select(*log.columns))


def drop_tombstones(kept: DataFrame, oldest: int, deeper: DataFrame | None = None) -> DataFrame:
    """Without tombstones at or below ``oldest``: nothing older is left for them to hide.

    ``deeper`` holds the key ranges (lo, hi) of runs that take no part; a
    tombstone whose key may be in one of them stays.
    """
    gone = (F.col("op") == DELETE) & (F.col("seq") <= oldest)
    if deeper is None:
        return kept.filter(~gone)
    may_hide = kept.filter(gone).join(deeper.select("lo", "hi"), F.col("key").between(F.col("lo"), F.col("hi")), "left_semi")
    return kept.filter(~gone).unionByName(may_hide)


def apply_filter(kept: DataFrame, keep: Column | Callable[[DataFrame], Column], partial: bool = False) -> DataFrame:
    """Removes puts that a user's condition rejects, after the merge; tombstones are not shown to it.

    In a partial compaction a removed put becomes a tombstone, since an older
    version in another run would come back otherwise.
    """
    ok = (F.col("op") == DELETE) | F.coalesce(keep(kept) if callable(keep) else keep, F.lit(False))
    if not partial:
        return kept.filter(ok)
    return kept.select("key", "seq", F.when(ok, F.col("op")).otherwise(DELETE).cast(kept.schema["op"].dataType).alias("op"), F.when(ok, F.col("value")).alias("value"))


def ttl_filter(ttl: int, current: int) -> Column:
    """True for versions not older than ``ttl`` sequences."""
    return ~(F.lit(current > ttl) & (F.col("seq") < current - ttl))


def statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """entries and bytes in and out, dropped entries, space (bytes) and write (entries) amplification, 0 without input."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY
    both = before.select(F.lit(True).alias("_in"), size.alias("_size")).unionByName(after.select(F.lit(False).alias("_in"), size.alias("_size")))
    out = both.agg(
        F.count_if("_in").alias("entries_in"),
        F.coalesce(F.sum(F.when(F.col("_in"), F.col("_size"))), F.lit(0)).cast("bigint").alias("bytes_in"),
        F.count_if(~F.col("_in")).alias("entries_out"),
        F.coalesce(F.sum(F.when(~F.col("_in"), F.col("_size"))), F.lit(0)).cast("bigint").alias("bytes_out"),
    )
    amp = lambda what: F.when(F.col(f"{what}_in") > 0, F.col(f"{what}_out") / F.col(f"{what}_in")).otherwise(0.0)
    return out.select("*", (F.col("entries_in") - F.col("entries_out")).alias("dropped"), amp("bytes").alias("space_amp"), amp("entries").alias("write_amp"))


def report(before: list[dict], after: list[dict], seconds: float, moved: bool = False) -> dict:
    """What a compaction did, from its manifest entries; a moved file was neither read nor written."""
    of = lambda files, what: 0 if moved else sum(f[what] for f in files)
    out = {"files_in": len(before), "files_out": len(after), "moved": moved, "elapsed": seconds}
    for what, column in (("entries", "n"), ("bytes", "file_size")):
        out[f"{what}_in"], out[f"{what}_out"] = of(before, column), of(after, column)
    out["dropped"] = out["entries_in"] - out["entries_out"]
    out["space_amp"] = out["bytes_out"] / out["bytes_in"] if out["bytes_in"] else 0.0
    out["write_amp"] = out["entries_out"] / out["entries_in"] if out["entries_in"] else 0.0
    return out
