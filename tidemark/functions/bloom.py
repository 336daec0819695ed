"""A Bloom filter built as an aggregate: the set bit numbers of a key set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probes(bits_per_key: int) -> int:
    return max(1, min(30, int(bits_per_key * 0.69)))


def positions(key: Column, bits: int, k: int) -> Column:
    """The bit numbers of a key, by double hashing."""
    first = F.pmod(F.xxhash64(key), F.lit(bits))
    step = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits - 1)) + 1
    return F.array(*[F.pmod(first + step * i, F.lit(bits)).cast("bigint") for i in range(k)])


def build(keys: DataFrame, n: int, bits_per_key: int = 10) -> tuple[DataFrame, int, int]:
    """(set bits, number of bits, probes) of the column ``key``."""
    bits, k = max(64, n * bits_per_key), probes(bits_per_key)
    return keys.select(F.explode(positions(F.col("key"), bits, k)).alias("bit")).distinct(), bits, k


def may_contain(keys: DataFrame, filter_bits: DataFrame, bits: int, k: int) -> DataFrame:
    """``key``, maybe: false only for keys that were never added."""
    probed = keys.select("key", F.explode(F.array_distinct(positions(F.col("key"), bits, k))).alias("bit"))
    hit = probed.join(filter_bits.withColumn("_set", F.lit(True)), "bit", "left")
    return hit.groupBy("key").agg(F.bool_and(F.coalesce("_set", F.lit(False))).alias("maybe"))
