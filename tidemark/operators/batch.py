"""Write batches and their sequence numbers; flush runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import running_totals
from tidemark.schema import DELETE, PUT

#: a put costs its key, its value and 16 bytes of a batch; a tombstone its key and 8
PUT_OVERHEAD, DELETE_OVERHEAD, ENTRY_OVERHEAD = 16, 8, 64


class WriteBatch:
    """An ordered list of puts and deletes that becomes visible as a whole."""

    def __init__(self):
        self.entries: list[tuple[int, bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> "WriteBatch":
        self.entries.append((PUT, key, value))
        return self

    def delete(self, key: bytes) -> "WriteBatch":
        self.entries.append((DELETE, key, None))
        return self

    def clear(self) -> None:
        self.entries.clear()

    def is_empty(self) -> bool:
        return not self.entries

    def __len__(self) -> int:
        return len(self.entries)

    def __iter__(self):
        return iter(self.entries)

    def approximate_size(self) -> int:
        return sum(len(k) + (len(v or b"") + PUT_OVERHEAD if op == PUT else DELETE_OVERHEAD) for op, k, v in self.entries)

    def to_df(self, spark: SparkSession, first_seq: int) -> DataFrame:
        rows = [(k, first_seq + i, op, v) for i, (op, k, v) in enumerate(self.entries)]
        return spark.createDataFrame(rows, "key binary, seq bigint, op int, value binary")


def entry_size() -> Column:
    """Bytes that an operation (columns key, op, value) adds to a batch."""
    return F.when(F.col("op") == PUT, F.octet_length("key") + F.octet_length("value") + PUT_OVERHEAD).otherwise(F.octet_length("key") + DELETE_OVERHEAD)


def assign_sequences(ops: DataFrame, base: int, order: str = "ord", width: int = 4096) -> DataFrame:
    """seq = base + place in the whole-number column ``order``, without funnelling a bulk load through one task.

    Operations fall into stretches of ``width`` order values, the stretches are
    counted, and a place is the counts before plus the place within.  Stretches
    depend on the values alone, so a repeated task numbers alike.  Operations of
    equal order, which should be few, take their places in key order.
    """
    cut = ops.withColumn("_range", F.floor(F.col(order) / width))
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = running_totals(counts, "_range", "_n").withColumnRenamed("before", "_before")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order, "key", "op", "value"))
    return cut.join(before, "_range").withColumn("seq", F.lit(base) + F.col("_before") + within).drop("_range", "_before")


def flush_runs(log: DataFrame, limit: int, buckets: int = 4096) -> DataFrame:
    """``log`` with ``run``: the bytes written before an operation, in units of ``limit``.

    The running total of entry sizes is a prefix sum over sequence ranges and
    groups of them, so no task sorts the whole log.
    """
    size = F.octet_length("key") + F.when(F.col("op") == PUT, F.coalesce(F.octet_length("value"), F.lit(0))).otherwise(0) + 8 + ENTRY_OVERHEAD
    sized = log.withColumn("_size", size.cast("bigint")).withColumn("_range", F.floor(F.col("seq") / buckets))
    totals = sized.groupBy("_range").agg(F.sum("_size").alias("_all"))
    before = running_totals(totals, "_range", "_all").withColumnRenamed("before", "_before")
    within = Window.partitionBy("_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sized.join(before, "_range").withColumn("_sum", F.col("_before") + F.sum("_size").over(within) - F.col("_size"))
    return out.withColumn("run", F.floor(F.col("_sum") / limit)).drop("_size", "_range", "_before", "_sum")


