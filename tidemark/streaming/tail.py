"""Streams into a store, and running views of a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.store import Store


def into_store(ops: DataFrame, store: Store, checkpoint: str, order: str = "ord", name: str | None = None):
    """Starts a query that commits every micro-batch (order, key, op, value) to a store as one run.

    The number of the last batch is published with its files under the stream's
    name (its checkpoint folder unless given), so a query that starts again and
    repeats a batch commits it once.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.load(batch, order, (name or checkpoint, number))

    return ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).start()


def running_newest(log: DataFrame) -> DataFrame:
    """A streaming log's newest version per key (update mode): state is one row per key."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("v")).select("key", "seq", "v.op", "v.value")


def windowed_counts(log: DataFrame, ts: str, late: str, width: str) -> DataFrame:
    """Operations per key and time window; rows later than ``late`` are dropped by the watermark."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, width), "key").agg(F.count(F.lit(1)).alias("n"))
