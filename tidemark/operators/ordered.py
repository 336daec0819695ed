"""One order over a whole table without a one-task sort.

The table is range-partitioned, sorted and written once to the folder that the
cluster names in ``spark.checkpoint.dir``; each range is then summed up in one
row, and only those rows, as many as there are partitions, meet in one task.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends; a local folder only in local mode and where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = f"file://{tempfile.gettempdir()}/tidemark-shared"
    path = f"{shared.rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``_part``: numbers of ranges that follow one another in the order.

    Written and read back, since ranges are drawn from a sample and must not
    change between two uses of the result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def carried(parts: DataFrame, **sums: Column) -> DataFrame:
    """``_part`` and window expressions over one row per range, for the ranges before or after each."""
    return F.broadcast(parts.select("_part", *[c.alias(n) for n, c in sums.items()]))


def by_part():
    """The window over the rows of ``carried``, one per range."""
    return Window.orderBy("_part")


def earlier():
    return by_part().rowsBetween(Window.unboundedPreceding, -1)


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``pos``, the place of each row in an order, from 1."""
    rows = ranged(df, *order)
    before = carried(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), _before=F.coalesce(F.sum("n").over(earlier()), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.join(before, "_part").withColumn("pos", F.col("_before") + within).drop("_part", "_before")


def running_totals(totals: DataFrame, key: str, amount: str, fan: int = 4096) -> DataFrame:
    """``key`` (whole numbers) and ``before``, the amounts of all smaller keys.

    Keys are summed up in groups of ``fan`` and these once more, so the last
    window, over the groups of groups, has a row per fan * fan keys of the span.
    """
    rows = totals.select(F.col(key), F.col(amount).alias("_a"), F.floor(F.col(key) / fan).alias("_g"))
    groups = rows.groupBy("_g").agg(F.sum("_a").alias("_a")).withColumn("_h", F.floor(F.col("_g") / fan))
    tops = groups.groupBy("_h").agg(F.sum("_a").alias("_a"))
    less = lambda *part, by: F.sum("_a").over(Window.partitionBy(*part).orderBy(by)) - F.col("_a")
    tops = tops.select("_h", (F.sum("_a").over(Window.orderBy("_h")) - F.col("_a")).alias("_top"))
    groups = groups.withColumn("_in", less("_h", by="_g")).join(tops, "_h").select("_g", (F.col("_top") + F.col("_in")).alias("_top"))
    return rows.withColumn("_in", less("_g", by=key)).join(groups, "_g").select(key, (F.col("_top") + F.col("_in")).alias("before"))
