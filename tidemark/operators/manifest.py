"""Operators over the file manifest: (level, file_no, size, min_key, max_key, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered


def fold(edits: DataFrame) -> DataFrame:
    """Live files after a list of edits (version, level, file_no, action add or delete, ...): the last action on a file counts."""
    rest = [c for c in edits.columns if c not in ("level", "file_no")]
    last = edits.groupBy("level", "file_no").agg(F.max_by(F.struct(*rest), "version").alias("_e")).select("level", "file_no", *[F.col("_e")[c].alias(c) for c in rest])
    return last.filter(F.col("action") == "add").drop("action")


def overlapping(files: DataFrame, lo=None, hi=None) -> DataFrame:
    """Files whose closed key range meets [lo, hi]; None is open."""
    if hi is not None:
        files = files.filter(F.col("min_key") <= F.lit(hi))
    if lo is not None:
        files = files.filter(F.col("max_key") >= F.lit(lo))
    return files


def for_key(files: DataFrame, key) -> DataFrame:
    return overlapping(files, key, key)


def closure(files: DataFrame) -> DataFrame:
    """Files with ``island``: the groups that overlap, directly or through others (gaps and islands).

    Ranges of files by their least key hand on the greatest key so far and the
    number of islands begun.
    """
    order = [F.asc("min_key"), F.asc("max_key"), F.asc("file_no")]
    rows = ordered.ranged(files, *order)
    reach = ordered.carried(rows.groupBy("_part").agg(F.max("max_key").alias("m")), _reach=F.max("m").over(ordered.earlier()))
    here = Window.partitionBy("_part").orderBy(*order)
    before = F.greatest(F.max("max_key").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))  # nulls don't count
    marked = rows.join(reach, "_part").withColumn("_before", before)
    marked = marked.withColumn("_start", F.when(F.col("_before").isNull() | (F.col("min_key") > F.col("_before")), 1).otherwise(0))
    begun = ordered.carried(marked.groupBy("_part").agg(F.sum("_start").alias("n")), _begun=F.coalesce(F.sum("n").over(ordered.earlier()), F.lit(0)))
    island = F.col("_begun") + F.sum("_start").over(here.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(begun, "_part").withColumn("island", island).drop("_part", "_reach", "_before", "_start", "_begun")


def overlap_join(files: DataFrame, others: DataFrame) -> DataFrame:
    """``file_no`` and ``other_no`` of the pairs whose key ranges meet.

    The others are cut into ranges by their least key; a file is compared only
    with the ranges that it reaches into, found from one row per range.
    """
    cut = ordered.ranged(others.select(F.col("file_no").alias("other_no"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi")), F.asc("lo"))
    reach = F.broadcast(cut.groupBy("_part").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")))
    near = files.select("file_no", "min_key", "max_key").join(reach, (F.col("min_key") <= F.col("_hi")) & (F.col("max_key") >= F.col("_lo")))
    return near.join(cut, "_part").filter((F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo"))).select("file_no", "other_no")


def trivial_moves(files: DataFrame, level: int, target: int = 64 << 20, grandparents: int = 10) -> DataFrame:
    """``file_no`` and ``may_move`` of a level's files.

    A file may move down unread if it meets no file of the next level and less
    than ``grandparents`` target sizes of the level after that.
    """
    own = files.filter(F.col("level") == level)
    meets = overlap_join(own, files.filter(F.col("level") == level + 1)).select("file_no").distinct().withColumn("_meets", F.lit(True))
    below = files.filter(F.col("level") == level + 2)
    sizes = overlap_join(own, below).join(below.select(F.col("file_no").alias("other_no"), "file_size"), "other_no").groupBy("file_no").agg(F.sum("file_size").alias("_below"))
    few = F.coalesce("_below", F.lit(0)) < target * grandparents
    return own.select("file_no").join(meets, "file_no", "left").join(sizes, "file_no", "left").select("file_no", (F.col("_meets").isNull() & few).alias("may_move"))


def max_bytes(level: Column, base: int = 256 << 20, multiplier: int = 10, level0: int = 4 * (64 << 20)) -> Column:
    """The size a level may have; level 0 counts files instead."""
    return F.when(level == 0, F.lit(level0)).otherwise(F.lit(base) * F.pow(F.lit(float(multiplier)), level - 1)).cast("bigint")


def level_stats(files: DataFrame) -> DataFrame:
    """level, num_files, size_bytes; level 0 always, others if they have files."""
    got = files.groupBy("level").agg(F.count(F.lit(1)).alias("num_files"), F.sum("file_size").cast("bigint").alias("size_bytes"))
    zero = files.sparkSession.sql("SELECT CAST(0 AS INT) AS level, CAST(0 AS BIGINT) AS num_files, CAST(0 AS BIGINT) AS size_bytes")
    return got.unionByName(zero.join(got, "level", "left_anti"))


def scores(files: DataFrame, trigger: int = 4, base: int = 256 << 20, multiplier: int = 10) -> DataFrame:
    """level, score: how full each level from 0 to 5 is."""
    stats = level_stats(files).filter("level < 6")
    score = F.when(F.col("level") == 0, F.col("num_files") / F.lit(trigger)).otherwise(F.col("size_bytes") / max_bytes(F.col("level"), base, multiplier))
    return stats.select("level", score.cast("double").alias("score"))


def pick(files: DataFrame, trigger: int = 4, base: int = 256 << 20, multiplier: int = 10) -> DataFrame:
    """Input files of the next compaction: of the level with the best score above 1, and the overlapping ones below it.

    Level 0 gives all its files, another level its first; nothing is picked at
    scores of 1 or less.
    """
    best = scores(files, trigger, base, multiplier).filter("score > 1.0").orderBy(F.desc("score"), "level").limit(1).select(F.col("level").alias("_best"))
    own = files.join(F.broadcast(best), F.col("level") == F.col("_best"))
    first = Window.partitionBy("level").orderBy("min_key", "file_no")
    own = own.withColumn("_place", F.row_number().over(first)).filter((F.col("level") == 0) | (F.col("_place") == 1)).drop("_place")
    span = own.groupBy("_best").agg(F.min("min_key").alias("_lo"), F.max("max_key").alias("_hi"))
    below = files.join(F.broadcast(span), (F.col("level") == F.col("_best") + 1) & (F.col("min_key") <= F.col("_hi")) & (F.col("max_key") >= F.col("_lo")))
    return own.select(*files.columns).unionByName(below.select(*files.columns))
