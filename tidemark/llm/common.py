"""What the corpus operators share: reading tables, shared scratch tables, shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: words of most contracts: runs of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"

#: a side is broadcast only when its counted rows times its row width stay below this
BROADCAST_BYTES = 64 << 20

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode one is made where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    fs, where = _scratch_files(spark, path)
    fs.deleteOnExit(where)
    return path


def _scratch_files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: tables written by ``stash`` (held, so that their ids stay theirs) and their paths, until they are discarded
_stashed: dict[int, tuple[DataFrame, str]] = {}


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back.

    A lost executor costs no recomputation of what stands before it, and each
    consumer of the result reads columns from Parquet instead of running the
    plan again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stashed[id(out)] = (out, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the scratch files behind tables of ``stash`` once nothing reads them any more."""
    for df in tables:
        fs, where = _scratch_files(df.sparkSession, _stashed.pop(id(df))[1])
        fs.delete(where, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marks ``df`` for broadcast when its counted size is small; else leaves the choice to a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: rows of one key that a join keeps together
SPREAD = 4096


def hot_keys(loads: DataFrame, key: str) -> DataFrame | None:
    """The keys of ``loads`` (key, n) with more than SPREAD rows and the parts that each is dealt over; None without any.

    They are a SPREAD-th of all rows at most.
    """
    hot = loads.filter(F.col("n") > SPREAD)
    n = hot.count()
    return maybe_broadcast(hot.select(key, F.ceil(F.col("n") / SPREAD).cast("int").alias("_parts")), n, 40) if n else None


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (a row per key) on ``key``, where a key may hold any share of ``many``.

    The rows of a hot key (see ``hot_keys``) are dealt over its parts and the one
    row of the other side is put in each; without such keys it is a plain join.
    """
    if hot is None:
        return many.join(one, key, how)
    parts, part = fresh(many.join(one.limit(0), key), "_parts", "_part")
    hot = hot.withColumnRenamed("_parts", parts)
    at = F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), F.col(parts)).cast("int"))
    dealt = many.join(hot, key, "left").withColumn(part, at).drop(parts)
    copied = one.join(hot, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return dealt.join(copied, [key, part], how).drop(part)


#: Spark's own bound of an Arrow batch, and the one that Python workers of these operators get unless the session sets another
_BATCH, _SMALL_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"), "8m"


def ship(spark: SparkSession) -> None:
    """Sends these modules to the executors' Python, once a session; the rest of the library stays behind.

    Also bounds Arrow batches to a few MB, so long texts don't pile up in a worker.
    """
    if spark.conf.get(_BATCH[0]) == _BATCH[1]:
        spark.conf.set(_BATCH[0], _SMALL_BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(), "tidemark_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(f"{top.name}/__init__.py", "")
        for f in sorted((top / "llm").glob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that clash with none of ``df`` (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
