"""Queries over the driver's tables, each with its SQL.

``events`` is read as a change log: key ``user:NNNNN``, seq = event_id + 1, an
``error`` event is a tombstone, any other event puts its props.  The file
manifest of level queries is made from that log: a fifth of it lies in level 0
by sequence, the rest in levels 1 and 2 by key range.

Reads go through a store that holds the log, written once a session: its older
half compacted into level 1, the rest in two runs of level 0.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom, codec, metrics
from tidemark.operators import batch, compact, manifest, ordered, scan, txn, visibility
from tidemark.options import Options
from tidemark.schema import DELETE, PUT
from tidemark.sources.store import Store

#: the largest number whose cube is a bigint
LAST_CUBE = 2097151

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LOG = """log AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS key, event_id + 1 AS seq,
  CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, CASE WHEN event_type <> 'error' THEN props END AS value FROM events)"""
_FILES = (
    _LOG
    + """, placed AS (SELECT *, CASE WHEN seq % 10 < 2 THEN 0 WHEN seq % 10 < 5 THEN 1 ELSE 2 END AS level, CAST(substr(key, 6) AS INT) AS u FROM log),
files AS (SELECT level, CAST(level * 100000 + CASE level WHEN 0 THEN seq // 500 WHEN 1 THEN u // 20 ELSE u // 10 END AS BIGINT) AS file_no,
  CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 16) AS BIGINT) AS file_size, min(key) AS min_key, max(key) AS max_key,
  min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS n FROM placed GROUP BY 1, 2)"""
)


def _newest(source: str, cond: str = "true") -> str:
    return f"(SELECT * FROM {source} WHERE {cond} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


def _vis(cond: str = "true", source: str = "log") -> str:
    return f"(SELECT key, seq, value FROM {_newest(source, cond)} WHERE op = 1)"


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    error = F.col("event_type") == "error"
    return events.select(
        F.format_string("user:%05d", "user_id").alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(error, DELETE).otherwise(PUT).alias("op"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("value"),
    )


def kv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("seq") % 10 < 2, 0).when(F.col("seq") % 10 < 5, 1).otherwise(2)
    u = F.substring("key", 6, 5).cast("int")
    part = F.when(level == 0, F.floor(F.col("seq") / 500)).when(level == 1, F.floor(u / 20)).otherwise(F.floor(u / 10))
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 16
    return (
        kv_log(spark, sf_dir)
        .groupBy(level.alias("level"), (level * 100000 + part).cast("bigint").alias("file_no"))
        .agg(F.sum(size).cast("bigint").alias("file_size"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("n"))
    )


_stores: dict[tuple[str, str], Store] = {}


def kv_store(spark: SparkSession, sf_dir: str) -> Store:
    """The log as a store in the shared folder, built on first use; nothing of its history is dropped."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stores:
        path = urlparse(ordered.scratch_path(spark, "store"))
        if path.scheme not in ("", "file"):
            raise ValueError(f"a store needs a mounted folder, spark.checkpoint.dir is {path.scheme}:")
        store = Store.open(spark, path.path, Options(compression="lz4", target_file_size_base=16 << 20))
        all_of_it = store.snapshot()
        ops = kv_log(spark, sf_dir).select(F.col("seq").alias("ord"), F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value"))
        last = ops.agg(F.max("ord")).first()[0] or 0
        store.load(ops.filter(F.col("ord") <= last // 2))
        store.compact()
        store.load(ops.filter((F.col("ord") > last // 2) & (F.col("ord") <= last * 3 // 4)))
        store.load(ops.filter(F.col("ord") > last * 3 // 4))
        all_of_it.release()
        _stores[at] = store
    return _stores[at]


def _text(df: DataFrame) -> DataFrame:
    """Binary columns as text."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def _query(sql: str, files: bool = False, source=None):
    """Registers a function of the log (or the manifest) under its name, with its SQL."""

    def add(f):
        make = source or (kv_files if files else kv_log)
        QUERIES[f.__name__] = lambda spark, sf_dir: f(make(spark, sf_dir))
        SQL[f.__name__] = f"WITH {_FILES if files else _LOG} {sql}"
        return f

    return add


def _read(sql: str):
    """Registers a function of the store that holds the log."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _text(f(kv_store(spark, sf_dir)))
        SQL[f.__name__] = f"WITH {_LOG} {sql}"
        return f

    return add


# -- point reads and scans -----------------------------------------------------------------------


@_read(f"SELECT key, value FROM {_vis()} WHERE key >= 'user:00050'")
def scan_from(store):
    return store.scan(start=b"user:00050")


@_query("SELECT key, seq, op, value FROM log WHERE key = 'user:00007' AND seq BETWEEN 2501 AND 5000")
def run_exact_get(log):
    return log.filter(F.col("seq").between(2501, 5000) & (F.col("key") == "user:00007")).select("key", "seq", "op", "value")


@_query(f"SELECT key, seq, op, value FROM {_newest('log', 'seq BETWEEN 2501 AND 4000')} WHERE key = 'user:00007'")
def run_mvcc_get(log):
    return visibility.newest(log.filter((F.col("seq") >= 2501) & (F.col("key") == "user:00007")), 4000).select("key", "seq", "op", "value")


@_query("SELECT key, seq, op, value FROM log WHERE seq BETWEEN 2501 AND 5000")
def run_scan(log):
    return log.filter(F.col("seq").between(2501, 5000)).select("key", "seq", "op", "value")


@_read("SELECT key, value FROM log WHERE key = 'user:00007' QUALIFY row_number() OVER (ORDER BY seq DESC) = 1 AND op = 1")
def point_get(store):
    return visibility.visible(store.log(b"user:00007", b"user:00007")).select("key", "value")


@_read(f"SELECT key, value FROM {_vis('seq <= 5000')} WHERE key IN ('user:00003', 'user:00007', 'user:00011')")
def get_as_of(store):
    keys = [b"user:00003", b"user:00007", b"user:00011"]
    return visibility.visible(store.log(keys[0], keys[-1]).filter(F.col("key").isin(*keys)), 5000).select("key", "value")


def _wanted(spark: SparkSession) -> DataFrame:
    return spark.range(0, 400, 20).select(F.format_string("user:%05d", "id").cast("binary").alias("key"))


@_read(
    f"""SELECT k.key, CASE WHEN n.op IS NULL THEN 'NotFound' WHEN n.op = 2 THEN 'Deleted' ELSE 'Found' END AS status, CASE WHEN n.op = 1 THEN n.value END AS value
  FROM (SELECT 'user:' || lpad(CAST(i * 20 AS VARCHAR), 5, '0') AS key FROM range(20) t(i)) k LEFT JOIN {_newest('log')} n ON k.key = n.key"""
)
def lookup_status(store):
    return store.multi_get(_wanted(store.spark))


@_read(f"SELECT k.key, n.value FROM (SELECT 'user:' || lpad(CAST(i * 20 AS VARCHAR), 5, '0') AS key FROM range(20) t(i)) k LEFT JOIN {_vis('seq <= 8000')} n ON k.key = n.key")
def multi_get(store):
    return store.multi_get(_wanted(store.spark), 8000).select("key", "value")


@_read(f"SELECT count(*) > 0 AS present FROM {_vis()} WHERE key = 'user:00007'")
def contains(store):
    return visibility.visible(store.log(b"user:00007", b"user:00007")).agg((F.count(F.lit(1)) > 0).alias("present"))


@_read(f"SELECT key, value FROM {_vis()}")
def scan_all(store):
    return store.scan()


@_read(f"SELECT key, value FROM {_vis()} WHERE key >= 'user:00010' AND key < 'user:00020'")
def scan_range(store):
    return store.scan(start=b"user:00010", end=b"user:00020")


@_read(f"SELECT key, value FROM {_vis('seq <= 5000')} WHERE starts_with(key, 'user:0001')")
def scan_prefix(store):
    return store.scan(5000, prefix=b"user:0001")


def _bounds(name: str, lo: str, hi: str, **kw) -> None:
    def f(store):
        return store.scan(start=b"user:00010", end=b"user:00020", **kw)

    f.__name__ = name
    _read(f"SELECT key, value FROM {_vis()} WHERE key {lo} 'user:00010' AND key {hi} 'user:00020'")(f)


_bounds("scan_bounds_ii", ">=", "<=", end_inclusive=True)
_bounds("scan_bounds_ie", ">=", "<")
_bounds("scan_bounds_ei", ">", "<=", start_exclusive=True, end_inclusive=True)
_bounds("scan_bounds_ee", ">", "<", start_exclusive=True)


@_read(f"SELECT key, value, row_number() OVER (ORDER BY key DESC) AS pos FROM {_vis()} WHERE key < 'user:00030'")
def scan_reverse(store):
    return scan.scan_positions(store.log(None, b"user:00030"), end=b"user:00030", reverse=True)


@_read(f"SELECT key, value FROM {_vis('seq <= 3000')}")
def scan_as_of(store):
    return store.scan(3000)


@_read(f"SELECT key, value FROM {_vis()} WHERE key >= 'user:00010x' ORDER BY key LIMIT 1")
def seek_ge(store):
    return scan.seek(store.log(b"user:00010x", None), b"user:00010x")


@_read(f"SELECT key, value FROM {_vis()} WHERE key <= 'user:00010x' ORDER BY key DESC LIMIT 1")
def seek_le(store):
    return scan.seek(store.log(None, b"user:00010x"), b"user:00010x", backward=True)


@_read(f"SELECT min(key) AS first_key, max(key) AS last_key, count(*) AS n FROM {_vis()}")
def first_last(store):
    return scan.ends(store.log())


@_read(f"SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM {_vis()}")
def neighbours(store):
    return scan.neighbours(store.log())


@_read(f"SELECT count(*) AS n FROM {_vis()} WHERE key >= 'user:00010' AND key < 'user:00100'")
def count_range(store):
    return store.scan(start=b"user:00010", end=b"user:00100").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT substr(key, 1, 9) AS prefix, count(*) AS n FROM {_vis()} GROUP BY 1")
def count_by_prefix(log):
    return visibility.visible(log).groupBy(F.substring("key", 1, 9).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT count(*) AS n, CAST(sum(strlen(value)) AS BIGINT) AS bytes, min(value) AS least, max(seq) AS newest FROM {_vis()}")
def scan_agg(log):
    return visibility.visible(log).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).cast("bigint").alias("bytes"), F.min("value").alias("least"), F.max("seq").alias("newest"))


@_read(f"SELECT key, value FROM {_vis()} ORDER BY key LIMIT 10")
def scan_limit(store):
    return store.scan().limit(10)


@_read(f"SELECT key, value FROM {_vis()} WHERE key >= 'user:00010' AND key < 'user:00100' ORDER BY key DESC LIMIT 7")
def scan_range_reverse(store):
    return store.scan(start=b"user:00010", end=b"user:00100", reverse=True).limit(7)


# -- versions ------------------------------------------------------------------------------------


@_read(f"SELECT key, seq, value FROM {_vis('seq <= 5000')}")
def visible_as_of(store):
    return visibility.visible(store.log(), 5000)


@_query("SELECT max(seq) AS seq FROM log")
def snapshot_seq(log):
    return log.agg(F.max("seq").alias("seq"))


@_read("SELECT key, seq, op, value FROM log WHERE key = 'user:00007'")
def version_history(store):
    return visibility.history(store.log(b"user:00007", b"user:00007"), b"user:00007").select("key", "seq", "op", "value")


@_query("SELECT (seq - 1) // 2500 AS run, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS n FROM log GROUP BY 1")
def run_seq_bounds(log):
    return log.groupBy(F.floor((F.col("seq") - 1) / 2500).alias("run")).agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("n"))


@_read(
    f"""SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.seq IS NULL THEN 'added' WHEN b.seq IS NULL THEN 'removed' ELSE 'changed' END AS change,
  a.value AS old_value, b.value AS new_value FROM {_vis('seq <= 4000')} a FULL JOIN {_vis('seq <= 8000')} b ON a.key = b.key WHERE a.seq IS DISTINCT FROM b.seq"""
)
def snapshot_diff(store):
    return visibility.diff(store.log(), 4000, 8000)


# -- writes --------------------------------------------------------------------------------------


@_query(f"""SELECT key, value FROM {_vis()} WHERE CAST(substr(key, 6) AS INT) % 7 <> 0
  UNION ALL SELECT DISTINCT key, 'new of ' || key FROM log WHERE CAST(substr(key, 6) AS INT) % 7 = 0""")
def put_overwrite(log):
    """Every seventh user is put twice in one commit: the second value counts, whatever stood there."""
    keys = log.filter(F.substring("key", 6, 5).cast("int") % 7 == 0).select("key").distinct()
    put = lambda ord, what: keys.select(F.lit(ord).cast("bigint").alias("ord"), "key", F.lit(PUT).alias("op"), F.concat(F.lit(what), "key").alias("value"))
    return visibility.visible(txn.commit(log, put(1, "old of ").unionByName(put(2, "new of ")), 1 << 40)).select("key", "value")


@_query(f"SELECT count(*) AS n, count(*) FILTER (WHERE key = 'user:00007') AS of_key FROM {_vis()} WHERE key <> 'user:00007'")
def delete_hides(log):
    gone = log.sparkSession.createDataFrame([(1, "user:00007", DELETE, None)], "ord bigint, key string, op int, value string")
    return visibility.visible(txn.commit(log, gone, 1 << 40)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("key") == "user:00007").alias("of_key"))


@_query("SELECT key, op, value, 1000000 + row_number() OVER (ORDER BY seq) AS seq FROM log")
def batch_apply(log):
    ops = log.select(F.col("seq").alias("ord"), "key", "op", "value")
    return batch.assign_sequences(ops, 1000000).select("key", "op", "value", "seq")


@_query(
    """SELECT (seq - 1) // 100 AS batch, count(*) AS n, count(*) FILTER (WHERE op = 2) AS deletes,
  CAST(sum(CASE WHEN op = 1 THEN strlen(key) + strlen(value) + 16 ELSE strlen(key) + 8 END) AS BIGINT) AS approximate_size FROM log GROUP BY 1"""
)
def batch_stats(log):
    return log.groupBy(F.floor((F.col("seq") - 1) / 100).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("op") == DELETE).alias("deletes"), F.sum(batch.entry_size()).cast("bigint").alias("approximate_size"))


_RUN_SQL = """sized AS (SELECT *, strlen(key) + CASE WHEN op = 1 THEN coalesce(strlen(value), 0) ELSE 0 END + 8 + 64 AS size FROM log),
 runs AS (SELECT *, CAST(sum(size) OVER (ORDER BY seq) - size AS BIGINT) // 65536 AS run FROM sized)"""


@_query(f", {_RUN_SQL} SELECT run, count(*) AS n, min(seq) AS min_seq, max(seq) AS max_seq, min(key) AS min_key, max(key) AS max_key FROM runs GROUP BY run")
def flush_runs(log):
    runs = batch.flush_runs(log, 65536)
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@_query(f"SELECT key, seq, value FROM {_vis('seq <= 7000')}")
def flush_invariant(log):
    runs = batch.flush_runs(log, 65536)
    per_run = runs.filter("seq <= 7000").groupBy("run", "key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("v")).select("key", "seq", "v.op", "v.value")
    return visibility.visible(per_run)


@_query("SELECT key, seq, op, value FROM log WHERE seq <= 6000 UNION ALL SELECT key, 6000 + row_number() OVER (ORDER BY seq) AS seq, op, value FROM log WHERE seq > 6000")
def wal_replay(log):
    base = log.filter("seq <= 6000")
    tail = log.filter("seq > 6000").select(F.col("seq").alias("ord"), "key", "op", "value")
    return base.select("key", "seq", "op", "value").unionByName(batch.assign_sequences(tail, 6000).select("key", "seq", "op", "value"))


# -- transactions --------------------------------------------------------------------------------

_WRITES = [(1, "user:00003", PUT, "mine"), (2, "user:00007", DELETE, None), (3, "zzz", PUT, "a"), (4, "zzz", PUT, "b")]


def _writes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_WRITES, "ord bigint, key string, op int, value string")


@_query(f"SELECT key, value FROM {_vis('seq <= 5000')} WHERE key NOT IN ('user:00003', 'user:00007') UNION ALL SELECT 'user:00003', 'mine' UNION ALL SELECT 'zzz', 'b'")
def txn_read_your_writes(log):
    return txn.overlay(log, _writes(log.sparkSession), 5000)


@_query(f"SELECT key, value FROM {_vis()} WHERE key NOT IN ('user:00003', 'user:00007') UNION ALL SELECT 'user:00003', 'mine' UNION ALL SELECT 'zzz', 'b'")
def txn_commit_result(log):
    return visibility.visible(txn.commit(log, _writes(log.sparkSession), 1 << 40)).select("key", "value")


@_query("SELECT DISTINCT key FROM log WHERE seq > 9900 AND key IN (SELECT 'user:' || lpad(CAST(i AS VARCHAR), 5, '0') FROM range(30) t(i))")
def txn_conflicts(log):
    reads = log.sparkSession.range(30).select(F.format_string("user:%05d", "id").alias("key"))
    return txn.conflicts(log, reads, 9900)


@_query("SELECT DISTINCT key FROM log WHERE seq > 9000 AND key IN ('user:00003', 'user:00007', 'zzz')")
def txn_ww_conflicts(log):
    return txn.conflicts(log, _writes(log.sparkSession), 9000)


# -- merge and compaction ------------------------------------------------------------------------


@_query("SELECT key, seq, op, value FROM log")
def merge_runs(log):
    """All versions of four interleaved runs as one."""
    return compact.merge_runs(*[log.filter(F.col("seq") % 4 == i) for i in range(4)]).select("key", "seq", "op", "value")


@_query(f"SELECT key, seq, op, value FROM {_newest('log')}")
def compact_keep_newest(log):
    return compact.keep_newest(log)


_SAFE = f"(SELECT key, seq, op, value FROM log WHERE seq > 6000 UNION ALL SELECT key, seq, op, value FROM {_newest('log', 'seq <= 6000')})"


@_query(f"SELECT * FROM {_SAFE}")
def compact_snapshot_safe(log):
    return compact.snapshot_safe(log, 6000)


@_query(f"SELECT * FROM {_SAFE} WHERE NOT (op = 2 AND seq <= 6000)")
def compact_drop_tombstones(log):
    return compact.drop_tombstones(compact.snapshot_safe(log, 6000), 6000)


@_query(f"SELECT key, seq, op, value FROM {_newest('log')} WHERE op = 2 OR strlen(value) % 2 = 0")
def compact_filter(log):
    return compact.apply_filter(compact.keep_newest(log), F.octet_length("value") % 2 == 0)


@_query(f"SELECT key, seq, op, value FROM {_newest('log')} WHERE op = 2 OR NOT (seq < 10000 - 300)")
def compact_ttl(log):
    return compact.apply_filter(compact.keep_newest(log), compact.ttl_filter(300, 10000))


@_query(f"SELECT key, seq, value FROM {_vis('seq <= 8000')}")
def compact_invariant(log):
    kept = compact.drop_tombstones(compact.snapshot_safe(log, 6000), 6000)
    return visibility.visible(kept, 8000)


@_query(
    f""", i AS (SELECT count(*) AS entries_in, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 16) AS BIGINT) AS bytes_in FROM log),
  o AS (SELECT count(*) AS entries_out, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 16) AS BIGINT) AS bytes_out FROM {_newest('log')})
  SELECT *, entries_in - entries_out AS dropped, bytes_out / bytes_in AS space_amp, entries_out / entries_in AS write_amp FROM i, o"""
)
def compaction_stats(log):
    return compact.statistics(log, compact.keep_newest(log))


# -- manifest ------------------------------------------------------------------------------------

_EDITS = """, edits AS (SELECT 1 AS version, 'add' AS action, level, file_no, file_size FROM files UNION ALL SELECT 2, 'delete', level, file_no, file_size FROM files WHERE file_no % 3 = 0
  UNION ALL SELECT 3, 'add', level, file_no, file_size * 2 FROM files WHERE file_no % 6 = 0)"""


@_query(_EDITS + " SELECT level, file_no, file_size FROM (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY level, file_no ORDER BY version DESC) = 1) WHERE action = 'add'", files=True)
def manifest_fold(files):
    edit = lambda df, version, action, size=F.col("file_size"): df.select(F.lit(version).alias("version"), F.lit(action).alias("action"), "level", "file_no", size.alias("file_size"))
    edits = edit(files, 1, "add").unionByName(edit(files.filter("file_no % 3 = 0"), 2, "delete")).unionByName(edit(files.filter("file_no % 6 = 0"), 3, "add", F.col("file_size") * 2))
    return manifest.fold(edits).select("level", "file_no", "file_size")


@_query("SELECT level, file_no, min_key, max_key FROM files WHERE min_key <= 'user:00042' AND max_key >= 'user:00042'", files=True)
def files_for_key(files):
    return manifest.for_key(files, "user:00042").select("level", "file_no", "min_key", "max_key")


@_query("SELECT level, file_no FROM files WHERE level = 2 AND min_key <= 'user:00060' AND max_key >= 'user:00025'", files=True)
def manual_pick(files):
    return manifest.overlapping(files.filter("level = 2"), "user:00025", "user:00060").select("level", "file_no")


@_query("SELECT a.file_no AS file_no, b.file_no AS other_no FROM files a JOIN files b ON b.level = a.level + 1 AND a.min_key <= b.max_key AND a.max_key >= b.min_key WHERE a.level = 1", files=True)
def overlapping_files(files):
    return manifest.overlap_join(files.filter("level = 1"), files.filter("level = 2"))


@_query(
    """, own AS (SELECT * FROM files WHERE level = 0),
  meets AS (SELECT DISTINCT o.file_no FROM own o JOIN files f ON f.level = 1 AND o.min_key <= f.max_key AND o.max_key >= f.min_key AND f.file_no % 7 > 0),
  below AS (SELECT o.file_no, sum(f.file_size) AS size FROM own o JOIN files f ON f.level = 2 AND o.min_key <= f.max_key AND o.max_key >= f.min_key GROUP BY 1)
  SELECT o.file_no, m.file_no IS NULL AND coalesce(b.size, 0) < 10 * 5000 AS may_move FROM own o LEFT JOIN meets m USING (file_no) LEFT JOIN below b USING (file_no)""",
    files=True,
)
def trivial_moves(files):
    return manifest.trivial_moves(files.filter("level <> 1 OR file_no % 7 > 0"), 0, 5000)


@_query(
    """, marked AS (SELECT *, CASE WHEN min_key > max(max_key) OVER w THEN 1 WHEN max(max_key) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM files WHERE level > 0
  WINDOW w AS (ORDER BY min_key, max_key, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT file_no, CAST(sum(s) OVER (ORDER BY min_key, max_key, file_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM marked""",
    files=True,
)
def overlap_closure(files):
    return manifest.closure(files.filter("level > 0")).select("file_no", F.col("island").cast("bigint").alias("island"))


_STATS = """, stats AS (SELECT level, count(*) AS num_files, CAST(sum(file_size) AS BIGINT) AS size_bytes FROM files GROUP BY level)"""


@_query(_STATS + " SELECT * FROM stats UNION ALL SELECT 0, 0, 0 WHERE NOT EXISTS (SELECT 1 FROM stats WHERE level = 0)", files=True)
def level_stats(files):
    return manifest.level_stats(files)


_SCORES = _STATS + ", scores AS (SELECT level, CAST(CASE WHEN level = 0 THEN num_files / 4.0::DOUBLE ELSE size_bytes / CAST(100000 * pow(10.0, level - 1) AS BIGINT) END AS DOUBLE) AS score FROM stats WHERE level < 6)"


@_query(_SCORES + " SELECT * FROM scores", files=True)
def compaction_score(files):
    return manifest.scores(files, 4, 100000)


@_query(
    _SCORES
    + """, best AS (SELECT level FROM scores WHERE score > 1 ORDER BY score DESC, level LIMIT 1),
  own AS (SELECT f.* FROM files f JOIN best USING (level) QUALIFY level = 0 OR row_number() OVER (PARTITION BY level ORDER BY min_key, file_no) = 1),
  span AS (SELECT level, min(min_key) AS lo, max(max_key) AS hi FROM own GROUP BY level)
  SELECT level, file_no FROM own UNION ALL SELECT f.level, f.file_no FROM files f JOIN span s ON f.level = s.level + 1 AND f.min_key <= s.hi AND f.max_key >= s.lo""",
    files=True,
)
def compaction_pick(files):
    return manifest.pick(files, 4, 100000).select("level", "file_no")


@_query("SELECT level, count(*) AS files, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(file_size) AS BIGINT) AS bytes FROM files GROUP BY level", files=True)
def compaction_stats_by_level(files):
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("entries"), F.sum("file_size").alias("bytes"))


@_query("SELECT file_no, greatest(100, file_size // 16384) AS allowed_seeks FROM files", files=True)
def file_allowed_seeks(files):
    return files.select("file_no", F.greatest(F.lit(100), F.floor(F.col("file_size") / 16384)).cast("bigint").alias("allowed_seeks"))


@_query("SELECT CAST(level AS INT) AS level, CAST(CASE WHEN level = 0 THEN 4 * 67108864 ELSE 268435456 * pow(10.0, level - 1) END AS BIGINT) AS max_bytes FROM range(7) t(level)", files=True)
def level_targets(files):
    return files.sparkSession.range(7).select(F.col("id").cast("int").alias("level")).withColumn("max_bytes", manifest.max_bytes(F.col("level")))


@_query(
    """, named AS (SELECT lpad(CAST(file_no AS VARCHAR), 6, '0') || CASE level WHEN 0 THEN '.log' WHEN 1 THEN '.parquet' ELSE '.tmp' END AS name FROM files)
  SELECT name, CAST(regexp_extract(name, '^([0-9]+)[.]', 1) AS BIGINT) AS number, CASE regexp_extract(name, '[.]([a-z]+)$', 1) WHEN 'log' THEN 'commit' WHEN 'parquet' THEN 'table' ELSE 'temporary' END AS kind FROM named""",
    files=True,
)
def parse_file_name(files):
    from tidemark.sources.names import kind_of, number_of

    ending = F.when(F.col("level") == 0, ".log").when(F.col("level") == 1, ".parquet").otherwise(".tmp")
    name = F.concat(F.lpad(F.col("file_no").cast("string"), 6, "0"), ending)
    return files.select(name.alias("name")).select("name", number_of(F.col("name")).alias("number"), kind_of(F.col("name")).alias("kind"))


# -- functions and metrics -----------------------------------------------------------------------


@_query("SELECT count(DISTINCT key) AS n, count(DISTINCT key) AS found FROM log")
def bloom_no_false_negatives(log):
    keys = log.select("key").distinct()
    bits, m, k = bloom.build(keys, keys.count())
    probed = bloom.may_contain(keys, bits, m, k)
    return probed.agg(F.count(F.lit(1)).alias("n"), F.count_if("maybe").alias("found"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor("o_totalprice").alias("v"))


_CELLS = ", ".join(f"count(*) FILTER (WHERE v < {hi}" + (f" AND v >= {lo}" if lo else "") + f") AS lt_{hi}" for lo, hi in zip([0, *metrics.BOUNDS], metrics.BOUNDS))


@_query(f", vs AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders) SELECT count(v) AS count, CAST(sum(v) AS BIGINT) AS sum, min(v) AS min, max(v) AS max, avg(v) AS mean, {_CELLS}, count(*) FILTER (WHERE v >= {metrics.BOUNDS[-1]}) AS rest FROM vs", source=_values)
def histogram_buckets(values):
    return metrics.histogram(values, F.col("v"))


@_query(
    """, vs AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders), per AS (SELECT CAST(pow(10, length(CAST(v AS VARCHAR))) AS BIGINT) AS le, count(*) AS n FROM vs GROUP BY 1)
  SELECT le, CAST(sum(n) OVER (ORDER BY le) AS BIGINT) AS n FROM per""",
    source=_values,
)
def histogram_cumulative(values):
    return metrics.cumulative(values, F.col("v"))


@_query("SELECT key, count(*) FILTER (WHERE op = 1) AS hits, count(*) FILTER (WHERE op = 2) AS misses, count(*) FILTER (WHERE op = 1) / count(*) AS rate FROM log GROUP BY key")
def hit_rate(log):
    per = log.groupBy("key").agg(F.count_if(F.col("op") == PUT).alias("hits"), F.count_if(F.col("op") == DELETE).alias("misses"))
    return per.withColumn("rate", metrics.rate(F.col("hits"), F.col("misses")))


@_query("SELECT key, seq, hex(key) || lpad(hex(seq * 256 + op), 16, '0') AS encoded FROM log")
def internal_key_codec(log):
    encoded = log.withColumn("encoded", codec.internal_key_hex(F.col("key"), F.col("seq"), F.col("op")))
    parts = encoded.withColumn("p", codec.internal_key_parts(F.col("encoded")))
    return parts.select(F.unhex("p.key_hex").cast("string").alias("key"), F.col("p.seq").alias("seq"), "encoded")


@_query("SELECT seq * seq * seq AS n, CAST((length(bin(seq * seq * seq)) + 6) // 7 AS INT) AS length FROM log")
def varint_length(log):
    """n is a bigint as in the SQL, or a decimal when that does not hold the largest cube."""
    seq = F.col("seq")
    if (log.agg(F.max("seq")).first()[0] or 0) > LAST_CUBE:
        seq = seq.cast("decimal(20,0)")
    return log.select((seq * seq * seq).alias("n")).select("n", codec.varint_length(F.col("n")).alias("length"))


@_query("SELECT seq * 429496 % 4294967296 AS crc, ((crc >> 15) + (crc % 32768) * 131072 + 2726488792) % 4294967296 AS masked, crc AS back FROM log")
def crc_mask_roundtrip(log):
    crc = (F.col("seq") * 429496) % F.lit(1 << 32)
    masked = log.select(crc.alias("crc")).withColumn("masked", codec.masked_crc(F.col("crc")))
    return masked.withColumn("back", codec.unmasked_crc(F.col("masked")))


def _cents(shift: int) -> str:
    n, half = "n * 100", 1 << shift - 1
    whole, rest = f"(({n}) >> {shift})", f"(({n}) % {1 << shift})"
    return f"{whole} + CASE WHEN {rest} > {half} OR ({rest} = {half} AND {whole} % 2 = 1) THEN 1 ELSE 0 END"


@_query(
    f""", ns AS (SELECT seq, seq * seq * seq AS n FROM log), cents AS (SELECT *, {_cents(10)} AS k, {_cents(20)} AS m, {_cents(30)} AS g FROM ns)
  SELECT seq, CASE WHEN n >= 1073741824 THEN (g // 100) || '.' || lpad(CAST(g % 100 AS VARCHAR), 2, '0') || ' GB'
    WHEN n >= 1048576 THEN (m // 100) || '.' || lpad(CAST(m % 100 AS VARCHAR), 2, '0') || ' MB'
    WHEN n >= 1024 THEN (k // 100) || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || ' KB' ELSE n || ' B' END AS text FROM cents"""
)
def format_bytes(log):
    seq, wide = F.col("seq"), F.col("seq").cast("decimal(20,0)")
    ns = log.select("seq", F.when(seq <= LAST_CUBE, seq * seq * seq).alias("n"), F.when(seq > LAST_CUBE, wide * wide * wide).alias("m"))
    return ns.select("seq", F.coalesce(codec.format_bytes(F.col("n")), codec.format_bytes(F.col("m"))).alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live pairs under a prefix, as of sequence 500."""
    return scan.scan(kv_log(spark, sf_dir), prefix="user:0000", seq=500)
