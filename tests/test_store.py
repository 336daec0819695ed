import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import Options, Store, WriteBatch, errors
from tidemark.operators import compact


def live(store, **kw):
    return {bytes(r["key"]): bytes(r["value"]) for r in store.scan(**kw).collect()}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def test_life_of_a_store(spark, path):
    with Store.open(spark, path) as s:
        s.put(b"user:1", b"a")
        s.put(b"user:2", b"b")
        s.put(b"user:2", b"b2")
        s.delete(b"user:1")
        s.write(WriteBatch().put(b"k", b"").put(b"\x00\x01\xff", b"x").delete(b"none"))
        assert s.get(b"user:2") == b"b2" and s.get(b"user:1") is None and s.get(b"k") == b"" and not s.contains(b"zz")
        before = live(s)
        s.flush()
        assert live(s) == before
        s.delete(b"user:2")
        s.flush()
        assert s.get(b"user:2") is None  # a tombstone in a newer run hides older runs
        with pytest.raises(errors.DatabaseLocked):
            Store.open(spark, path)
    s.close()
    with pytest.raises(errors.DatabaseClosed):
        s.put(b"a", b"b")
    with Store.open(spark, path) as s:
        assert live(s) == {b"k": b"", b"\x00\x01\xff": b"x"} and s.sequence == 8
        s.put(b"user:2", b"again")
        assert s.get(b"user:2") == b"again"
    with pytest.raises(errors.DatabaseExists):
        Store.open(spark, path, Options(error_if_exists=True))
    with pytest.raises(errors.DatabaseNotFound):
        Store.open(spark, path + "2", Options(create_if_missing=False))


def test_replay_after_a_crash_and_torn_tail(spark, path):
    s = Store.open(spark, path, Options(sync_mode="always"))
    s.put(b"a", b"1")
    s.put(b"a", b"2")
    log = os.path.join(path, f"{s._log_file:06}.log")
    s._lock.close()  # no close: as after a crash
    with open(log, "ab") as f:
        f.write(b"\x50\x00\x00\x00torn")
    with Store.open(spark, path) as s:
        assert s.get(b"a") == b"2" and s.sequence == 2
        s.put(b"x", b"y")
        assert s.get(b"a") == b"2"


def test_keys_with_nul_and_ff(spark, path):
    with Store.open(spark, path) as s:
        for k in (b"a", b"a\0", b"a\0\0", b"p\xff", b"p\xff\x01", b"q"):
            s.put(k, k)
        s.flush()
        assert all(s.get(k) == k for k in (b"a", b"a\0", b"a\0\0"))
        assert list(live(s, prefix=b"p\xff")) == [b"p\xff", b"p\xff\x01"]
        assert list(live(s, start=b"a\0", end=b"q", reverse=True)) == [b"p\xff\x01", b"p\xff", b"a\0\0", b"a\0"]
        c = s.cursor()
        c.seek(b"a\0x")
        assert c.key() == b"p\xff"
        c.next()
        assert c.value() == b"p\xff\x01" and c.count() == 6
        c.seek(b"z")
        assert not c.valid()
        with pytest.raises(errors.IteratorError):
            c.key()


def test_snapshots_survive_compaction(spark, path):
    with Store.open(spark, path) as s:
        for i in range(4):
            s.put(b"k", str(i).encode())
            s.put(b"gone", b"x")
            s.flush()
        held = s.snapshot()
        s.put(b"k", b"new")
        s.delete(b"gone")
        s.compact()
        assert s.get(b"k", held) == b"3" and s.get(b"gone", held) == b"x"
        assert s.get(b"k") == b"new" and s.get(b"gone") is None
        del held
        stats = s.compact()
        assert stats["entries_out"] == 1 and live(s) == {b"k": b"new"}
        assert s.stats()["key_count"] == 1 and "level 1: 1 files" in s.summary()
        with pytest.raises(errors.InvalidConfiguration):
            s.compact(level=6)


def test_filters_and_levels(spark, path):
    with Store.open(spark, path, Options(l0_compaction_trigger=2, compression="lz4")) as s:
        for i in range(3):
            s.put(b"a%d" % i, b"v%d" % i)
            s.flush()
        assert s.maybe_compact()["files_out"] == 1 and s.maybe_compact() is None
        s.compact(level=1)
        assert {f["level"] for f in s.files.values()} == {2}
        s.compact(keep=compact.ttl_filter(1, s.sequence))
        assert list(live(s)) == [b"a1", b"a2"]
        s.compact(keep=lambda df: F.col("value") != F.lit(b"v1"))
        assert list(live(s)) == [b"a2"]


def test_transactions(spark, path):
    with Store.open(spark, path, Options(max_transactions=2)) as s:
        s.put(b"n", b"0")
        t = s.begin()
        assert t.get(b"n") == b"0"
        t.put(b"n", b"1")
        assert t.get(b"n") == b"1" and s.get(b"n") == b"0"
        t.commit()
        assert s.get(b"n") == b"1"
        with pytest.raises(errors.TransactionAborted):
            t.put(b"n", b"2")
        for change in (lambda: s.delete(b"n"), lambda: s.put(b"n", b"1"), lambda: (s.put(b"n", b"7"), s.flush())):
            t = s.begin()
            t.get(b"n")
            change()
            t.put(b"m", b"x")
            with pytest.raises(errors.TransactionConflict):
                t.commit()
            assert s.get(b"m") is None
        a, b = s.begin(), s.begin()
        with pytest.raises(errors.TooManyTransactions):
            s.begin()
        a.rollback()
        with s.begin(track_reads=False) as c:
            c.get(b"n")
        assert s.active_transactions() == 1 and b.is_active()


def test_against_a_model(spark, path):
    rng, model, versions = random.Random(7), {}, []
    with Store.open(spark, path) as s:
        held = None
        for step in range(60):
            batch = WriteBatch()
            for _ in range(rng.randint(1, 4)):
                k = b"k%02d" % rng.randrange(20)
                if rng.random() < 0.3:
                    batch.delete(k)
                    model.pop(k, None)
                else:
                    batch.put(k, b"%d" % step)
                    model[k] = b"%d" % step
            s.write(batch)
            if step == 25:
                held, versions = s.snapshot(), dict(model)
            if step % 13 == 12:
                s.flush()
            if step == 40:
                s.compact()
        assert live(s) == dict(sorted(model.items()))
        assert live(s, snapshot=held) == dict(sorted(versions.items()))


def test_bulk_load_and_stream(spark, path, tmp_path):
    from tidemark.streaming import tail

    with Store.open(spark, path) as s:
        s.put(b"00003", b"old")
        ops = spark.range(2000).selectExpr("id as ord", "cast(lpad(id % 50, 5, '0') as binary) as key", "if(id % 7 = 0, 2, 1) as op", "if(id % 7 = 0, null, cast(cast(id as string) as binary)) as value")
        s.load(ops)
        assert s.sequence == 2001 and s.get(b"00001") == b"1951" and s.get(b"00003") is None  # 1953 is a delete
        ops.limit(100).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "in"))
        tail.into_store(stream, s, str(tmp_path / "cp")).processAllAvailable()
        assert s.sequence == 2101
        assert s.multi_get(spark.createDataFrame([(b"00001",), (b"zz",)], "key binary")).count() == 2


def _crash(store):
    """Lets go of a store without closing it."""
    store._lock.close()
    return os.path.join(store.path, f"{store._log_file:06}.log")


def test_damage_in_the_middle_of_a_log_is_told(spark, path):
    s = Store.open(spark, path, Options(sync_mode="always"))
    for i in range(3):
        s.put(b"k%d" % i, b"value%d" % i)
    log = _crash(s)
    with open(log, "rb") as f:
        raw = f.read()
    size = len(raw) // 3
    # mark, length, checksum, sequence and body of the second record, one bit each
    for at in (0, 4, 8, 12, 22):
        bad = bytearray(raw)
        bad[size + at] ^= 0x40
        with open(log, "wb") as f:
            f.write(bad)
        with pytest.raises(errors.Corruption):
            Store.open(spark, path)
    for cut in (1, size - 1, size - 17):  # a torn tail: what was whole before it counts
        with open(log, "wb") as f:
            f.write(raw[:-cut])
        s = Store.open(spark, path)
        assert s.sequence == 2 and s.get(b"k1") == b"value1" and s.get(b"k2") is None
        _crash(s)
    with open(log, "wb") as f:
        f.write(raw)
    with Store.open(spark, path) as s:
        assert s.sequence == 3 and s.get(b"k2") == b"value2"


def test_sync_modes(spark, tmp_path):
    def syncs(wait=0.0, **options):
        import time

        with Store.open(spark, str(tmp_path / f"{len(os.listdir(tmp_path))}"), Options(**options)) as s:
            for i in range(10):
                s.put(b"k", b"x" * 100)
                time.sleep(wait)
            return s.metrics.counters.get("log_syncs", 0)

    assert syncs(sync_mode="always") == 10 and syncs(sync_mode="none") == 0
    assert 1 <= syncs(sync_mode="bytes", sync_bytes=300) <= 4 and syncs(sync_mode="bytes") == 0
    assert syncs(sync_mode="interval", sync_interval=60.0) == 0 and syncs(0.01, sync_mode="interval", sync_interval=0.02) >= 2
    with pytest.raises(errors.InvalidConfiguration):
        Options(sync_interval=0).validate()


def test_cursor_both_ways(spark, path):
    with Store.open(spark, path) as s:
        for i in range(5):
            s.put(b"k%d" % i, b"v%d" % i)
        c = s.cursor()
        assert c.key() == b"k0"
        c.seek_to_last()
        assert c.key() == b"k4"
        c.prev()
        c.prev()
        assert c.key() == b"k2"
        c.next()
        assert c.key() == b"k3" and c.value() == b"v3"
        c.seek_for_prev(b"k1x")
        assert c.key() == b"k1"
        c.next()
        assert c.key() == b"k2"
        c.seek(b"k9")
        assert not c.valid()
        with pytest.raises(errors.IteratorError):
            c.next()
        c.prev()
        assert c.key() == b"k4"
        c.seek_to_first()
        c.prev()
        assert not c.valid()
        c.next()
        assert c.key() == b"k0"
        r = s.cursor(reverse=True)
        assert [k for k, _ in r] == [b"k4", b"k3", b"k2", b"k1", b"k0"]
        r.seek(b"k2")
        r.next()
        assert r.key() == b"k1"
        r.prev()
        r.prev()
        assert r.key() == b"k3"


def test_runs_are_split_by_size(spark, path):
    options = Options(target_file_size_base=20_000, l0_compaction_trigger=1, max_bytes_for_level_base=30_000)
    with Store.open(spark, path, options) as s:
        held = s.snapshot()
        ops = spark.range(3000).selectExpr("id as ord", "cast(if(id % 3 = 0, 'hot', lpad(id, 5, '0')) as binary) as key", "1 as op", "cast(repeat(md5(cast(id as string)), 2) as binary) as value")
        s.load(ops)
        files = sorted(s.files.values(), key=lambda f: (f["min_key"], -f["max_seq"]))
        assert len(files) > 5 and sum(f["n"] for f in files) == 3000
        assert max(f["n"] for f in files) < 1000  # the hot key's history does not lie in one file
        assert all(a["max_key"] <= b["min_key"] for a, b in zip(files, files[1:]))
        assert s.get(b"hot") is not None and len(live(s)) == 2001
        done = s.maybe_compact()
        assert done["files_in"] == len(files) and done["entries_in"] == done["entries_out"] == 3000 and done["write_amp"] == 1.0 and done["elapsed"] > 0
        held.release()
        assert s.snapshot_count() == 0 and s.snapshots_released() == s.snapshots_created == 1
        before, top = live(s), [f for f in s.files.values() if f["level"] == 1]
        moved = s.maybe_compact()  # level 1 is too large: its first file goes down, with nothing to merge with
        assert moved["moved"] and moved["entries_in"] == 0 and {f["level"] for f in s.files.values()} == {1, 2} and len(top) > 1
        s.compact()
        assert live(s) == before and sum(f["n"] for f in s.files.values()) == 2001
        names = {f["name"].split("/")[0] for f in s.files.values()}
        assert {n for n in os.listdir(path) if n.endswith(".parquet")} == names


def test_no_trivial_move_over_many_grandparents(spark, path, monkeypatch):
    from tidemark.sources import store as module

    with Store.open(spark, path) as s:
        s.write(WriteBatch().put(b"a", b"1").put(b"z", b"1"))
        assert s.compact(0)["moved"] and s.compact(1)["moved"]
        assert [f["level"] for f in s.files.values()] == [2]
        s.put(b"m", b"2")
        monkeypatch.setattr(module, "GRANDPARENTS", 0)  # any file two levels below is too much
        assert not s.compact(0)["moved"]
        s.put(b"zz", b"3")  # meets none of them
        s.flush()
        monkeypatch.setattr(module, "GRANDPARENTS", 10)
        assert s.compact(0)["moved"] and live(s) == {b"a": b"1", b"m": b"2", b"z": b"1", b"zz": b"3"}


def test_background_compaction(spark, path):
    import time

    with Store.open(spark, path, Options(l0_compaction_trigger=2)) as s:
        s.start_compaction(0.05)
        for i in range(6):
            s.put(b"k%d" % i, b"v")
            s.flush()
        until = time.time() + 60
        while time.time() < until and sum(f["level"] == 0 for f in s.files.values()) > 2:
            time.sleep(0.1)
        s.stop_compaction()
        assert sum(f["level"] == 0 for f in s.files.values()) <= 2 and len(live(s)) == 6


def test_a_repeated_batch_of_a_stream_counts_once(spark, path):
    ops = spark.createDataFrame([(1, b"a", 1, b"1"), (2, b"b", 1, b"2")], "ord long, key binary, op int, value binary")
    with Store.open(spark, path) as s:
        s.load(ops, stream=("in", 0))
        s.load(ops, stream=("in", 0))
        s.load(ops, stream=("other", 0))
        assert s.sequence == 4
    with Store.open(spark, path) as s:
        s.load(ops, stream=("in", 0))
        assert s.sequence == 4
        s.load(ops, stream=("in", 1))
        assert s.sequence == 6


def test_counts_and_held_files(spark, path):
    with Store.open(spark, path) as s:
        s.write(WriteBatch().put(b"a", b"1").put(b"b", b"22").delete(b"c"))
        s.flush()
        assert s.hold() == 1 and s.get(b"a") == b"1" and s.get(b"b") == b"22"
        t = s.begin()
        t.get(b"a")
        t.put(b"x", b"1")
        t.put(b"x", b"2")
        assert (t.read_count, t.write_count, t.snapshot_sequence) == (1, 1, 3)
        t.commit()
        got = s.metrics_summary()
        assert len(got) == 14 and (got["reads"], got["writes"], got["deletes"], got["txn_commits"]) == (3, 4, 1, 1)
        assert got["table_cache_hit_rate"] > 0
        s.compact()
        assert live(s) == {b"a": b"1", b"b": b"22", b"x": b"2"}


@pytest.mark.parametrize("compression", ["none", "lz4", "snappy"])
def test_files_read_back_as_written(spark, path, compression):
    """Long shared prefixes, repeated and empty values, over several pages and row groups, with checked pages."""
    want = {b"prefix/%06d/%s" % (i, b"x" * (i % 50)): b"" if i % 11 == 0 else b"value %d" % (i % 700) * (1 + i % 9) for i in range(30_000)}
    rows = [(i, k, 1, v) for i, (k, v) in enumerate(want.items())]
    with Store.open(spark, path, Options(compression=compression, paranoid_checks=True, target_file_size_base=400_000)) as s:
        s.load(spark.createDataFrame(rows, "ord long, key binary, op int, value binary"))
        assert len(s.files) > 3 and live(s) == want
        key = b"prefix/%06d/%s" % (777, b"x" * (777 % 50))
        assert s.get(key) == want[key]
