import random

import pytest
from pyspark.sql import functions as F

from tidemark import Options, WriteBatch, errors
from tidemark.functions import bloom, codec, keys, metrics
from tidemark.sources import names


def test_codecs():
    for n in (0, 1, 127, 128, 300, 2**32, 2**63):
        assert codec.get_varint(codec.put_varint(n)) == (n, len(codec.put_varint(n)))
    with pytest.raises(ValueError):
        codec.get_varint(b"\x80")
    with pytest.raises(ValueError):
        codec.get_bytes(b"\x05ab")
    assert codec.decode_internal_key(codec.encode_internal_key(b"k", 7, 2)) == (b"k", 7, 2)
    entries = [(1, b"a", b""), (2, b"b", None), (1, b"c" * 300, b"v")]
    assert codec.decode_batch(codec.encode_batch(entries)) == entries
    for cut in range(1, len(codec.encode_batch(entries)) - 4):
        with pytest.raises(ValueError):
            codec.decode_batch(codec.encode_batch(entries)[:-cut])
    assert codec.unmask_crc(codec.mask_crc(0xDEADBEEF)) == 0xDEADBEEF and codec.mask_crc(5) != 5
    assert codec.crc32(b"ab", b"c") == codec.crc32(b"abc")


def test_keys():
    assert keys.prefix_end(b"a\xff\xff") == b"b" and keys.prefix_end(b"\xff") is None and keys.prefix_end(b"") is None
    rng = random.Random(1)
    for _ in range(500):
        a, b = sorted(bytes(rng.choice(b"\x00\x01a\xfe\xff") for _ in range(rng.randint(0, 4))) for _ in range(2))
        if a < b:
            assert a <= keys.separator(a, b) < b
        assert keys.successor(a) >= a


def test_batch_and_options():
    b = WriteBatch().put(b"key", b"value").delete(b"k")
    assert len(b) == 2 and b.approximate_size() == 3 + 5 + 16 + 1 + 8
    b.clear()
    assert b.is_empty()
    assert Options().max_bytes_for_level(2) == 2560 << 20
    for bad in ({"max_memtable_size": 10}, {"block_size": 1}, {"l0_compaction_trigger": 9}, {"max_write_buffers": 1}, {"max_key_size": 9000}, {"sync_mode": "x"}):
        with pytest.raises(errors.InvalidConfiguration):
            Options(**bad).validate()
    assert errors.TransactionConflict.recoverable and errors.CrcMismatch.corrupt


def test_metrics():
    m = metrics.Metrics()
    m.inc("reads", 2)
    m.set("open", 1)
    for v in (0.5, 5, 5e8):
        m.observe("get", v)
    with m.timer("get"):
        pass
    text = m.prometheus()
    assert "tidemark_reads 2" in text and 'le="10"} ' in text and "tidemark_get_microseconds_count 4" in text
    assert m.summary()["reads"] == 2 and m.histograms["get"].min is not None
    c = metrics.LruCache(2)
    for k in "abc":
        c.insert(k, k)
    assert c.get("a") is None and c.get("c") == "c" and len(c) == 2 and c.hit_rate() == 0.5


def test_names():
    assert names.parse("000012.parquet") == ("table", 12) and names.parse("MANIFEST-000003") == ("manifest", 3) and names.parse("LOCK") == ("lock", 0) and names.parse("x") is None


def test_bloom(spark):
    inside = spark.range(1000).select(F.format_string("key_%06d", "id").alias("key"))
    outside = spark.range(1000, 11000).select(F.format_string("key_%06d", "id").alias("key"))
    bits, m, k = bloom.build(inside, 1000)
    assert bloom.may_contain(inside, bits, m, k).filter("maybe").count() == 1000
    assert bloom.may_contain(outside, bits, m, k).filter("maybe").count() < 200


def test_plans_stay_pushed_down(spark):
    from tidemark.operators import scan, visibility
    from tidemark.plans import queries

    log = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    kv = log.selectExpr("props as key", "event_id as seq", "1 as op", "props as value")
    plan = scan.scan(kv, start="a", end="b", seq=10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(props,a)" in plan and "LessThan(props,b)" in plan and "LessThanOrEqual(event_id,10)" in plan
    plan = visibility.visible(queries.kv_log(spark, "/root/testdata/sf0.01"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "partial_max" in plan


def test_format_bytes_rounds_halves_to_even(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import codec

    ns = [0, 1023, 1024, 1152, 1280, 1536, 1 << 20, (1 << 20) + 5243, 5 << 30, 1 << 40, (1 << 30) - 1]
    want = []
    for n in ns:
        unit, k = next(((u, k) for u, k in (("GB", 30), ("MB", 20), ("KB", 10)) if n >= 1 << k), ("B", 0))
        want.append(f"{n / (1 << k):.2f} {unit}" if k else f"{n} B")
    df = spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "i int, n long").select("i", codec.format_bytes(F.col("n")).alias("t"))
    assert [r["t"] for r in df.orderBy("i").collect()] == want


def test_format_bytes_of_the_largest_numbers(spark):
    from decimal import ROUND_HALF_EVEN, Context, Decimal

    def want(n):
        unit, k = next(((u, k) for u, k in (("GB", 30), ("MB", 20), ("KB", 10)) if n >= 1 << k), ("B", 0))
        return f"{(Decimal(n) / (1 << k)).quantize(Decimal('0.01'), ROUND_HALF_EVEN, Context(60))} {unit}" if k else f"{n} B"

    ns = [0, 1023, (1 << 20) - 1, (1 << 30) - 1, (1 << 63) // 100 + 1, 451_801**3, 2_097_151**3, (1 << 62) + (5 << 27), (1 << 62) + (15 << 27), (1 << 63) - 1]
    big = [*ns, 1 << 63, 6_000_000**3, (1 << 66) + (5 << 27)]
    for kind, some in (("bigint", ns), ("decimal(38,0)", big)):
        df = spark.createDataFrame([(i, str(n)) for i, n in enumerate(some)], "i int, n string").select("i", codec.format_bytes(F.col("n").cast(kind)).alias("t"))
        assert [r["t"] for r in df.orderBy("i").collect()] == [want(n) for n in some]


def test_varint_length_of_the_largest_numbers(spark):
    ns = [0, 127, 128, (1 << 56) - 1, 1 << 56, (1 << 63) - 1, None]
    big = [*ns, 1 << 63, (1 << 64) - 1, 6_000_000**3, (1 << 70) - 1, 1 << 70, (1 << 126) - 1, 1 << 126]
    for kind, some in (("bigint", ns), ("decimal(38,0)", big)):
        df = spark.createDataFrame([(i, None if n is None else str(n)) for i, n in enumerate(some)], "i int, n string").select("i", codec.varint_length(F.col("n").cast(kind)).alias("k"))
        assert [r["k"] for r in df.orderBy("i").collect()] == [None if n is None else len(codec.put_varint(n)) for n in some]
