"""Order over whole tables against plain Python, with many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import batch, manifest, ordered, scan
from tidemark.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_neighbours_and_positions(spark, many_ranges):
    rng = random.Random(3)
    keys = sorted({f"k{rng.randrange(5000):04}" for _ in range(700)})
    log = spark.createDataFrame([(k, i + 1, 1, "v") for i, k in enumerate(keys)], "key string, seq long, op int, value string").repartition(7)
    assert ordered.ranged(log, F.asc("key")).select("_part").distinct().count() > 5
    got = {r["key"]: (r["prev_key"], r["next_key"]) for r in scan.neighbours(log).collect()}
    assert got == {k: (a, b) for a, k, b in zip([None, *keys], keys, [*keys[1:], None])}
    got = {r["key"]: r["pos"] for r in scan.scan_positions(log, reverse=True).collect()}
    assert got == {k: i + 1 for i, k in enumerate(reversed(keys))}
    assert scan.neighbours(log.limit(0)).count() == 0 and scan.scan_positions(log.limit(0)).count() == 0


def test_islands(spark, many_ranges):
    rng = random.Random(5)
    files = [(i, f"{lo:05}", f"{lo + rng.randrange(60):05}") for i, lo in enumerate(rng.randrange(20000) for _ in range(400))]
    files += [(900, "00000", "05000")]  # spans many ranges
    got = {r["file_no"]: r["island"] for r in manifest.closure(spark.createDataFrame(files, "file_no long, min_key string, max_key string").repartition(5)).collect()}
    want, reach, island = {}, None, 0
    for no, lo, hi in sorted(files, key=lambda f: (f[1], f[2], f[0])):
        island += reach is None or lo > reach
        reach = max(reach or hi, hi)
        want[no] = island
    assert got == want


def test_sequences_over_wide_and_sparse_orders(spark):
    orders = [0, 1, 4095, 4096, 4096**2, 4096**2 + 1, 4096**3 * 5, -7, 3 * 4096**2, 3 * 4096**2]
    ops = spark.createDataFrame([(o, f"k{i}", 1, "v") for i, o in enumerate(orders)], "ord long, key string, op int, value string")
    got = {r["key"]: r["seq"] for r in batch.assign_sequences(ops, 100).collect()}
    places = sorted(range(len(orders)), key=lambda i: (orders[i], f"k{i}"))
    assert got == {f"k{i}": 101 + n for n, i in enumerate(places)}


def test_key_filters_reach_the_files(spark):
    store = queries.kv_store(spark, SF)
    assert {f["level"] for f in store.files.values()} == {0, 1}
    for name, filters in (("point_get", ["EqualTo(key", "GreaterThanOrEqual(key"]), ("scan_range", ["GreaterThanOrEqual(key", "LessThan"]), ("scan_prefix", ["GreaterThanOrEqual(key"])):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :]
        assert any(f in pushed for f in filters), plan
