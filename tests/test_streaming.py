from tidemark.plans import queries
from tidemark.operators import visibility
from tidemark.streaming import tail

SF = "/root/testdata/sf0.001"


def stream(spark, tmp_path, df, n=4):
    for i in range(n):
        df.filter(f"seq % {n} = {i}").write.parquet(str(tmp_path / "in" / f"part={i}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_running_newest_equals_batch(spark, tmp_path):
    log = queries.kv_log(spark, SF)
    q = tail.running_newest(stream(spark, tmp_path, log)).writeStream.outputMode("complete").format("memory").queryName("newest").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in visibility.newest(log).select("key", "seq", "op", "value").collect()}
    assert {tuple(r) for r in spark.sql("select key, seq, op, value from newest").collect()} == want


def test_windowed_counts(spark, tmp_path):
    log = queries.kv_log(spark, SF).selectExpr("*", "timestamp_seconds(seq) as ts")
    q = tail.windowed_counts(stream(spark, tmp_path, log), "ts", "2 hours", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == log.count()
