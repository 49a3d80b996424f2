from pyspark.sql import functions as F

from impactgraph.streaming import sessions


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_debounce_batch_and_stream(spark, tmp_path):
    rows = [("a", 0.0), ("a", 1.5), ("a", 3.0), ("a", 9.0), ("b", 1.0), ("z", 1000.0)]
    make = lambda df: df.select("key", F.timestamp_seconds("s").alias("ts"))
    batch = sessions.debounced(make(spark.createDataFrame(rows, "key string, s double")), "key")
    want = [("a", 1), ("a", 3), ("b", 1)]
    assert sorted((r.key, r.events) for r in batch.where("key <> 'z'").collect()) == want
    got = drain(spark, sessions.debounced(make(stream(spark, tmp_path, rows, "key string, s double")), "key", late="1 second"), "bursts")
    assert sorted((r.key, r.events) for r in got.where("key <> 'z'").collect()) == want


def test_ledger_stream(spark, tmp_path):
    rows = [("a", 10, 2), ("a", 20, 3), ("b", 5, 5)]
    got = drain(spark, sessions.running_ledger(stream(spark, tmp_path, rows, "tool string, original long, delivered long")), "ledger", "complete")
    assert sorted(map(tuple, got.collect())) == [("a", 2, 30, 5), ("b", 1, 5, 5)]


def test_read_strategies_stream(spark, tmp_path):
    rows = [(1, "f", 7, i, "low") for i in range(4)] + [(1, "f", 8, 4, "low"), (2, "f", 7, 0, "high")]
    schema = "session long, file string, content_hash long, seq long, confidence string"
    df = stream(spark, tmp_path, rows, schema).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1000))
    got = drain(spark, sessions.read_strategies(df), "strategies")
    assert [r.strategy for r in got.where("session = 1").orderBy("seq").collect()] == ["full-fresh", "sha-pointer", "full-fresh", "escalated-full", "full-fresh"]
