from pyspark.sql import functions as F

from taxolyte.streaming import judgments


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:1{i % 6}:00", i % 4, ["same", "related"][i % 2], i / 5, f'{{"k": {i % 5}}}') for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = judgments.read_events(spark, str(tmp_path / "events"))
    got = run(spark, judgments.verdict_counts(stream), "counts", "complete")
    assert sorted(got.collect()) == sorted(judgments.verdict_counts(df).collect())
    got = run(spark, judgments.latest(stream), "latest", "complete")
    assert sorted(got.collect()) == sorted(judgments.latest(df).collect())
