"""Running judgments from a stream of events: the reference workload is batch, this is an extra for live rating
rounds. Late events count until the watermark passes their window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def verdict_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, verdict, n, quick: verdicts in tumbling windows, and how many took under two seconds."""
    w = F.window("ts", window)
    counts = events.withWatermark("ts", late).groupBy(w.alias("w"), F.col("event_type").alias("verdict")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 2).alias("quick"))
    return counts.select(F.col("w.start").alias("start"), "verdict", "n", "quick")


def latest(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """user_id, item and the latest verdict so far."""
    item = F.get_json_object("props", "$.k").cast("long")
    rows = events.withWatermark("ts", late).withColumn("item", item)
    best = F.max(F.struct("ts", "event_id", "event_type"))
    return rows.groupBy("user_id", "item").agg(best.alias("x")).select("user_id", "item", F.col("x.event_type").alias("verdict"))
