"""Event-time windows over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A stream over the Parquet files of a folder, with the file's schema and `ts` as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows (day, event_type, n, total) by day; events later than `late` are dropped."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Work through what there is and write each closed window once, as Parquet."""
    q = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
