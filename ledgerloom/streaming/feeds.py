"""The waterfall and drift on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.waterfall import Seeds, categorise_b
from ledgerloom.sources.feeds import read_feed_b


def categorise_stream(spark: SparkSession, path: str, schema, seeds: Seeds) -> DataFrame:
    """Files of raw feed B as they come, categorised by stream-static joins with the seeds; stateless."""
    return categorise_b(read_feed_b(spark.readStream.schema(schema).parquet(path)), seeds)


def event_windows(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling windows of events by type; rows later than the watermark are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, appended to a table of files."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
