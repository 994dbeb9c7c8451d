"""Drift of both feeds as streams: watermarked windows by provider, first-seen category values, late rows.

Sinks are tables with a partition for each micro-batch, written anew where a batch is repeated, so that a restart counts
nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.waterfall import Seeds, categorise_a, categorise_b
from ledgerloom.sources.feeds import read_feed_a, read_feed_b


def both_feeds(spark: SparkSession, path_a: str, path_b: str, schema_a: T.StructType, schema_b: T.StructType, files: int) -> tuple[DataFrame, DataFrame]:
    """Raw files of both feeds as streams of common columns; a micro-batch takes ``files`` files of each."""
    stream = lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return read_feed_a(stream(path_a, schema_a)), read_feed_b(stream(path_b, schema_b))


def resolved(a: DataFrame, b: DataFrame, seeds: Seeds) -> DataFrame:
    """``provider, ts, amount, resolution_tier`` of both feeds by the waterfall; stateless joins with the seeds."""
    cols = [F.col("ts").cast("timestamp").alias("ts"), "amount", "resolution_tier"]
    one = lambda df, name: df.select(F.lit(name).alias("provider"), *cols)
    return one(categorise_a(a, seeds), "A").unionByName(one(categorise_b(b, seeds), "B"))


def shares() -> list[Column]:
    """Rows, rows whose merchant the dictionary does not know and rows that fall through to the residual, and their volume."""
    tier = F.col("resolution_tier")
    fell = tier == "T7_unclassified"
    cents = F.round(F.abs("amount") * 100).cast("long")
    return [F.count("*").alias("n"), F.count_if(tier != "T4_merchant_dictionary").alias("unmatched"), F.count_if(fell).alias("fell_through"), F.coalesce(F.sum(cents), F.lit(0)).alias("volume"), F.coalesce(F.sum(F.when(fell, cents)), F.lit(0)).alias("volume_fell_through")]


def drift_windows(rows: DataFrame, length: str, late: str) -> DataFrame:
    """Counts by provider and tumbling window; rows of windows that the watermark (``late`` behind the newest row of earlier
    batches) has passed do not count.  State is one row for each provider and open window."""
    open_ = rows.withWatermark("ts", late).groupBy("provider", F.window("ts", length)).agg(*shares())
    return open_.select("provider", F.col("window.start").alias("start"), "n", "unmatched", "fell_through", "volume", "volume_fell_through")


def first_values(values: DataFrame, known: DataFrame) -> DataFrame:
    """Each ``provider, value`` the first time that the stream has it, and whether it is a known source of the taxonomy.

    State is one row for each distinct value of a category column, whose vocabularies are small.
    """
    new = values.where(F.col("value").isNotNull()).dropDuplicates(["provider", "value"])
    mark = known.select(F.col("provider").alias("p"), F.col("value").alias("v"), F.lit(True).alias("mapped")).distinct()
    return new.join(mark, (F.col("provider") == F.col("p")) & (F.col("value") == F.col("v")), "left").select("provider", "value", F.coalesce("mapped", F.lit(False)).alias("mapped"))


def run_batches(df: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """All that is there now in micro-batches, each written to its own partition ``batch`` of the table."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key in a table of updates."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*")


def late_rows(arrived: DataFrame, counted: DataFrame) -> DataFrame:
    """``provider, arrived, late``: rows that came, and those that came after their window had closed.

    ``arrived`` has a row for each row that came, ``counted`` the final windows.
    """
    came = arrived.groupBy("provider").agg(F.count("*").alias("arrived"))
    kept = counted.groupBy(F.col("provider").alias("p")).agg(F.sum("n").alias("counted"))
    return came.join(kept, F.col("provider") == F.col("p"), "left").select("provider", "arrived", (F.col("arrived") - F.coalesce("counted", F.lit(0))).alias("late"))
