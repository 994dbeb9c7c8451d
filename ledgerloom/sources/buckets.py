"""A table of predictions in key buckets, of which an upsert rewrites only those that it touches.

Rows lie under ``data/version=<v>/bucket=<b>``; a manifest has a row for each bucket that a version wrote.  The newest
version of each bucket counts.  An upsert first writes its buckets, with the old rows that stay, and then adds its manifest
as one file; a run that fails before that has changed nothing, and files of buckets that it does not touch stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.tables import materialised

MANIFEST = "version long, bucket int"


class BucketTable:
    """``schema`` must have the column ``key``; ``buckets`` stays the same over a table's life."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 256):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def newest(self) -> dict[int, int]:
        """The version of each bucket that has one; the manifest has a row for each bucket and version."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").groupBy("bucket").agg(F.max("version").alias("v")).collect()
        except Exception as e:  # the first upsert has no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return {r.bucket: r.v for r in rows}

    def read(self, only: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; other buckets' files are not listed."""
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(self.newest().items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, new: DataFrame) -> set[int]:
        """New rows win over old ones of their key; rows of other keys stay.  Returns the buckets that were written."""
        new = materialised(new.select(*self.schema.names), "upsert")  # its buckets, keys and rows are read one after the other
        touched = {r[0] for r in new.select(self.bucket()).distinct().collect()}
        if not touched:
            return touched
        version = max(self.newest().values(), default=0) + 1
        rest = self.read(touched).join(new.select(self.key).distinct(), self.key, "left_anti").select(*self.schema.names)
        rows = new.unionByName(rest).withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        self.spark.createDataFrame([(version, b) for b in sorted(touched)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return touched
