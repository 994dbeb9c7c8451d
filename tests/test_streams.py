"""How the feeds arrive for the streams."""


from pyspark.sql import functions as F

from ledgerloom.plans import streams as S


def test_a_feed_is_made_once_and_comes_in_equal_numbers_of_files(spark, tmp_path, monkeypatch):
    """A row of the feed is computed once for all slices; larger feeds come in more files, the same number a slice."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    n = 1200
    df = spark.range(n).select(F.col("id").alias("applicant"), F.expr("timestamp_seconds(id * 864000)").alias("ts"))
    df = df.mapInArrow(count, df.schema)
    monkeypatch.setattr(S, "FILE_ROWS", 50)
    path = str(tmp_path / "in")
    files = S.arrive([df], [path])
    assert made.value == n and files == 4
    rows = spark.read.parquet(path)
    assert rows.count() == n and rows.columns == ["applicant", "ts"]
    each = rows.select(F.expr(S.arrival("ts", "applicant")).alias("s"), F.input_file_name().alias("f")).distinct().groupBy("s").count().collect()
    assert len(each) == S.LAST + 1 and {r["count"] for r in each} == {files}
