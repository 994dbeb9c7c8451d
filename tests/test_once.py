"""Inputs that several steps read are made once."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import risk as R
from ledgerloom.sources.buckets import BucketTable


@pytest.fixture
def counted(spark):
    made = spark.sparkContext.accumulator(0)

    def of(df):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    return of, made


def test_upsert_makes_its_rows_once(spark, counted, tmp_path):
    of, made = counted
    rows = spark.range(100).select(F.col("id").cast("string").alias("m"), F.lit(1).alias("run"))
    table = BucketTable(spark, str(tmp_path / "t"), rows.schema, "m", 8)
    table.upsert(of(rows))
    assert made.value == 100
    table.upsert(of(rows.where("m < '3'").withColumn("run", F.lit(2))))
    assert made.value == 100 + rows.where("m < '3'").count()
    assert {r.m: r.run for r in table.read().collect()} == {str(i): 2 if str(i) < "3" else 1 for i in range(100)}


def test_forms_of_a_category_are_counted_once(spark, counted):
    of, made = counted
    rows = spark.range(200).select((F.col("id") % 20).alias("applicant"), F.lit("groceries").alias("leaf"), F.expr("timestamp'2001-01-01' + make_interval(0, 0, 0, id)").alias("ts"))
    outcomes = spark.range(30).select(F.col("id").alias("applicant"), (F.col("id") % 3 == 0).cast("int").alias("bad"))
    out = R.iv_by_form(of(rows), outcomes, "groceries", "2001-06-01", [1, 12], "bad")
    assert out.count() == 4 and made.value == 200
