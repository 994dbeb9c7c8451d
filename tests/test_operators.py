"""Invariants that hold whatever the rows, and streams that end as batches do."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import sampling as G
from ledgerloom.operators import textml as M
from ledgerloom.operators.waterfall import categorise_a, categorise_b
from ledgerloom.plans.fixtures import Fixture
from ledgerloom.sources.feeds import read_feed_a, read_feed_b
from ledgerloom.streaming.feeds import categorise_stream, event_windows, run_to_end

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def fx(spark):
    return Fixture(spark, SF)


def test_every_row_has_one_tier(fx):
    for read, categorise, raw in ((read_feed_a, categorise_a, fx.raw_a), (read_feed_b, categorise_b, fx.raw_b)):
        for order in ("production", "evaluation"):
            out = categorise(read(raw), fx.seeds(), order)
            assert out.count() == raw.count()
            assert out.where("leaf is null or resolution_tier is null").count() == 0


def test_orders_differ_only_above_the_dictionary(fx):
    out = categorise_a(read_feed_a(fx.raw_a), fx.seeds())
    late = categorise_a(read_feed_a(fx.raw_a), fx.seeds(), "evaluation")
    known = out.where("resolution_tier = 'T4_merchant_dictionary'").count()
    assert late.where("resolution_tier = 'T4_dictionary'").count() >= known > 0


def test_splits_are_disjoint_and_reproducible(fx):
    one = G.merchant_split(fx.gold_rows, "merchant", 0.15, 42)
    sides = one.groupBy("merchant").agg(F.countDistinct("split").alias("n"))
    assert sides.where("n > 1").count() == 0
    assert one.exceptAll(G.merchant_split(fx.gold_rows.repartition(7), "merchant", 0.15, 42)).count() == 0


def test_caps_hold(fx):
    capped = G.cap_per_group(fx.gold_rows, "gold_leaf", 4, 1, "merchant", "row_no")
    assert capped.groupBy("gold_leaf").count().where("count > 4").count() == 0


def test_cap_prunes_before_the_exchange(fx):
    plan = G.cap_per_group(fx.lineitem, "l_partkey", 2, 1, "l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_lookups_are_broadcast_and_rules_are_one_projection(fx):
    plan = categorise_b(read_feed_b(fx.raw_b), fx.seeds())._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_char_ngrams(spark):
    df = spark.createDataFrame([("Ab c",), (None,), ("  ",)], "t string")
    got = [r.g for r in df.select(M.char_wb_ngrams(F.col("t"), 2, 3).alias("g")).collect()]
    assert got == [[" a", "ab", "b ", " ab", "ab ", " c", "c ", " c "], [], []]


def test_stream_of_feed_b_is_the_batch(spark, fx, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    fx.raw_b.repartition(3).write.parquet(src)
    run_to_end(categorise_stream(spark, src, fx.raw_b.schema, fx.seeds()), out, str(tmp_path / "cp"))
    batch = categorise_b(read_feed_b(spark.read.parquet(src)), fx.seeds())
    streamed = spark.read.parquet(out).select(*batch.columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_stream_of_event_windows_is_the_batch(spark, fx, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    fx.events.write.parquet(src)
    # A last event far ahead closes every window.
    fx.events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).write.mode("append").parquet(src)
    events = spark.readStream.schema(fx.events.schema).parquet(src)
    run_to_end(event_windows(events), out, str(tmp_path / "cp"))
    batch = event_windows(fx.events)
    streamed = spark.read.parquet(out)
    assert batch.exceptAll(streamed).count() == 0 and streamed.exceptAll(batch).where("start < '2029-01-01'").count() == 0
