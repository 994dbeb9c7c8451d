"""How the feed arrives for the stream of the waterfall."""

from ledgerloom.plans import roundtrips
from ledgerloom.plans.fixtures import Fixture
from ledgerloom.sources import tables


def test_a_large_feed_of_the_waterfall_comes_in_more_files(spark, monkeypatch):
    """Files follow the feed's size, so no task writes or reads a fixed share of it."""
    paths, own = [], tables.work_path
    monkeypatch.setattr(tables, "work_path", lambda spark, name: paths.append(own(spark, name)) or paths[-1])
    adaptive = "spark.sql.adaptive."
    sizes = {adaptive + "advisoryPartitionSizeInBytes": "1k", adaptive + "coalescePartitions.minPartitionSize": "1k"}
    try:
        for c, v in sizes.items():
            spark.conf.set(c, v)
        roundtrips.t1(Fixture(spark, "/root/testdata/sf0.001"))
    finally:
        for c in sizes:
            spark.conf.unset(c)
    assert len(spark.read.parquet(next(p for p in paths if "incoming" in p)).inputFiles()) > 4
