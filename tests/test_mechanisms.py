import os
import random
from collections import Counter
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import normalise as N
from ledgerloom.operators import sampling as G
from ledgerloom.operators import sketches as K
from ledgerloom.sources.buckets import BucketTable


def test_top_values_within_their_error(spark):
    """A key with far more values than are tracked, and a small one whose counts are exact."""
    draw = random.Random(2)
    hot = [("hot", f"v{int(draw.paretovariate(0.7))}") for _ in range(40_000)] + [("hot", f"once {i}") for i in range(20_000)]
    small = [("small", v) for v in [None] * 5 + ["a"] * 5 + ["b"] * 2 + ["c"] * 2]
    df = spark.createDataFrame(hot + small, "m string, v string").repartition(6)
    got = {r.m: [(x["value"], x["count"]) for x in r.top] for r in df.groupBy("m").agg(K.top_values("v", 4, 1024).alias("top")).collect()}
    assert got["small"] == [("a", 5), (None, 5), ("b", 2), ("c", 2)]
    true, error = Counter(v for _, v in hot), K.count_error(len(hot), 1024)
    assert len(got["hot"]) == 4 and all(true[v] - error <= n <= true[v] for v, n in got["hot"])
    assert min(true[v] for v, _ in got["hot"]) >= sorted(true.values())[-4] - error
    with pytest.raises(ValueError):
        K.top_values("v", 4, 1000)


def test_quantiles_within_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("m"), F.xxhash64("id").cast("double").alias("v")).repartition(5)
    both = df.groupBy("m").agg(K.quantile(F.col("v"), 0.5, 400).alias("q"))
    ranks = df.join(both, "m").groupBy("m").agg(F.avg((F.col("v") <= F.col("q")).cast("int")).alias("r")).collect()
    assert len(ranks) == 2 and all(abs(r.r - 0.5) <= 1.7 / 400 for r in ranks)


def test_evidence_without_amounts(spark):
    df = spark.createDataFrame([("m", None, "debit", "c", "d")], "m string, amount double, direction string, cat string, description_raw string")
    (r,) = K.evidence(df).collect()
    assert r.median_amount is None and r.pct_credit == 0 and r.cats[0]["value"] == "c"


def files(table):
    return {os.path.join(d, n) for d, _, names in os.walk(os.path.join(table.path, "data")) for n in names if n.endswith(".parquet")}


def test_upsert_leaves_other_buckets_files(spark, tmp_path):
    old = spark.createDataFrame([(f"k{i}", i) for i in range(400)] + [(None, -1)], "k string, v long")
    table = BucketTable(spark, str(tmp_path / "t"), old.schema, "k", 32)
    assert table.read().count() == 0 and len(table.upsert(old)) == 32
    before = files(table)
    new = spark.createDataFrame([("k7", 700), ("fresh", 1)], "k string, v long")
    touched = table.upsert(new)
    assert len(touched) <= 2 and before < files(table)
    used = {f.replace("file://", "") for f in table.read().inputFiles()}
    assert len(used & before) == 32 - len(touched) and len(used - before) == len(touched)
    want = {f"k{i}": i for i in range(400)} | {None: -1, "k7": 700, "fresh": 1}
    assert {r.k: r.v for r in table.read().collect()} == want
    assert table.upsert(new.limit(0)) == set()


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    table = BucketTable(spark, str(tmp_path / "t"), old.schema, "k", 4)
    table.upsert(old)
    # Data without a manifest, as a run leaves it that ends between the two.
    old.withColumn("v", F.lit(99)).withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"{table.path}/data/version=2")
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 2)]
    table.upsert(old.where("k = 'a'").withColumn("v", F.lit(5).cast("long")))
    assert sorted(map(tuple, table.read().collect())) == [("a", 5), ("b", 2)]


def scan_metrics(df):
    df.collect()
    out: dict = {}

    def walk(node):
        if "FileSourceScan" in node.getClass().getSimpleName():
            metrics = node.metrics()
            for name in ("numFiles", "filesSize"):
                if metrics.contains(name):
                    out[name] = metrics.get(name).get().value()
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            walk(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            walk(node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_blocks_that_are_not_drawn_are_not_read(spark, tmp_path):
    path = str(tmp_path / "blocks")
    spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition(100).write.parquet(path)
    table = spark.read.parquet(path)
    whole = scan_metrics(table.where("id >= 0"))
    for pct, low, high in ((10, 2, 25), (50, 30, 70)):
        some = G.block_sample(table, pct, 7)
        read = scan_metrics(some)
        assert low <= read["numFiles"] <= high and whole["numFiles"] == 100
        assert read["filesSize"] < whole["filesSize"] * (high + 5) / 100
        rows = some.groupBy("_metadata.file_path").count().collect()
        assert len(rows) == read["numFiles"] and sum(r["count"] for r in rows) == some.count() and low / 100 <= some.count() / 40_000 <= high / 100
        assert sorted(r.id for r in some.collect()) == sorted(r.id for r in G.block_sample(table, pct, 7).collect())
    assert G.block_sample(table, 100, 7).count() == 40_000 and G.block_sample(table, 0, 7).count() == 0


def brute_similar(raw, canonical, least):
    grams = lambda s: Counter(f" {s} "[i : i + 3] for i in range(max(1, len(s))))
    left, right = {s: grams(s) for s in set(raw)}, {s: grams(s) for s in set(canonical)}
    df = Counter(g for side in (left, right) for own in side.values() for g in own)
    total = sum(df.values())

    def unit(own):
        v = {g: k * log(1 + total / df[g]) for g, k in own.items()}
        size = sqrt(sum(w * w for w in v.values()))
        return {g: w / size for g, w in v.items()}

    left, right = ({s: unit(o) for s, o in side.items()} for side in (left, right))
    out = {}
    for s, x in left.items():
        scored = [(-round(sum(w * y.get(g, 0) for g, w in x.items()), 6), c) for c, y in right.items()]
        best = min((p for p in scored if -p[0] >= least), default=None)
        if best:
            out[s] = (best[1], -best[0])
    return out


@pytest.mark.parametrize("least", [0.35, 0.6, 0.9])
def test_similar_names_by_all_pairs(spark, least):
    draw = random.Random(5)
    words = ["tesco", "shell", "post", "office", "a", "uk", "ltd", "the", "north", "café"]
    canonical = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 4))) for _ in range(60)] + ["x", "", "ab"]
    raw = [c if draw.random() < 0.2 else c[:-1] + draw.choice("abz ") + draw.choice(["", " 12", " ltd"]) for c in canonical for _ in range(3)] + ["zzz", "a", ""]
    make = lambda names: spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    got = {r.raw: (r.canonical, r.similarity) for r in N.similar_names(make(raw), make(canonical), least).collect()}
    want = brute_similar(raw, canonical, least)
    assert got.keys() == want.keys() and len(want) > 20
    for s, (c, v) in want.items():
        assert got[s][1] == pytest.approx(v, abs=2e-6) and (got[s][0] == c or abs(got[s][1] - v) < 2e-6)
