"""Global orders, quantiles, draws and matches without a single task or a driver loop, held against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evidence as E
from ledgerloom.operators import normalise as N
from ledgerloom.operators import risk as R
from ledgerloom.operators import sampling as G
from ledgerloom.operators import textml as M
from ledgerloom.operators.seeds import Rule, rule_matches
from ledgerloom.operators.waterfall import attach_metadata, categorise_a
from ledgerloom.plans.fixtures import Fixture
from ledgerloom.sources import tables
from ledgerloom.sources.feeds import read_feed_a

SF = "/root/testdata/sf0.001"


def numbers(spark, n=500, seed=1):
    draw = random.Random(seed)
    return spark.createDataFrame([(k, draw.choice([None, *map(float, range(40))]), draw.random() * 9) for k in range(n)], "k long, v double, w double").repartition(5)


def test_running_sums_over_a_global_order(spark):
    df = numbers(spark).where("v is not null")
    got = tables.running_sums(df, ["v", "k"], upto="w", place=F.lit(1))
    assert "hashpartitioning(_range" in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(got.collect(), key=lambda r: (r.v, r.k))
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))
    assert np.allclose([r.upto for r in rows], np.cumsum([r.w for r in rows]))
    assert tables.running_sums(df.where("false"), ["v"], place=F.lit(1)).count() == 0


def test_stable_ids_are_a_numbering(spark):
    ids = tables.stable_ids(numbers(spark), [F.col("w").desc(), "k"], 100).orderBy("row_id").collect()
    assert [r.row_id for r in ids] == list(range(101, 601)) and all(a.w >= b.w for a, b in zip(ids, ids[1:]))
    each = tables.stable_ids(numbers(spark), ["k"], within=["v"]).groupBy("v").agg(F.max("row_id").alias("m"), F.count("*").alias("n"))
    assert each.where("m <> n").count() == 0


def test_quantiles(spark):
    df = numbers(spark)
    values = [r.v for r in df.where("v is not null").collect()]
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert np.allclose(tables.quantiles(df, "v", at), np.quantile(values, at))
    assert tables.quantiles(df.where("false"), "v", at) == [None] * 6
    assert tables.quantiles(spark.createDataFrame([(3.5,)], "v double"), "v", [0.3]) == [3.5]


def test_evidence_by_counting(spark):
    draw = random.Random(2)
    word = lambda letters: draw.choice([None, *letters])
    rows = [(f"m{draw.randrange(9)}", draw.choice([None, *map(float, range(-6, 7))]), draw.choice(["credit", "debit"]), word("abc"), word("wxyz")) for _ in range(400)]
    rows.append(("lone", None, "debit", None, None))
    df = spark.createDataFrame(rows, "m string, amount double, direction string, cat string, description_raw string")
    got = {r.m: r for r in E.evidence(df).collect()}

    def top(values, k):
        return sorted(Counter(values).items(), key=lambda x: (-x[1], x[0] is None, x[0]))[:k]

    for m in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == m]
        amounts = [abs(r[1]) for r in own if r[1] is not None]
        assert got[m].median_amount == (np.median(amounts) if amounts else None)
        assert got[m].pct_credit == pytest.approx(np.mean([r[2] == "credit" for r in own]), abs=0.0051)
        assert [tuple(x) for x in got[m].cats] == top([r[3] for r in own], 2) and [tuple(x) for x in got[m].descs] == top([r[4] for r in own], 3)


def test_auc_and_ks_by_pairs(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(30), int(draw.random() < 0.3)) for _ in range(300)]
    got = R.auc_ks(spark.createDataFrame(rows, "s int, bad int"), "s", "bad").first()
    bad, good = [s for s, b in rows if b], [s for s, b in rows if not b]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    ks = max(abs(np.mean([b <= t for b in bad]) - np.mean([g <= t for g in good])) for t in range(30))
    assert got.auc == pytest.approx(auc, abs=1e-6) and got.ks == pytest.approx(ks, abs=1e-6)


def test_least_drawn_is_the_head_of_the_order(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    for n in (1, 450, 1200, 3000, 5000):
        want = {r.k for r in G.random_n(keys, n, 7, "k").collect()}
        assert {r.k for r in G.least_drawn(keys, n, 7, "k").collect()} == want


def test_percent_sample_does_not_follow_partitions(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    one, two = (sorted(r.k for r in G.percent_sample(df.repartition(p), 5, 3, "k").collect()) for p in (2, 9))
    assert one == two and 850 < len(one) < 1150


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_fuzzy_match_misses_no_name(spark):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abc ") for _ in range(n))
    canonical = ["", "a", "abcd", *(word(draw.randrange(1, 30)) for _ in range(60))]
    raw = []
    for c in canonical * 4:
        c = list(c)
        for _ in range(draw.randrange(7)):
            k = draw.randrange(len(c) + 1)
            c[k : k + draw.choice([0, 1])] = draw.choice([[], ["b"], ["z"]])
        raw.append("".join(c))
    out = N.fuzzy_match(spark.createDataFrame([(r,) for r in raw] + [(None,)], "r string"), spark.createDataFrame([(c,) for c in canonical], "c string"))
    want = {}
    for r in set(raw):
        near = [(k, c) for c in canonical if (k := edits(r, c)) <= min(4, len(c) // 3)]
        if near:
            want[r] = min(near)
    assert {r.raw: (r.edits, r.canonical) for r in out.collect()} == want


def test_rules_ignore_case_and_keep_word_edges(spark):
    df = spark.createDataFrame([("ANVIL shop", "x"), ("anvils", "x"), (None, "an Anvil"), ("grand canvas", "x")], "m string, d string")
    fires = lambda rule: [r.hit for r in df.select(rule_matches(rule, F.col("m"), F.col("d"), F.lit("debit")).alias("hit")).collect()]
    assert fires(Rule("1", 1, "merchant", "exact_set", "Anvil|CANVAS", "l")) == [True, False, False, True]
    assert fires(Rule("2", 1, "merchant", "contains", "anvil", "l")) == [True, False, False, False]
    assert fires(Rule("3", 1, "merchant", "regex", "ANVIL", "l")) == [True, True, False, False]
    assert fires(Rule("4", 1, "merchant", "regex", "anvil", "l", exclude="SHOP")) == [False, True, False, False]
    assert fires(Rule("5", 1, "description", "exact_set", "anvil", "l", direction="credit")) == [False] * 4


def test_planning_runs_no_job_and_forces_no_broadcast(spark):
    fx = Fixture(spark, SF)
    seeds, feed = fx.seeds(), read_feed_a(fx.raw_a)
    spark.sparkContext.setJobGroup("planning", "")
    plan = attach_metadata(categorise_a(feed, seeds), fx.taxonomy)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    assert "strategy=broadcast" not in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(8)
    own = {"food": ["bread", "apple", "cheese"], "fuel": ["petrol", "diesel", "pump"], "pay": ["salary", "wages", "bonus"]}
    rows = []
    for k in range(600):
        leaf = draw.choice(list(own))
        words = [draw.choice(own[leaf]), draw.choice(["shop", "online", "ltd", "store"]), str(draw.randrange(99))]
        rows.append((k, " ".join(words), leaf, draw.random() * 5, float(leaf == "pay")))
    df = spark.createDataFrame(rows, "k long, t string, leaf string, log_amount double, is_credit double")
    return df.withColumn("grams", M.char_wb_ngrams(F.col("t"), 2, 5)).cache()


@pytest.mark.parametrize("kind", ["hashed", "tfidf", "trees"])
def test_models_learn_held_out_rows(texts, kind):
    train, valid, held = texts.where("k % 5 > 1"), texts.where("k % 5 = 1"), texts.where("k % 5 = 0")
    numerics = ("log_amount", "is_credit")
    if kind == "trees":
        model = M.fit_trees(train, valid, M.tfidf_features(500, numerics=numerics), "leaf", keep=100)
    else:
        model = M.fit_linear(train, M.hashed_features(numerics=numerics) if kind == "hashed" else M.tfidf_features(500, numerics=numerics), "leaf")
    out = M.predict_top1(model, held)
    assert out.where("predicted = leaf").count() > 0.95 * held.count()
    assert out.where("confidence < 0.33 or confidence > 1").count() == 0


def test_top_terms_are_the_words_of_the_class(texts):
    model = M.fit_linear(texts, M.tfidf_features(500), "leaf")
    found = M.top_terms(model, 3)
    assert {leaf for leaf, _, _ in found} == {"food", "fuel", "pay"}
    marks = {"food": "breadapplecheese", "fuel": "petroldieselpump", "pay": "salarywagesbonus"}
    assert all(gram.strip() in marks[leaf] for leaf, gram, _ in found)


def test_sources_meet_the_feed_in_one_join(spark):
    from ledgerloom.operators.crossfeed import source_match

    feed = spark.range(6).selectExpr("id", "CASE WHEN id < 4 THEN 'p' END AS pri", "CASE WHEN id % 2 = 0 THEN 's' END AS sub").repartition(3)
    sources = spark.createDataFrame([("sub", "s", "a"), ("pri", "p", "b"), ("pri", "p", "b")], "kind string, value string, leaf string")
    compounds = spark.createDataFrame([("c", "p", ["s", "s"]), ("d", "p", None), ("e", None, ["s"])], "leaf string, pri string, subs array<string>")
    got = source_match(feed, sources, compounds)
    want = [(i, leaf, v) for i in range(6) for leaf, v, met in (("a", "s", i % 2 == 0), ("b", "p", i < 4), ("b", "p", i < 4), ("c", "p + s", i % 2 == 0 and i < 4), ("d", "p", i < 4), ("e", "s", i % 2 == 0)) if met]
    assert sorted((r.id, r.leaf, r.value) for r in got.collect()) == sorted(want)
    assert got.columns == ["id", "pri", "sub", "value", "leaf"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 6") == 1


def test_named_features_deal_parts_by_rows(spark, monkeypatch):
    """More transactions are more parts, with the same features."""
    draw = random.Random(12)
    rows = [(k % 40, f"m{draw.randrange(9)}", draw.choice(["salary", "groceries", "rent"]), "essential", draw.choice(["credit", "debit"]), float(draw.randrange(1, 500)), f"2001-0{draw.randrange(1, 10)}-11") for k in range(1200)]
    df = spark.createDataFrame(rows, "applicant long, merchant string, leaf string, necessity string, direction string, amount double, day string").withColumn("ts", F.to_timestamp("day"))
    whole = R.named_features(df)
    monkeypatch.setattr(R, "PART_ROWS", 50, raising=False)
    parts = R.named_features(df, rows=1200)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(applicant" in plan and ", 24), REPARTITION_BY_NUM" in plan
    assert sorted(whole.collect()) == sorted(parts.collect()) and whole.count() == 40
