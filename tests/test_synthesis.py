import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import synthesis as Y
from ledgerloom.plans import synthesis as P
from ledgerloom.plans.fixtures import Fixture


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ") - plan.count("ReusedExchange ")


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    loans = spark.createDataFrame([(10, 1, day(0), 5, "x"), (11, 1, day(40), 7, "y"), (12, 2, day(3), None, "x"), (13, 9, day(3), 4, "x")], "loan long, person long, at timestamp, sum long, kind string")
    dues = spark.createDataFrame([(10, day(1), 2), (10, day(33), 4), (10, day(90), 100), (11, day(50), 6)], "loan long, due timestamp, paid long")
    entities = [Y.Entity("people", people, "id"), Y.Entity("loans", loans, "loan", "at", ("sum",), {"kind": ("x",)}), Y.Entity("dues", dues, "loan", "due", ("paid",))]
    return entities, [Y.Relation("people", "loans", "person"), Y.Relation("loans", "dues", "loan")]


def rows_of(tables, cutoff=None, **kw):
    entities, relations = tables
    features = Y.plan(entities, relations, "people", Y.Primitives(**kw))
    out = {r.id: r.asDict() for r in Y.feature_table(entities, relations, "people", features, cutoff).collect()}
    return out, [f.name for f in features["people"]]


def test_stacked_features_by_hand(tables):
    got, names = rows_of(tables)
    assert set(got) == {1, 2, 3} and len(names) == len(set(names))
    one, two, none = got[1], got[2], got[3]
    assert one["count__loans"] == 2 and one["sum__loans__sum"] == 12 and one["count__loans__kind__x"] == 1 and one["sum__loans__sum__kind__x"] == 5
    assert one["sum__loans__sum__dues__paid"] == 112 and one["mean__loans__max__dues__paid"] == 53 and one["max__loans__count__dues"] == 3
    assert one["mean__loans__since_previous_at"] == 40 and one["max__loans__month_at"] == 2 and one["nunique__loans__kind"] == 2
    assert one["mean__loans__monthly_sum__sum"] == 6 and one["max__loans__monthly_count"] == 1
    assert one["trend__loans__sum"] == pytest.approx(2 / 40)
    assert two["sum__loans__sum"] is None and two["count__loans"] == 1 and two["sum__loans__count__dues"] == 0
    assert none["count__loans"] == 0 and none["sum__loans__sum"] is None


def test_only_rows_before_the_cutoff_count(tables):
    got, _ = rows_of(tables, F.lit(day(40)))
    assert got[1]["count__loans"] == 1 and got[1]["sum__loans__sum__dues__paid"] == 6
    entities, relations = tables
    own = entities[0].df.withColumn("cut", F.when(F.col("id") == 1, F.lit(day(60))).otherwise(F.lit(day(1))))
    got, _ = rows_of(([Y.Entity("people", own, "id"), *entities[1:]], relations), "cut")
    assert got[1]["count__loans"] == 2 and got[1]["sum__loans__sum__dues__paid"] == 12 and got[2]["count__loans"] == 0


def test_depth_one_and_chosen_primitives(tables):
    entities, relations = tables
    features = Y.plan(entities, relations, "people", Y.Primitives(numeric=("sum",), trend=False, categorical=("mode",), where=()), depth=1)
    assert [f.name for f in features["people"]] == ["count__loans", "sum__loans__sum", "mode__loans__kind"] and "loans" not in features
    assert {r.id: r["mode__loans__kind"] for r in Y.feature_table(entities, relations, "people", features).collect()} == {1: "x", 2: "x", 3: None}


def test_one_exchange_a_relation(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001")
    entities, relations = P.entities(fx)
    assert len(P.PLANNED["customer"]) >= 60
    assert exchanges(Y.feature_table(entities, relations, "customer", P.PLANNED, F.lit(P.CUT).cast("timestamp"))) == len(relations)


def test_sweep_by_brute_force(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(4), day(draw.randrange(60)), draw.choice([None, 1, 5, 100])) for _ in range(300)] + [(None, day(1), 7), (2, None, 7)]
    evals = [(draw.randrange(6), day(draw.randrange(70))) for _ in range(40)] * 2 + [(None, day(30))]
    df, asked = spark.createDataFrame(rows, "who long, ts timestamp, v long"), spark.createDataFrame(evals, "who long, eval timestamp")
    for days in (None, 1, 14):
        got = {(r.who, r.eval): (r.n, r.total) for r in Y.as_of_sums(df, asked, "who", "ts", "eval", {"n": F.lit(1).cast("long"), "total": F.col("v")}, days).collect()}
        def own(who, at):
            return [v for w, t, v in rows if w == who and t is not None and t < at and (days is None or t >= at - dt.timedelta(days=days))]
        assert got == {(w, t): (len(own(w, t)), sum(v or 0 for v in own(w, t))) for w, t in set(evals)}


def test_sweep_has_one_exchange_of_the_rows_and_no_join(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001")
    plan = P._sweep(fx, 30)._jdf.queryExecution().optimizedPlan().toString()
    swept = plan[: plan.index("Union")]
    assert "Join" not in swept and swept.count("Repartition") == 1


def test_distinct_values_are_counted_without_grouping_by_them(spark):
    child = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (1, "y"), (2, None)], "k long, c string")
    tables = [Y.Entity("top", spark.createDataFrame([(1,), (2,), (3,)], "id long"), "id"), Y.Entity("low", child, "k", categories={"c": ()})]
    relations = [Y.Relation("top", "low", "k")]
    got = Y.feature_table(tables, relations, "top", Y.plan(tables, relations, "top"))
    assert {r.id: r.nunique__low__c for r in got.collect()} == {1: 2, 2: 0, 3: 0}
    assert "distinct" not in got._jdf.queryExecution().optimizedPlan().toString()
