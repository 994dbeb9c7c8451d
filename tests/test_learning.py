import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import boosting as B
from ledgerloom.operators import sgd as G
from ledgerloom.operators import textml as M


@pytest.fixture(scope="module")
def texts(spark):
    """Texts of three classes that share words, with a number that tells one class."""
    draw = random.Random(3)
    own = {"a": ["tea", "cup", "milk"], "b": ["car", "fuel", "road"], "c": ["milk", "road", "cow"]}
    rows = []
    for i in range(1500):
        leaf = draw.choice("abc")
        words = [draw.choice(own[leaf]) for _ in range(3)] + [f"w{draw.randrange(200)}" for _ in range(3)]
        rows.append((i, words, float(draw.gauss(5 if leaf == "c" else 3, 1)), leaf))
    rows.append((1500, None, None, "a"))
    return spark.createDataFrame(rows, "id long, grams array<string>, amount double, leaf string").repartition(4)


def share(df):
    return df.agg(F.avg((F.col("predicted") == F.col("leaf")).cast("int"))).first()[0]


def test_sparse_rows_have_unit_texts_and_their_numbers(spark):
    df = spark.createDataFrame([(1, ["x", "y", "x"], 4.0), (2, [], None), (3, None, 2.0)], "id long, grams array<string>, amount double")
    sgd = G.Sgd(places=1 << 10)
    for r in G.sparse_rows(df, "grams", {"amount": 2.0}, sgd, ["id"]).collect():
        at = dict(zip(r.idx, r.val))
        assert list(at) == sorted(at) and at[1025] == 1.0
        assert at[1024] == {1: 2.0, 2: 0.0, 3: 1.0}[r.id]
        assert sum(v * v for p, v in at.items() if p < 1024) == pytest.approx(1.0 if r.id == 1 else 0.0)


def test_descent_is_the_gradient_of_the_logistic_loss():
    """One mini-batch of one row from given weights moves each place by step times (p - y) times its value."""
    w = np.array([[0.5, -0.2], [0.1, 0.3], [0.0, 0.0]], np.float32)
    before = w.copy()
    G.descend(np.array([3, 7, 9]), w, np.array([3, 9]), np.array([0.6, 0.8], np.float32), np.array([2]), np.array([1]), G.Sgd(step=0.5, l2=0.0), 0, 1)
    p = 1 / (1 + np.exp(-(before[0] * 0.6 + before[2] * 0.8)))
    error = p - np.array([0, 1])
    assert np.allclose(w[0], before[0] - 0.5 * 0.6 * error, atol=1e-6) and np.allclose(w[2], -0.5 * 0.8 * error, atol=1e-6) and (w[1] == before[1]).all()


def test_sgd_learns_over_parts_as_over_one(texts):
    scale = G.root_mean_squares(texts, ["amount"])
    accuracy = []
    for part_rows in (10_000, 200):
        sgd = G.Sgd(places=1 << 16, part_rows=part_rows)
        rows = G.sparse_rows(texts, "grams", scale, sgd, ["id", "leaf"])
        weights = G.fit(rows.where("id % 4 <> 0"), "leaf", ["a", "b", "c"], sgd)
        out = G.predict(rows.where("id % 4 = 0"), weights, ["a", "b", "c"], ["id", "leaf"], part_rows)
        assert out.count() == rows.where("id % 4 = 0").count() and out.where("confidence <= 0 or confidence > 1").count() == 0
        accuracy.append(share(out))
        assert weights.count() == weights.select("place").distinct().count()
    assert min(accuracy) > 0.93


def test_embeddings_and_their_length_tell_classes(spark):
    """Two classes lie apart in direction, two only in length, which is the number beside the vector."""
    draw = np.random.default_rng(4)
    rows = []
    for i in range(600):
        leaf = i % 3
        v = draw.normal(0, 0.3, 6) + (np.eye(6)[0] if leaf == 0 else np.eye(6)[1])
        v *= 4 if leaf == 2 else 1
        rows.append((i, [float(x) for x in v], float(np.linalg.norm(v)), "abc"[leaf]))
    df = M.with_vector(spark.createDataFrame(rows, "id long, e array<double>, norm double, leaf string"), "e")
    model = M.fit_linear(df.where("id % 4 <> 0"), M.embedding_features(["norm"]), "leaf")
    out = M.predict_top1(model, df.where("id % 4 = 0"))
    assert share(out) > 0.95 and out.where("confidence < 1.0 / 3 - 1e-9 or confidence > 1").count() == 0


def test_best_split_by_brute_force():
    draw = np.random.default_rng(2)
    boost = B.Boost(bins=6, least_rows=3, l1=0.1, l2=0.5)
    for _ in range(30):
        bins = draw.integers(0, 6, (60, 4)).astype(np.uint8)
        g, h = draw.normal(size=60), draw.uniform(0.1, 1, 60)
        sums = B.block_sums(bins, g, h, np.zeros(60, np.int64), 0, 1, 6)[0]
        gain, f, b, left, right = B.best_split(sums, boost)
        worth = lambda rows: max(abs(g[rows].sum()) - 0.1, 0) ** 2 / (h[rows].sum() + 0.5)
        tried = []
        for x in range(4):
            for y in range(5):
                low = bins[:, x] <= y
                if min(low.sum(), (~low).sum()) >= 3:
                    tried.append((worth(low) + worth(~low) - worth(np.ones(60, bool)), x, y))
        assert gain == pytest.approx(max(tried)[0]) and any(t[1:] == (f, b) and t[0] == pytest.approx(gain) for t in tried)
        low = bins[:, f] <= b
        assert np.allclose(left, [g[low].sum(), h[low].sum(), low.sum()]) and np.allclose(left + right, [g.sum(), h.sum(), 60])


def test_sums_over_tasks_find_the_split_of_all_rows(spark):
    """A round on a small table against the same split found on all rows at once."""
    draw = np.random.default_rng(5)
    x = draw.integers(0, 5, (400, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (draw.random(400) < 0.05)).astype(int)
    df = spark.createDataFrame([([float(v) for v in row], "ny"[k], 1.0, i % 10 == 0) for i, (row, k) in enumerate(zip(x, y))], "x array<double>, leaf string, w double, v boolean").repartition(5)
    boost = B.Boost(rounds=1, levels=1, step=1.0, bins=8)
    model = B.fit(df, "x", "leaf", "w", "v", ["n", "y"], boost)
    train = np.arange(400) % 10 != 0
    bins = B.binned(x, model.cuts)[train]
    for k, tree in enumerate(model.rounds[0]):
        g, h = 0.5 - (y[train] == k), np.full(train.sum(), 0.25)
        gain, f, b, left, right = B.best_split(B.block_sums(bins, g, h, np.zeros(len(bins), np.int64), 0, 1, 8)[0], boost)
        assert (tree.feature[0], tree.bin[0]) == (f, b) and f == 1
        assert tree.value[1] == pytest.approx(-B.soft(left[0], 1.0) / (left[1] + 1.0)) and tree.value[2] == pytest.approx(-B.soft(right[0], 1.0) / (right[1] + 1.0))


def test_boosting_stops_when_validation_does_not_gain(spark):
    draw = np.random.default_rng(7)
    x = draw.random((1200, 4))
    y = (x[:, 0] > 0.5).astype(int) + (x[:, 1] > 0.7)
    noisy = np.where(draw.random(1200) < 0.15, draw.integers(0, 3, 1200), y)
    rows = [([float(v) for v in row], int(k), int(t), 1.0, i % 8 == 0, i % 5 == 0) for i, (row, k, t) in enumerate(zip(x, noisy, y))]
    df = spark.createDataFrame(rows, "x array<double>, leaf int, truth int, w double, v boolean, held boolean").repartition(3)
    boost = B.Boost(rounds=40, levels=3, step=0.5, patience=3)
    model = B.fit(df.where("not held"), "x", "leaf", "w", "v", [0, 1, 2], boost)
    assert 1 <= len(model.rounds) < 40 and min(model.losses) == model.losses[len(model.rounds)] < model.losses[0]
    out = B.predict(df.where("held"), "x", model, ["truth"], boost.levels).withColumnRenamed("truth", "leaf")
    assert share(out) > 0.93 and out.where("confidence > 1 or confidence < 0.3").count() == 0


def test_boosting_without_rows(spark):
    df = spark.createDataFrame([], "x array<double>, leaf string, w double, v boolean")
    assert B.fit(df, "x", "leaf", "w", "v", ["a"]).rounds == []


def test_sums_of_rare_bins_are_those_of_all_bins():
    """Nodes without rows, features that are always or never usual; and mostly zero features cost only what is not zero."""
    draw = np.random.default_rng(9)
    bins = np.where(draw.random((500, 12)) < 0.1, draw.integers(0, 7, (500, 12)), 0).astype(np.uint8)
    bins[:, 0], bins[:, 1] = 3, draw.integers(0, 7, 500)
    g, h, node = draw.normal(size=500), draw.uniform(0.1, 1, 500), draw.choice([1, 3, 5, 6], 500)
    want = np.zeros((4, 12, 7, 3))
    for r in range(500):
        if node[r] >= 3:
            for f in range(12):
                want[node[r] - 3, f, bins[r, f]] += (g[r], h[r], 1)
    assert np.allclose(B.block_sums(bins, g, h, node, 3, 4, 7), want)
    assert len(B.rare_bins(bins[:, 2:])[1]) < 0.12 * bins[:, 2:].size


def test_parts_keep_tasks_of_their_own(spark, texts):
    """Small parts are not put together in one task, however few bytes they have."""
    rows = G.sparse_rows(texts, "grams", {}, G.Sgd(places=1 << 10), ["id"])
    own, needs, parts = G.dealt(rows, 100)
    assert parts == 16 and own.rdd.getNumPartitions() == parts
