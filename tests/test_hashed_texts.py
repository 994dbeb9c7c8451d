import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import sgd as G
from ledgerloom.operators import textml as M
from ledgerloom.operators import words as X
from ledgerloom.plans import features
from ledgerloom.plans.fixtures import Fixture

GRAMS = G.Hashed(2, 5, 1 << 12)  # few places, so that n-grams meet in one


def draw_text(draw, leaf):
    own = {"a": ["tea", "cup", "milk"], "b": ["car", "fuel", "road"], "c": ["milk", "road", "Ücow"]}
    return " ".join([draw.choice(own[leaf]) for _ in range(3)] + [f"w{draw.randrange(30)}"] * 2)


def test_places_are_those_of_spark(spark):
    grams = ["ab", " Ü ", "𝒳y", "0019 ", " | "]
    df = spark.createDataFrame([(g,) for g in grams], "g string").select("g", G.place_of(F.col("g"), 1000).alias("a"), G.place_of(F.col("g"), 1 << 20).alias("b"))
    for r in df.collect():
        assert (G.Hashed(2, 5, 1000).pool().place(r.g), G.Hashed(2, 5, 1 << 20).pool().place(r.g)) == (r.a, r.b)


def test_steps_over_words_are_those_over_rows():
    """Rows made from words, places coming again, against descent over each row's own rising places."""
    draw, rng = random.Random(3), np.random.default_rng(3)
    texts = [draw_text(draw, draw.choice("abc")) if i % 40 else "" for i in range(300)]
    table = pa.table({"_t": texts})
    names, code, _ = X.distinct(table)
    own = X.Texts(GRAMS)
    own.start()
    arrays, _ = own.of(names)
    places, at = np.unique(arrays["place"], return_inverse=True)
    numbers, labels, order = np.stack([rng.random(300), np.arange(300) % 2, np.ones(300)], axis=1), rng.integers(0, 4, 300), G.shuffled(300, 1, 7)
    sgd = G.Sgd(step=0.4, l2=1e-3)
    start = rng.normal(size=(len(places) + 3, 4)).astype(np.float32)
    got = G.steps(start.copy(), *G.text_rows(dict(arrays, at=at, code=code), order), labels[order], numbers[order], sgd, 1)

    pool, idx, val, sizes = GRAMS.pool(), [], [], []
    for t, n in zip(texts, numbers):
        p = [f" {w} " for w in t.split()]
        count = Counter(pool.place(w[i : i + k]) for w in p for k in range(2, 6) for i in range(len(w) - k + 1))
        norm = np.sqrt(sum(c * c for c in count.values())) or 1
        idx += [*sorted(count), *(GRAMS.places + np.arange(3))]
        val += [*(count[g] / norm for g in sorted(count)), *n]
        sizes.append(len(count) + 3)
    want = G.descend(np.append(places, GRAMS.places + np.arange(3)), start.copy(), np.array(idx), np.array(val), np.array(sizes), labels, sgd, 1, 7)
    assert np.allclose(got, want, atol=1e-4) and not np.allclose(got, start, atol=1e-2)


def test_text_models_learn_over_parts(spark):
    draw = random.Random(5)
    rows = [(i, draw_text(draw, leaf) if i % 50 else "", None if i % 60 == 1 else float(draw.gauss(5 if leaf == "c" else 3, 1)), leaf) for i in range(1200) for leaf in [draw.choice("abc") if i % 50 else "a"]]
    df = spark.createDataFrame([*rows, (1200, "tea", 1.0, None)], "id long, t string, amount double, leaf string").withColumn("_t", F.lower("t")).repartition(3)
    scale = G.root_mean_squares(df, ["amount"])
    for part_rows in (10_000, 200):
        weights = G.fit_texts(df.where("id % 4 <> 0"), "leaf", ["a", "b", "c"], scale, GRAMS, G.Sgd(part_rows=part_rows))
        assert weights.count() == weights.select("place").distinct().count()
        out = G.predict_texts(df.where("id % 4 = 0"), weights, ["a", "b", "c"], ["id", "leaf"], scale, GRAMS, part_rows)
        found = out.collect()
        assert sorted(r.id for r in found) == list(range(0, 1201, 4)) and all(0 < r.confidence <= 1 for r in found)
        assert sum(r.predicted == r.leaf for r in found) > 0.93 * len(found)


def test_no_row_is_stored_with_its_places(spark, monkeypatch):
    monkeypatch.setattr(M, "with_grams", None)
    monkeypatch.setattr(G, "sparse_rows", None)
    monkeypatch.setattr(G, "dealt", None)
    assert features.m2(Fixture(spark, "/root/testdata/sf0.001")).count() == 6
