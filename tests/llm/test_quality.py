import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm import quality


def corpus(n=400):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 7)))
    rows, marks = [], []
    for i in range(n):
        words = [word() for _ in range(draw.randrange(5, 60))]
        bad = draw.random() < 0.25
        if bad:
            words = [w.upper() + "!!" for w in words] if draw.random() < 0.5 else [w for w in words[:5] for _ in range(12)]
        rows.append((i, " ".join(words)))
        marks.append((i, 0 if bad else 1, 0))
    return rows, marks


def test_learns_and_never_sees_held_out_labels(spark, docs_of):
    rows, marks = corpus()
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_table(docs_of(rows), labels).collect()}
    held = [m for m in marks if got[m[0]].held_out]
    assert 60 < len(held) < 140
    assert np.mean([got[m[0]].predicted == m[1] for m in held]) > 0.95
    flipped = spark.createDataFrame([(i, (1 - q) if got[i].held_out else q, t) for i, q, t in marks], labels.schema)
    again = {r.doc_id: r.score for r in quality.quality_table(docs_of(rows), flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_odd_rows_and_clashing_columns(spark, docs_of, odd_rows):
    rows, marks = corpus(80)
    labels = spark.createDataFrame([*marks, (None, 1, 0), (3, None, 0), (4, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of([(i + 1000, t) for i, t in rows] + odd_rows).withColumnRenamed("token", "quality_score").withColumnRenamed("lang", "c0")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.columns == [*[c for c in docs.columns if c != "quality_score"], "quality_score"]
    assert out.count() == 80 + len(odd_rows)
    assert out.where("quality_score is null or quality_score < 0 or quality_score > 1").count() == 0


def test_no_labels_and_one_class(spark, docs_of):
    docs = docs_of([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality.quality_table(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0)], none.schema)
    assert {round(r.score, 6) for r in quality.quality_table(docs, one).collect()} == {0.666667}
    assert quality.quality_table(docs_of([]), one).count() == 0


def test_features_by_brute_force():
    texts = ["", "a", "la la la la bé", "x\n y"]
    data = [t.encode() for t in texts]
    got = [set(f.tolist()) for f in quality.features_of(pa.array(texts))]
    for raw, found in zip(data, got):
        want = set()
        for n in range(1, 5):
            for i in range(len(raw) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ (raw[i + k] + k + 1)
                want.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality.BITS))
        assert {f for f in found if f < quality.HASHED} == want
    assert {f - quality.HASHED for f in got[2] if f >= quality.HASHED} == {0, 1, 2, 4, 5, 6, 7}


def test_descent_separates():
    rows = [np.array([0, 2]), np.array([1, 2]), np.array([0]), np.array([1])]
    w, bias = quality.descend(rows, np.array([1.0, -1, 1, -1]), np.ones(quality.SIZE), np.full(4, 1.0), 200)
    assert [w[x].sum() + bias > 0 for x in rows] == [True, False, True, False]


def test_descent_finds_the_dual_optimum():
    """Against projected gradient steps on the dual with its matrix written out."""
    draw = np.random.default_rng(3)
    rows = [np.sort(draw.choice(12, draw.integers(1, 6), replace=False)).astype(np.int32) for _ in range(40)]
    sign, ratio = draw.choice([-1.0, 1.0], 40), draw.normal(size=quality.SIZE)
    cost = np.full(40, 0.3)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
    x[:, 12] = 1  # the intercept is a feature like any other
    q = (sign[:, None] * x) @ (sign[:, None] * x).T
    alpha = np.zeros(40)
    for _ in range(200_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    w = (alpha * sign) @ x
    got, bias = quality.descend(rows, sign, ratio, cost, 20_000)
    assert np.allclose(got[:12], w[:12] * ratio[:12], atol=1e-3) and abs(bias - w[12]) < 1e-3


def test_ratios_and_scores_by_brute_force(spark, docs_of, monkeypatch):
    """One block: ratios from counted documents, the descent on them, and the score of every text."""
    rows, marks = corpus(60)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    seen = {}
    descend = quality.descend
    monkeypatch.setattr(quality, "calibrate", lambda margin, label, share: seen.update(n=len(margin)) or (1.0, 0.0))
    model = quality.fit(docs_of(rows), labels, blocks=1, epochs=30)
    texts = [t for _, t in rows]
    sets = list(quality.features_of(pa.array(texts)))
    y = np.array([q for _, q, _ in marks])
    counts = np.ones((2, quality.SIZE))
    for s, label in zip(sets, y):
        counts[label, s] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias = descend(sets, np.where(y == 1, 1.0, -1.0), ratio, np.full(60, 0.01), 30)
    assert seen["n"] == 60 and np.allclose(model.weights, w, atol=1e-4) and abs(model.bias - bias) < 1e-6
    got = {r.doc_id: r.quality_score for r in quality.score(docs_of(rows), model).collect()}
    for (i, _), s in zip(rows, sets):
        assert abs(got[i] - 1 / (1 + np.exp(-(model.weights[s].sum() + model.bias)))) < 1e-9


def test_many_rows_of_one_id(spark, docs_of):
    draw = random.Random(5)
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for i in (None, 7):
        rows = [(i, f"t{draw.randrange(10**6)}") for _ in range(3000)] + [(8, "low"), (9, "high")]
        assert quality.quality_table(docs_of(rows), labels).count() == len(rows)
