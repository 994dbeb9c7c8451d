"""Choice among many features against brute force."""

import random

import numpy as np
import pytest

from ledgerloom.operators import risk as R
from ledgerloom.operators import selection as C
from ledgerloom.sources import tables

NAMES = ["x", "y", "z", "copy", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two features that tell, one that does not, one in few values with gaps, and one that is constant."""
    draw = random.Random(6)
    out = []
    for k in range(900):
        x, y, z = (draw.gauss(0, 1) for _ in range(3))
        out.append((k, x, 50 * y + 7, z, draw.choice([None, float("nan"), float(round(x))]), 3.0, int(2 * x + y + draw.gauss(0, 0.7) > 0)))
    return spark.createDataFrame(out, "k long, x double, y double, z double, copy double, flat double, bad int").repartition(5)


def logistic(x, y):
    """Plain Newton steps over all rows at once."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        penalty = np.full(len(w), C.PENALTY * len(y))
        penalty[0] = 0
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return w


def gini(score, y):
    bad, good = score[y == 1][:, None], score[y == 0][None, :]
    return 2 * np.mean((bad > good) + 0.5 * (bad == good)) - 1


def scaled(rows):
    value = {n: np.array([np.nan if r[n] is None else r[n] for r in rows]) for n in NAMES}
    return value, np.array([r.bad for r in rows])


def test_selection_by_fitting_every_candidate(rows):
    train, test = rows.where("k % 3 <> 0"), rows.where("k % 3 = 0")
    found = C.forward_select(train, test, NAMES, "bad", 3)
    (a, ya), (b, yb) = scaled(train.collect()), scaled(test.collect())
    norm = lambda v, of: np.nan_to_num((v - np.nanmean(of)) / np.nanstd(of), nan=0.0)
    live = [n for n in NAMES if n != "flat"]
    chosen, best, want = [], 0.0, []
    while len(chosen) < 3:
        tried = []
        for n in live:
            if n not in chosen:
                use = [*chosen, n]
                w = logistic(np.column_stack([norm(a[u], a[u]) for u in use]), ya)
                tried.append((gini(np.column_stack([norm(b[u], a[u]) for u in use]) @ w[1:], yb), n))
        top = max(tried)
        if top[0] <= best + 1e-6:
            break
        best = top[0]
        chosen.append(top[1])
        want.append(top)
    assert [f for f, _ in found] == chosen and chosen[:2] == ["x", "y"]
    assert [g for _, g in found] == pytest.approx([g for g, _ in want], abs=1e-3)


def test_sums_do_not_depend_on_partitions(spark):
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(300, 3)), (draw.random(300) < 0.4).astype(float)
    df = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(x, y)], "x array<double>, y double")
    w = draw.normal(size=(2, 3))
    for parts in (1, 4, 400):
        got = C.added_up(df.repartition(parts), lambda x, y: C.derivatives(x, y, [1], [0, 2], w), 2)
        assert np.allclose(got, C.derivatives(x, y, [1], [0, 2], w))


def test_derivatives_by_differences():
    draw = np.random.default_rng(2)
    x, y, w = draw.normal(size=(60, 3)), (draw.random(60) < 0.5).astype(float), draw.normal(size=(1, 3))

    def likelihood(v):
        s = v[0] + x[:, 1] * v[1] + x[:, 0] * v[2]
        return float(np.sum(y * s - np.log1p(np.exp(s))))

    got, h = C.derivatives(x, y, [1], [0], w)[0], 1e-5
    for i, e in enumerate(np.eye(3) * h):
        assert got[i] == pytest.approx((likelihood(w[0] + e) - likelihood(w[0] - e)) / (2 * h), rel=1e-5, abs=1e-6)
    assert np.allclose(got[3:].reshape(3, 3), got[3:].reshape(3, 3).T)


def test_bounds_hold_the_gini_with_ties(spark):
    draw = np.random.default_rng(3)
    x, y = draw.integers(-3, 4, size=(500, 2)).astype(float), (draw.random(500) < 0.3).astype(float)
    df = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(x, y)], "x array<double>, y double").repartition(4)
    w = np.array([[0.2, 1.5], [-1.0, -0.3]])
    exact = C.ginis(df, [], [0, 1], w)
    assert exact == pytest.approx([gini(x[:, i] * w[i, 1], y) for i in (0, 1)], abs=1e-12)
    for (low, high), g in zip(C.gini_bounds(df, [], [0, 1], w), exact):
        assert low <= g <= high


def test_nothing_to_choose(rows):
    assert C.forward_select(rows, rows, [], "bad") == [] and C.forward_select(rows, rows, ["flat"], "bad") == []
    assert C.forward_select(rows.where("false"), rows.where("false"), ["x"], "bad") == []
    assert C.forward_select(rows.where("bad = 1"), rows.where("bad = 1"), ["x", "y"], "bad") == []


def test_information_values_as_one_by_one(rows):
    clean = rows.selectExpr("k", "x", "y", "z", "nullif(copy, double('NaN')) as copy", "flat", "bad")
    got = {r.feature: r.iv for r in C.information_values(clean, NAMES, "bad").collect()}
    for f in NAMES:
        assert got[f] == pytest.approx(sum(r.iv for r in R.woe_iv(clean, f, "bad", 4).collect()), abs=1e-6)
    assert C.information_values(clean, [], "bad").count() == 0


def test_quantiles_of_many_columns(rows):
    at = [0.0, 0.2, 0.5, 1.0]
    got = tables.column_quantiles(rows.selectExpr("x", "copy", "flat", "cast(null as double) as none", "k"), ["x", "none", "copy", "flat", "k"], at)
    held = rows.collect()
    for c in ("x", "copy", "flat", "k"):
        assert got[c] == pytest.approx(list(np.nanquantile([np.nan if r[c] is None else r[c] for r in held], at)))
    assert got["none"] == [None] * 4
