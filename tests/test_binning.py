import math
import random
from itertools import product

import numpy as np
import pytest

from ledgerloom.operators import binning as B


def brute(counts, total, least):
    best = None
    for mask in product((0, 1), repeat=len(counts) - 1):
        edges = [0, *(i + 1 for i, m in enumerate(mask) if m), len(counts)]
        runs = list(zip(edges, edges[1:]))
        n, bad = ([sum(c[k] for c in counts[i:j]) for i, j in runs] for k in (0, 1))
        rates = [y / x for x, y in zip(n, bad)]
        ups = [b - a for a, b in zip(rates, rates[1:])]
        if min(n) < least or not (all(u > 0 for u in ups) or all(u < 0 for u in ups)):
            continue
        share = [((x - y + 0.5) / (total[0] - total[1] + 0.5), (y + 0.5) / (total[1] + 0.5)) for x, y in zip(n, bad)]
        key = (round(sum((g - b) * math.log(g / b) for g, b in share), 9), -len(runs))
        if best is None or key > best[0]:
            best = (key, runs)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_merge_by_all_ways(seed):
    draw = random.Random(seed)
    counts = [(n := draw.randrange(5, 60), draw.randrange(0, n + 1)) for _ in range(12)]
    total = (sum(c[0] for c in counts) + 9, sum(c[1] for c in counts) + 3)
    least = 0.08 * total[0]
    got = B.merged(counts, total, least)
    want = brute(counts, total, least)
    share = lambda i, j: (sum(c[0] for c in counts[i:j]), sum(c[1] for c in counts[i:j]))
    assert sorted(got) == got and got[0][0] == 0 and got[-1][1] == 12 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert brute([share(i, j) for i, j in got], total, least)[0][0] >= want[0][0] - 1e-9 and len(got) == -want[0][1]


def test_bins_hold_every_row_once(spark):
    draw = random.Random(2)
    rows = [(x, int(draw.random() < 0.1 + 0.6 * x)) for x in (draw.random() for _ in range(900))] + [(None, 1)] * 20
    out = B.optimal_bins(spark.createDataFrame(rows, "x double, bad int"), "x", "bad", fine=12).collect()
    assert sum(r.n for r in out) == 920 and sum(r.bad for r in out) == sum(b for _, b in rows)
    own = [r for r in out if r.bin >= 0]
    for r in own:
        assert r.n == sum(1 for x, _ in rows if x is not None and (r.low is None or x > r.low) and (r.high is None or x <= r.high)) and r.n >= 45
    woes = [r.woe for r in own]
    assert len(own) > 2 and woes == sorted(woes, reverse=True)
    assert [r.n for r in out if r.bin == -1] == [20]


def test_bins_without_values(spark):
    (r,) = B.optimal_bins(spark.createDataFrame([(None, 1), (None, 0)], "x double, bad int"), "x", "bad").collect()
    assert (r.bin, r.n, r.bad) == (-1, 2, 1)


def test_correlations_by_numpy(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(1e6, 1, (500, 4))
    x[:, 1] = x[:, 0] + draw.normal(0, 0.1, 500)
    hole = draw.random((500, 4)) < 0.1
    rows = [tuple(None if h else float(v) for v, h in zip(r, m)) + (7.0,) for r, m in zip(x, hole)]
    names = ["a", "b", "c", "d", "flat"]
    got = {(r.a, r.b): r.r for r in B.correlations(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4), names).collect()}
    assert len(got) == 12  # a constant has none
    for i, p in enumerate(names[:4]):
        for j, q in enumerate(names[:4]):
            if i != j:
                both = ~hole[:, i] & ~hole[:, j]
                assert got[p, q] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)


def test_greedy_keeps_what_no_better_one_is_close_to():
    near = {}
    for a, b, r in (("x", "y", -0.9), ("y", "z", 0.95), ("x", "w", 0.3)):
        near[a, b] = near[b, a] = r
    assert B.greedy(["x", "y", "z", "w"], near, 0.8) == [("x", True, None, None), ("y", False, "x", -0.9), ("z", True, None, None), ("w", True, None, None)]
    assert [k for _, k, _, _ in B.greedy(["y", "x", "z", "w"], near, 0.8)] == [True, False, False, True]
