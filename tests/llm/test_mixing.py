import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, active, left = {}, set(order), float(sum(sizes.values()))
    while active:
        total = sum(weight[s] for s in active)
        over = {s for s in active if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in active}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        active -= over
    return target


def check(docs_of, rows):
    got = mixing.mix(docs_of(rows), bucket_rows=16).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return taken, want


def test_targets_and_takes(docs_of):
    draw = random.Random(2)
    rows = [(i, "w " * draw.randrange(1, 90), draw.choice(["a", "b", "é", "z", None] + ["a"] * 5)) for i in range(900)]
    taken, want = check(docs_of, rows)
    for s in want:
        assert abs(taken[s] - want[s]) < 60


def test_capped_sources_share_the_excess(docs_of):
    rows = [(1, "x", "a"), (2, "x y", "b"), *[(i, "q r s t", "c") for i in range(3, 60)]]
    taken, want = check(docs_of, rows)
    assert want["a"] == 3 and taken["a"] == 3


def test_odd_rows_and_reruns(docs_of, odd_rows):
    rows = [(*r, "s") for r in odd_rows] + [(None, None, None)]
    check(docs_of, rows)
    one, two = (sorted(map(str, mixing.mix(docs_of(rows, parts)).collect())) for parts in (1, 5))
    assert one == two
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.mix(docs_of([(1, None, "a"), (2, " ", None)])).selectExpr("sum(taken)", "sum(target)").first()[:] == (0, 0.0)


def brute_balance(rows, cap=3.0, most=1.0):
    """Bisection on the tilt, and within it on each source's variable: the optimum that Newton's steps must find."""
    sizes = defaultdict(list)
    for _, text, source in rows:
        n = len((text or "").split())
        if n:
            sizes[source].append(n)
    want = brute_targets({s: sum(v) for s, v in sizes.items()})
    every = np.array([n for v in sizes.values() for n in v], float)
    mean = (every * np.log1p(every)).sum() / every.sum()

    def rates(s, y):
        n = np.array(sizes[s], float)
        f, low, high = np.log1p(n) - mean, -60.0, 60.0
        for _ in range(200):
            x = (low + high) / 2
            r = np.minimum(cap, np.exp(np.minimum(60, x + y * f)))
            low, high = (x, high) if (n * r).sum() < want[s] else (low, x)
        return n, f, r

    def pull(y):
        return sum((n * r * f).sum() for n, f, r in (rates(s, y) for s in sizes))

    low, high = -most, most
    for _ in range(60):
        y = (low + high) / 2
        low, high = (y, high) if pull(y) < 0 else (low, y)
    return y, {s: dict(zip(*rates(s, y)[::2])) for s in sizes}


def mixed_lengths(seed, n=400):
    """Sources of very different document lengths, so that the length constraint pulls against the targets."""
    draw = random.Random(seed)
    most = {"a": 200, "b": 20, "c": 60, "d": 5, None: 90}
    return [(i, "w " * draw.randrange(0, most[s]), s) for i in range(n) for s in [draw.choice(list(most))]]


@pytest.mark.parametrize("seed", [1, 2])
def test_dual_finds_the_optimum(docs_of, seed):
    rows = mixed_lengths(seed)
    y, want = brute_balance(rows)
    got = mixing.mix(docs_of(rows)).collect()
    assert abs(y) > 0.02
    for r in got:
        if r.size:
            assert r.rate == pytest.approx(want[r.source][r.size], rel=1e-4)
    mean = sum(r.size * math.log1p(r.size) for r in got) / sum(r.size for r in got)
    assert abs(y) > 0.99 or sum(r.size * r.rate * (math.log1p(r.size) - mean) for r in got) == pytest.approx(0, abs=1e-3 * sum(r.size for r in got))


def test_length_constraint_without_room_stays_soft(docs_of):
    """Sources of one document each: their rates follow from the targets, whatever the tilt."""
    rows = [(1, "w " * 100, "a"), (2, "w " * 10, "b"), (3, "w " * 300, "c")]
    want = brute_targets({"a": 100, "b": 10, "c": 300})
    for r in mixing.mix(docs_of(rows)).collect():
        assert r.rate * r.size == pytest.approx(want[r.source], rel=1e-4)


def test_many_rows_of_one_id(docs_of):
    for i in (None, 7):
        rows = [(i, f"u{k} " * (1 + k % 40), "ab"[k % 2]) for k in range(3000)]
        taken, want = check(docs_of, rows)
        assert all(abs(taken[s] - want[s]) < 0.01 * want[s] + 60 for s in want)


def test_carried_columns(docs_of):
    rows = mixed_lengths(3, 60)
    docs = docs_of(rows)
    for c in ("size", "name", "x", "of", "target", "rest", "bucket"):
        docs = docs.withColumn(c, F.col("text"))
    out = mixing.mix(docs, carry=[F.col("text"), F.col("rest")]).collect()
    assert sorted((r.doc_id, r.rest.text) for r in out) == sorted((r[0], r[1]) for r in rows)
    assert {(r.doc_id, r.copies) for r in out} == {(r.doc_id, r.copies) for r in mixing.mix(docs_of(rows)).collect()}


def test_a_mix_that_has_not_converged_is_an_error(spark):
    rows = [(s, n) for s, scale in (("a", 1), ("b", 40)) for n in range(1, 60 * scale, scale)]
    sizes = spark.createDataFrame(rows, "source string, size long")
    targets = mixing.source_targets(sizes, (5.0, 2.0), 3)
    with pytest.raises(RuntimeError, match="after 2 Newton steps"):
        mixing.balance(sizes, targets, steps=2, missed=1e-9)
    state, _, _ = mixing.balance(sizes, targets)
    assert state.count() == 2
