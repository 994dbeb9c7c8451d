"""Choice among many features: information values of all at once, and greedy selection by the Gini of held-out rows.

Each step of the selection works on every candidate in the same passes: tasks add up the gradients and curvatures of all
candidate models over their rows, so the number of passes does not grow with the number of features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.tables import column_quantiles, materialised, running_sums

#: Newton steps of a candidate's model at most, the size of a step below which it is settled, and the penalty a row.
STEPS, SETTLED, PENALTY = 12, 1e-7, 1e-6
#: Ranges of scores whose counts bound a candidate's Gini before scores are put in order.
RANGES = 2048


def information_values(df: DataFrame, features: list[str], target: str, bins: int = 4, smooth: float = 0.5) -> DataFrame:
    """``feature, iv`` of every feature over its quantile bins; nulls have a bin of their own.

    All cut points come from one order of (feature, value), and all bins are counted in one pass.
    """
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, iv double")
    cuts = column_quantiles(df, features, [k / bins for k in range(1, bins)])
    place = lambda f: F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), -1).otherwise(sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f] if c is not None), F.lit(0)))
    rows = df.select(F.col(target).alias("_y"), F.posexplode(F.array(*[place(f) for f in features])).alias("f", "bin"))
    each = rows.groupBy("f", "bin").agg(F.count("*").alias("n"), F.sum("_y").alias("bad"))
    whole = Window.partitionBy("f")  # a row a bin
    bad, good = F.col("bad") + smooth, F.col("n") - F.col("bad") + smooth
    each = each.withColumns({"_b": bad / F.sum(bad).over(whole), "_g": good / F.sum(good).over(whole)})
    each = each.groupBy("f").agg(F.round(F.sum(F.round((F.col("_g") - F.col("_b")) * F.log(F.col("_g") / F.col("_b")), 6)), 6).alias("iv"))
    return each.select(F.get(F.array(*map(F.lit, features)), F.col("f")).alias("feature"), "iv")


def added_up(rows: DataFrame, per_batch: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The sum over all rows (``x`` list of doubles, ``y`` double) of what ``per_batch`` gives: n lines of numbers.

    A task adds its batches; lines then meet by their number, so the driver gets n of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                part = per_batch(x, batch.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"f": pa.array(range(n), pa.int32()), "sums": [np.ascontiguousarray(line).tobytes() for line in total]})

    def line(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(s.as_buffer(), np.float64) for s in table.column("sums"))
        return pa.table({"f": table.column("f").slice(0, 1).combine_chunks(), "sums": [whole.tobytes()]})

    lines = sorted(rows.select("x", "y").mapInArrow(run, "f int, sums binary").groupBy("f").applyInArrow(line, "f int, sums binary").collect())
    return np.array([np.frombuffer(r.sums, np.float64) for r in lines])


def design(x: np.ndarray, chosen: list[int]) -> np.ndarray:
    """A column of ones and the chosen features."""
    return np.column_stack([np.ones(len(x)), x[:, chosen]])


def derivatives(x: np.ndarray, y: np.ndarray, chosen: list[int], rest: list[int], w: np.ndarray) -> np.ndarray:
    """For each candidate, the gradient of the log likelihood and the curvature, flat, of the model with it as the last feature."""
    base, own = design(x, chosen), x[:, rest]
    k = base.shape[1]
    p = 1 / (1 + np.exp(-np.clip(base @ w[:, :k].T + own * w[:, k], -500, 500)))
    miss, spread = y[:, None] - p, p * (1 - p)
    gradient = np.column_stack([miss.T @ base, (miss * own).sum(axis=0)])
    curve = np.zeros((len(rest), k + 1, k + 1))
    curve[:, :k, :k] = (spread.T @ (base[:, :, None] * base[:, None, :]).reshape(len(x), k * k)).reshape(-1, k, k)
    curve[:, :k, k] = curve[:, k, :k] = (spread * own).T @ base
    curve[:, k, k] = (spread * own * own).sum(axis=0)
    return np.column_stack([gradient, curve.reshape(len(rest), -1)])


def fit_each(train: DataFrame, n_rows: int, chosen: list[int], rest: list[int], start: np.ndarray) -> np.ndarray:
    """Weights (intercept, chosen features, candidate) of a logistic model for each candidate, all by the same Newton passes."""
    k = len(chosen) + 2
    w = np.tile(np.append(start, 0.0), (len(rest), 1))
    penalty = np.full(k, PENALTY * n_rows)
    penalty[0] = 0.0
    for _ in range(STEPS):
        sums = added_up(train, lambda x, y: derivatives(x, y, chosen, rest, w), len(rest))
        gradient, curve = sums[:, :k] - penalty * w, sums[:, k:].reshape(-1, k, k) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient[:, :, None])[:, :, 0]
        # A long step may pass the optimum of nearly separable rows: it is shortened.
        step *= np.minimum(1.0, 5 / np.maximum(np.linalg.norm(step, axis=1), 1e-12))[:, None]
        w = w + step
        if np.abs(step).max() < SETTLED:
            break
    return w


def gini_bounds(test: DataFrame, chosen: list[int], rest: list[int], w: np.ndarray) -> np.ndarray:
    """Least and greatest Gini of each candidate's scores on ``test``, from counts in ranges of scores.

    Rows of one range may be in any order, which is all that the counts leave open.
    """
    k = len(chosen) + 1
    spread = np.maximum(np.linalg.norm(w[:, 1:], axis=1), 1e-12)

    def counts(x, y):
        scores = (design(x, chosen) @ w[:, :k].T + x[:, rest] * w[:, k] - w[:, 0]) / spread
        place = np.minimum((RANGES / (1 + np.exp(-np.clip(scores, -30, 30)))).astype(np.int64), RANGES - 1)
        at = place + 2 * RANGES * np.arange(len(rest)) + RANGES * (y > 0)[:, None]
        return np.bincount(at.ravel(), minlength=2 * RANGES * len(rest)).reshape(len(rest), 2 * RANGES).astype(np.float64)

    sums = added_up(test, counts, len(rest))
    if not len(sums):
        return np.zeros((len(rest), 2))
    good, bad = sums[:, :RANGES], sums[:, RANGES:]
    pairs = np.maximum(good.sum(axis=1) * bad.sum(axis=1), 1.0)
    below = (bad * (np.cumsum(good, axis=1) - good)).sum(axis=1)
    return 2 * np.column_stack([below, below + (bad * good).sum(axis=1)]) / pairs[:, None] - 1


def ginis(test: DataFrame, chosen: list[int], rest: list[int], w: np.ndarray) -> list[float]:
    """Exact Gini of each candidate's scores: rows counted by candidate and score, running over one order of both."""
    score = lambda c: sum((F.get("x", F.lit(f)) * float(v) for f, v in zip([*chosen, rest[c]], w[c, 1:])), F.lit(0.0))
    each = test.select("y", F.posexplode(F.array(*[score(c) for c in range(len(rest))])).alias("c", "s"))
    counts = each.groupBy("c", "s").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    run = running_sums(counts, ["c", "s"], upto="good")
    own = run.groupBy("c").agg(F.sum(F.col("bad") * (F.col("upto") - F.col("good") / 2)).alias("a"), F.sum("bad").alias("b"), F.sum("good").alias("g"))
    found, before, out = {r.c: r for r in own.collect()}, 0.0, []  # a row a candidate
    for c in range(len(rest)):
        r = found.get(c)
        out.append(2 * (r.a - before * r.b) / (r.b * r.g) - 1 if r and r.b and r.g else 0.0)
        before += r.g if r else 0.0
    return out


def forward_select(train: DataFrame, test: DataFrame, features: list[str], target: str, most: int = 5, gain: float = 1e-6) -> list[tuple[str, float]]:
    """The features that raise the Gini of ``test`` most, one after the other, until none gains: name and Gini reached.

    Each candidate joins those chosen in a logistic model of its own.  Features are taken relative to their mean and
    deviation in ``train``; a null or NaN counts as the mean, and a feature that is constant there is no candidate.  Of
    equal Ginis the first by name wins.  No rows, or rows of one class, choose nothing.
    """
    value = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    scale = train.agg(F.count(target).alias("n"), *[s.alias(f"{kind}{i}") for i, f in enumerate(features) for kind, s in (("m", F.avg(value[f])), ("d", F.stddev_pop(value[f])))]).first() if features else None
    live = [(f, scale[f"m{i}"], scale[f"d{i}"]) for i, f in enumerate(features) if scale[f"d{i}"]]
    if not live:
        return []
    columns = [F.coalesce((value[f] - F.lit(m)) / F.lit(d), F.lit(0.0)) for f, m, d in live]
    as_rows = lambda df, name: materialised(df.where(F.col(target).isNotNull()).select(F.array(*columns).alias("x"), F.col(target).cast("double").alias("y")), name)
    train, test = as_rows(train, "train"), as_rows(test, "test")
    names = [f for f, _, _ in live]
    chosen: list[int] = []
    start, best, out = np.zeros(1), 0.0, []
    while len(chosen) < min(most, len(names)):
        rest = [i for i in range(len(names)) if i not in chosen]
        w = fit_each(train, scale.n, chosen, rest, start)
        bounds = gini_bounds(test, chosen, rest, w)
        least = max(best + gain, bounds[:, 0].max())
        left = [i for i, (_, high) in enumerate(bounds) if high >= least - 1e-9]
        if not left:
            break
        exact = ginis(test, chosen, [rest[i] for i in left], w[left])
        at = min(range(len(left)), key=lambda i: (-round(exact[i], 9), names[rest[left[i]]]))
        if exact[at] <= best + gain:
            break
        best, start = exact[at], w[left[at]]
        chosen.append(rest[left[at]])
        out.append((names[chosen[-1]], best))
    return out
