"""Supervised bins of greatest information value, and the choice of features that say different things."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.selection import information_values
from ledgerloom.sources.tables import quantiles

SMOOTH = 0.5


def merged(counts: list[tuple[int, int]], total: tuple[int, int], least: float) -> list[tuple[int, int]]:
    """Runs (first, last + 1) of fine bins whose rates rise or fall strictly and whose information value is greatest.

    ``counts``: rows and events of each fine bin in order; ``total``: of all rows; each run has ``least`` rows or more.
    A dynamic programme over the last two edges; of equal values the one with fewer runs stays.
    """
    n = len(counts)
    rows, bad = (np.concatenate(([0], np.cumsum([c[i] for c in counts]))) for i in (0, 1))

    def value(i: int, j: int) -> float:
        b = (bad[j] - bad[i] + SMOOTH) / (total[1] + SMOOTH)
        g = (rows[j] - rows[i] - bad[j] + bad[i] + SMOOTH) / (total[0] - total[1] + SMOOTH)
        return (g - b) * math.log(g / b)

    wide = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if rows[j] - rows[i] >= least]
    rate = {(i, j): (bad[j] - bad[i]) / (rows[j] - rows[i]) for i, j in wide}
    found: list[tuple[float, int, list[tuple[int, int]]]] = []
    for rising in (True, False):
        best: dict[tuple[int, int], tuple[float, int, list[tuple[int, int]]]] = {}
        for i, j in sorted(wide, key=lambda e: e[1]):
            own = value(i, j)
            before = [best[h, i] for h in range(i) if (h, i) in best and (rate[h, i] < rate[i, j] if rising else rate[h, i] > rate[i, j])]
            ways = [(v + own, -(k + 1), [*runs, (i, j)]) for v, k, runs in ((v, -k, r) for v, k, r in before)] + ([(own, -1, [(0, j)])] if i == 0 else [])
            if ways:
                best[i, j] = max(ways, key=lambda w: (round(w[0], 9), w[1]))
        found += [b for (_, j), b in best.items() if j == n]
    return max(found, key=lambda w: (round(w[0], 9), w[1]))[2] if found else [(0, n)] * bool(n)


def optimal_bins(df: DataFrame, feature: str, target: str, fine: int = 20, least_share: float = 0.05) -> DataFrame:
    """``bin, low, high, n, bad, woe, iv``: quantile bins merged to monotone ones; nulls have a bin (-1) of their own.

    A value is in the bin with low < value <= high.  Rows are counted by fine bin; the merge is over those counts alone.
    """
    cuts = sorted({c for c in quantiles(df, feature, [k / fine for k in range(1, fine)]) if c is not None})
    above = sum((F.when(F.col(feature) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    each = df.withColumn("_bin", F.when(F.col(feature).isNull(), -1).otherwise(above)).groupBy("_bin").agg(F.count("*").alias("n"), F.sum(target).alias("bad")).orderBy("_bin").collect()
    total = (sum(r.n for r in each), sum(r.bad for r in each))
    held = [r for r in each if r["_bin"] >= 0]
    runs = merged([(r.n, r.bad) for r in held], total, least_share * sum(r.n for r in held))
    edge = lambda k: cuts[k] if 0 <= k < len(cuts) else None
    rows = [(s, edge(held[i]["_bin"] - 1), edge(held[j - 1]["_bin"]), sum(r.n for r in held[i:j]), sum(r.bad for r in held[i:j])) for s, (i, j) in enumerate(runs)]
    rows += [(-1, None, None, r.n, r.bad) for r in each if r["_bin"] < 0]
    out = []
    for s, low, high, n, bad in rows:
        b, g = (bad + SMOOTH) / (total[1] + SMOOTH), (n - bad + SMOOTH) / (total[0] - total[1] + SMOOTH)
        out.append((s, low, high, n, bad, round(math.log(g / b), 6), round((g - b) * math.log(g / b), 6)))
    return df.sparkSession.createDataFrame(out, "bin int, low double, high double, n long, bad long, woe double, iv double")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """``a, b, r`` of all ordered pairs of features over the rows that have both, from cross products of one pass.

    Tasks add up four matrices over their rows; their lines are added by feature.  Values are taken relative to the mean
    of some rows, which keeps the sums small.
    """
    cols = [F.col(c).cast("double") for c in features]
    some = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).limit(100).agg(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)) for i in range(len(cols))]).first()
    shift, n = np.array(list(some)), len(features)

    def run(batches):
        total = np.zeros((4, n, n))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)], axis=1) - shift
            known = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x, nan=0.0)
            total += np.stack((known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x))
        yield pa.RecordBatch.from_pydict({"f": pa.array(range(n), pa.int32()), "sums": [total[:, i].ravel().tobytes() for i in range(n)]})

    def line(table: pa.Table) -> pa.Table:
        f = table.column("f")[0].as_py()
        return pa.table({"f": pa.array([f], pa.int32()), "sums": [sum(np.frombuffer(s.as_buffer(), np.float64) for s in table.column("sums")).tobytes()]})

    lines = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "f int, sums binary").groupBy("f").applyInArrow(line, "f int, sums binary").collect()
    whole = np.zeros((4, n, n))
    for r in lines:  # one line for each feature
        whole[:, r.f] = np.frombuffer(r.sums, np.float64).reshape(4, n)
    count, sx, sxx, sxy = whole
    with np.errstate(invalid="ignore", divide="ignore"):
        cover = sxy - sx * sx.T / count
        spread = (sxx - sx * sx / count) * (sxx.T - sx.T * sx.T / count)
        r = cover / np.sqrt(spread)
    rows = [(features[i], features[j], float(r[i, j])) for i in range(n) for j in range(n) if i != j and np.isfinite(r[i, j])]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def greedy(ranked: list[str], near: dict[tuple[str, str], float], least: float) -> list[tuple[str, bool, str | None, float | None]]:
    """Each feature in order, whether it stays, and else the first kept one that it is close to with their correlation."""
    kept: list[str] = []
    out = []
    for f in ranked:
        reason = next((k for k in kept if abs(near.get((k, f), 0.0)) >= least), None)
        if reason is None:
            kept.append(f)
        out.append((f, reason is None, reason, near[reason, f] if reason else None))
    return out


def choose_features(df: DataFrame, features: list[str], target: str, least: float, bins: int = 4) -> DataFrame:
    """``feature, iv, kept, because, r``: by falling information value, a feature stays if it is not close to a kept one.

    Close is a correlation of ``least`` or more in size.
    """
    value = dict.fromkeys(features, 0.0) | {r.feature: r.iv or 0.0 for r in information_values(df, features, target, bins).collect()}
    near = {(r.a, r.b): r.r for r in correlations(df, features).collect()}
    ranked = sorted(features, key=lambda f: (-value[f], f))
    return df.sparkSession.createDataFrame([(f, value[f], *rest) for f, *rest in greedy(ranked, near, least)], "feature string, iv double, kept boolean, because string, r double")
