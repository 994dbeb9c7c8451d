"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators; a linear hinge-loss model on them is fitted
by dual coordinate descent.

Features of a text are the presence of its byte n-grams of one to four bytes, hashed to 2^17 places, and of runs of
one repeated word.  The fit uses a bounded sample of labelled rows, ``per_class`` of each class in the order of a
hash of their ids (8,192 by default, a parameter); the sample is dealt into ``blocks``, class counts are summed over
blocks, each block runs its own descent and the weights are averaged.  Margins of a block under the other blocks'
weights calibrate a logistic score at the labels' own class ratio.  Every row is scored; nothing of the score is
taken from ``labels``, ``lang``, ``source`` or ``doc_id``.

Defined results: a null text is the empty text; an empty text scores by the intercept; repeated rows score alike;
rows of ``labels`` with a null id or class are left out and the lower of several classes of an id counts; if no row or
only one class can be learned from, every score is the share of class 1 with one added to either class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import crc_mod, stored, text_of, text_slices, utf8, word_hashes, word_spans

BITS = 17
HASHED = 1 << BITS
#: Repeat features: a word standing 2, 3, 4, 6 times in a row, then repeats as a share of the words (1/16, 1/8, 1/4, 1/2).
RUNS, SHARES = (2, 3, 4, 6), (16, 8, 4, 2)
SIZE = HASHED + len(RUNS) + len(SHARES)
MAX_ORDER = 4


def features_of(texts: pa.Array):
    """The sorted feature places of each text of a string array, which is worked off in slices."""
    for at, n in text_slices(texts, most=1 << 18):
        yield from _features(texts.slice(at, n))


def _features(texts: pa.Array):
    data, offsets = utf8(texts)
    padded = np.concatenate((data.astype(np.uint32), np.zeros(MAX_ORDER, np.uint32)))
    orders, h = [], np.zeros(len(data), np.uint32)
    for n in range(1, MAX_ORDER + 1):
        h = h * np.uint32(0x01000193) ^ padded[n - 1 : n - 1 + len(data)] + np.uint32(n)
        orders.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32))
    starts, ends, words = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    flags = np.zeros(SIZE, bool)
    for a, b, wa, wb in zip(offsets[:-1], offsets[1:], words[:-1], words[1:]):
        spans = [o[a : b - n] for n, o in enumerate(orders) if b - a > n]
        for span in spans:
            flags[span] = True
        same = hashes[wa + 1 : wb] == hashes[wa : wb - 1] if wb - wa > 1 else np.zeros(0, bool)
        total = int(same.sum())
        if total:
            edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
            longest = int((edges[1::2] - edges[::2]).max()) + 1
            for k, n in enumerate(RUNS):
                flags[HASHED + k] = longest >= n
            for k, n in enumerate(SHARES):
                flags[HASHED + len(RUNS) + k] = total * n >= wb - wa
        found = np.flatnonzero(flags).astype(np.int32)
        yield found
        flags[found] = False


def descend(rows: list[np.ndarray], sign: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on indicators scaled by ``ratio``; cost: upper bound of each dual variable."""
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    norm = np.array([np.dot(ratio[x], ratio[x]) + 1 for x in rows])
    order = np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = rows[i]
            scaled = ratio[x]
            slope = sign[i] * (np.dot(w[x], scaled) + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[x] += step * scaled
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step) * norm[i])
        if moved < 1e-3:
            break
    return w * ratio, bias


@dataclass
class QualityModel:
    """A weight for each feature, the intercept, and the logistic scale of margins."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        margins = np.array([self.weights[x].sum() for x in features_of(texts)], np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * margins + self.shift, -500, 500)))


def calibrate(margin: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Newton's method for the logistic scale and shift, rows weighted to ``share`` of class 1."""
    weight = np.where(label == 1, share / max(1, (label == 1).sum()), (1 - share) / max(1, (label == 0).sum()))
    x = np.stack([margin, np.ones(len(margin))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        slope = x @ (weight * (label - p)) - 1e-4 * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-4 * np.eye(2), slope)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 8192, blocks: int = 8, cost: float = 0.01, epochs: int = 10) -> QualityModel:
    """Learn from labelled rows; which rows may be learned from is the caller's filter on ``labels``."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.min("y").alias("y"))
    n = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    flat = QualityModel(np.zeros(SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))
    if len(n) < 2:
        return flat
    drawn = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])  # at most 2 * per_class rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(ids), "doc_id")
    # A repeated row keeps its place only once, so that the sample stays within its bound.
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = stored(rows.withColumn("block", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(blocks))).cast("int")), "labelled")

    def column(block: pa.Table, name: str) -> pa.Array:
        return block.column(name).combine_chunks()

    def count(block: pa.Table) -> pa.Table:
        totals = np.zeros((2, SIZE), np.int32)
        for x, y in zip(features_of(column(block, "text")), block.column("y").to_pylist()):
            totals[y, x] += 1
        return pa.table({"block": block.column("block")[:1], "counts": pa.array([totals.tobytes()], pa.binary())})

    counted = sample.groupBy("block").applyInArrow(count, "block int, counts binary").collect()
    if not counted:
        return flat
    totals = sum(np.frombuffer(r.counts, np.int32).reshape(2, SIZE).astype(np.float64) for r in counted) + 1
    ratio = np.log(totals[1] / totals[1].sum()) - np.log(totals[0] / totals[0].sum())

    def train(block: pa.Table) -> pa.Table:
        block = block.sort_by("doc_id")  # the descent's order must not depend on how rows arrive
        rows = list(features_of(column(block, "text")))
        y = column(block, "y").to_numpy()
        w, bias = descend(rows, np.where(y == 1, 1.0, -1.0), ratio, np.full(len(y), cost), epochs)
        return pa.table({"block": block.column("block")[:1], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([bias])})

    fitted = {r.block: (np.frombuffer(r.w, np.float32), r.bias) for r in sample.groupBy("block").applyInArrow(train, "block int, w binary, bias double").collect()}
    mean = lambda parts: (np.mean([p[0] for p in parts], axis=0), float(np.mean([p[1] for p in parts])))
    others = {b: mean([p for c, p in fitted.items() if c != b] or [fitted[b]]) for b in fitted}

    def margins(block: pa.Table) -> pa.Table:
        w, bias = others[block.column("block")[0].as_py()]
        return pa.table({"y": block.column("y"), "m": pa.array([float(w[x].sum()) + bias for x in features_of(column(block, "text"))], pa.float64())})

    seen = sample.groupBy("block").applyInArrow(margins, "y int, m double").toPandas()
    weights, bias = mean([fitted[b] for b in sorted(fitted)])
    # sorted: sums of the calibration must not depend on the order in which tasks end
    seen = seen.sort_values(["y", "m"])
    return QualityModel(weights.astype(np.float64), bias, *calibrate(seen.m.to_numpy(), seen.y.to_numpy(), share))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All columns of ``docs`` with ``quality_score``, the probability of class 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 1 MB
    base = docs.drop("quality_score")
    inner = [f"c{i}" for i in range(len(base.columns))]
    # Columns travel under names of their own, so that any name may stand in the input.
    sent = base.select(*[base[f"`{c}`"].alias(i) for c, i in zip(base.columns, inner)]).withColumn("scored_text", base_text(base, inner))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sent.schema.fields[:-1]) + ", quality_score double"

    def run(batches):
        for batch in batches:
            scores = pa.array(shared.value.scores(batch.column("scored_text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*inner, "quality_score"])

    out = sent.mapInArrow(run, schema)
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, base.columns)], "quality_score")


def base_text(base: DataFrame, inner: list[str]):
    return text_of(inner[base.columns.index("text")])


def not_held_out(labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(crc_mod("doc_id", 4) != 2)


def quality_table(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit(docs, not_held_out(labels))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
