"""One-against-the-rest logistic models over hashed n-grams by stochastic gradient descent in partitions.

A row is a sparse vector: hashed counts of unit length, then numbers (over their root mean square) and a constant on places
of their own.  The rows are dealt to parts of about ``part_rows`` and stored with the distinct places that each part needs.  An epoch

* hands every part the weights of its places (a join by place, then an exchange by part),
* runs mini-batches over the part in Arrow, with a falling step, and
* averages what the parts have made of a place by ranges of places.

So no task and not the driver ever holds all places x classes; a part's share is bounded by its rows.

Rows of texts (``fit_texts``) are stored as the words of each distinct text and the places of each word of a part; their
vectors are made by part and epoch and never stored or sent.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.operators import words as X
from ledgerloom.sources.tables import materialised


@dataclass(frozen=True)
class Sgd:
    """Places, L2 term, first step, epochs, rows of a mini-batch and of a part."""

    places: int = 1 << 20
    l2: float = 1e-6
    step: float = 0.3
    epochs: int = 6
    batch: int = 32
    part_rows: int = 20_000
    range_bits: int = 12


def place_of(gram: Column, places: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(places)).cast("int")


def root_mean_squares(df: DataFrame, numerics: list[str]) -> dict[str, float]:
    """Of each number over the rows that have it; 1 where all are null or zero."""
    if not numerics:
        return {}
    one = df.agg(*[F.sqrt(F.avg(F.col(c).cast("double") * F.col(c).cast("double"))).alias(c) for c in numerics]).first()
    return {c: one[c] or 1.0 for c in numerics}


def sparse_rows(df: DataFrame, grams: str, numerics: dict[str, float], sgd: Sgd, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``idx`` (rising places) and ``val``; repeated n-grams add up, the text part has unit length.

    ``numerics`` has what each number is divided by; a missing number is zero.
    """
    names = [*keep, "_places", "_numbers"]
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / scale for c, scale in numerics.items()]
    raw = df.select(*keep, F.transform(F.col(grams), lambda g: place_of(g, sgd.places)).alias("_places"), F.array(*numbers, F.lit(1.0)).alias("_numbers"))
    own = np.arange(len(numerics) + 1, dtype=np.int32) + sgd.places

    def run(batches):
        for batch in batches:
            idx, val, ends = [], [], [0]
            for places, numbers in zip(batch.column("_places"), batch.column("_numbers")):
                at, n = np.unique(places.values.to_numpy() if places.is_valid else np.zeros(0, np.int32), return_counts=True)
                size = np.sqrt((n * n).sum()) or 1.0
                idx += [at.astype(np.int32), own]
                val += [n / size, numbers.values.to_numpy()]
                ends.append(ends[-1] + len(at) + len(own))
            flat = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat(v, k)) for v, k in ((idx, np.int32), (val, np.float32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *lists], names=[*keep, "idx", "val"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return raw.select(*names).mapInArrow(run, f"{kept}, idx array<int>, val array<float>")


def dealt(rows: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows with the number of their ``part``, stored, the distinct places of each part, and the number of parts."""
    stored = materialised(rows.withColumn("row", F.monotonically_increasing_id()), "sparse")
    parts = max(1, -(-stored.count() // part_rows))
    # As many partitions as parts: parts are few bytes but much work, so they must not share a task for being small.
    rows = stored.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).repartition(parts, "part")
    return rows, materialised(rows.select("part", F.explode("idx").alias("place")).distinct(), "needs"), parts


def part_weights(needs: DataFrame, weights: DataFrame, parts: int) -> DataFrame:
    """``part, place, w`` of the places that each part needs; null where there is no weight yet."""
    return needs.join(weights, "place", "left").select("part", "place", "w").repartition(parts, "part")


def _csr(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    idx = rows.column("idx").combine_chunks()
    return idx.flatten().to_numpy(), rows.column("val").combine_chunks().flatten().to_numpy(), np.diff(idx.offsets.to_numpy())


def _matrix(weights: pa.Table, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising places and their weights (places x classes)."""
    weights = weights.sort_by("place")
    w = weights.column("w").combine_chunks()
    out = np.zeros((len(w), classes), np.float32)
    out[w.is_valid().to_numpy(zero_copy_only=False)] = w.drop_null().flatten().to_numpy().reshape(-1, classes)
    return weights.column("place").to_numpy(), out


def probabilities(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def descend(places, weights, idx, val, sizes, labels, sgd: Sgd, epoch: int, seed: int) -> np.ndarray:
    """One pass of mini-batches over the rows of a part; the weights after it."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    order = shuffled(len(sizes), epoch, seed)
    flat = X.ranges(starts[order], sizes[order])
    return steps(weights, np.searchsorted(places, idx)[flat], val[flat], sizes[order], labels[order], np.zeros((len(order), 0)), sgd, epoch)


def shuffled(rows: int, epoch: int, seed: int) -> np.ndarray:
    """An order of the rows in which each mini-batch's rows may stand as they like."""
    return np.random.default_rng([seed, epoch]).permutation(rows)


def steps(weights: np.ndarray, at: np.ndarray, val: np.ndarray, sizes: np.ndarray, labels: np.ndarray, numbers: np.ndarray, sgd: Sgd, epoch: int) -> np.ndarray:
    """Mini-batches over rows in order: of each row ``sizes`` places with their values, which add up where a place comes again.

    ``numbers`` (rows, numbers) belong to the last places, which each row has.
    """
    step, last = sgd.step / (1 + epoch), len(weights) - numbers.shape[1]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    row = np.repeat(np.arange(len(sizes)) % sgd.batch, sizes)
    mark, number = np.zeros(len(weights), bool), np.zeros(len(weights), np.int64)
    most = sgd.batch * int(min(len(weights), max(np.diff(ends[:: sgd.batch], append=ends[-1]), default=0)))
    values, has, val, numbers = np.zeros(most, np.float32), np.zeros(most, np.float32), val.astype(np.float32), numbers.astype(np.float32)
    one = np.ones(sgd.batch, np.float32)
    for i in range(0, len(sizes), sgd.batch):
        rows = min(sgd.batch, len(sizes) - i)
        a, b = ends[i], ends[i + rows]
        own = at[a:b]
        mark[own] = True
        touched = np.flatnonzero(mark)
        mark[touched] = False
        number[touched] = np.arange(len(touched))
        flat, cells = row[a:b] * len(touched) + number[own], rows * len(touched)
        np.add.at(values, flat, val[a:b])
        has[flat] = 1
        x = values[:cells].reshape(rows, -1)
        n = numbers[i : i + rows]
        w, free = weights[touched], weights[last:]
        error = probabilities(x @ w + n @ free)
        error[np.arange(rows), labels[i : i + rows]] -= 1
        # A place's sum over the mini-batch grows with the root of its rows only, so that frequent places take no leaps.
        count = (one[:rows] @ has[:cells].reshape(rows, -1))[:, None]
        weights[touched] = w - step * ((x.T @ error) / np.sqrt(count) + sgd.l2 * w)
        weights[last:] = free - step * ((n.T @ error) / np.sqrt(rows) + sgd.l2 * free)
        values[flat] = has[flat] = 0
    return weights


def fit(rows: DataFrame, label: str, classes: list, sgd: Sgd = Sgd()) -> DataFrame:
    """``place, w`` (an array with a weight for each class, in order) from sparse rows with a label column.

    ``classes`` are the labels; rows with another label do not train.
    """
    numbered = F.element_at(F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))]), F.col(label))
    own, needs, parts = dealt(rows.withColumn("_y", numbered.cast("int")).where(F.col("_y").isNotNull()).select("idx", "val", "_y"), sgd.part_rows)

    def learn(rows: pa.Table, places: np.ndarray, weights: np.ndarray, epoch: int) -> np.ndarray:
        rows = rows.sort_by("row")
        return descend(places, weights, *_csr(rows), rows.column("_y").to_numpy(), sgd, epoch, int(rows.column("part")[0].as_py()))

    return epochs(own, needs, parts, len(classes), sgd, learn)


def epochs(own: DataFrame, needs: DataFrame, parts: int, k: int, sgd: Sgd, pass_over: Callable[[pa.Table, np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """``place, w`` after all epochs; ``pass_over`` takes a part's rows, its rising places, their weights and the epoch."""
    spark = own.sparkSession
    weights = spark.createDataFrame([], "place int, w array<float>")
    out_schema = pa.schema([("range", pa.int32()), ("place", pa.int32()), ("w", pa.list_(pa.float32()))])
    lists = lambda w: pa.FixedSizeListArray.from_arrays(pa.array(w.ravel(), pa.float32()), k).cast(pa.list_(pa.float32()))

    def learner(epoch: int):
        def learn(rows: pa.Table, weights: pa.Table) -> pa.Table:
            places, w = _matrix(weights, k)
            w = pass_over(rows, places, w, epoch)
            return pa.Table.from_arrays([pa.array(places >> sgd.range_bits), pa.array(places), lists(w)], schema=out_schema)

        return learn

    def average(made: pa.Table) -> pa.Table:
        """Mean weights of the places of one range."""
        place = made.column("place").to_numpy()
        w = made.column("w").combine_chunks().flatten().to_numpy().reshape(-1, k)
        order = np.argsort(place, kind="stable")
        edges = np.flatnonzero(np.diff(place[order], prepend=-1))
        count = np.diff(np.append(edges, len(place)))[:, None]
        return pa.table([pa.array(place[order][edges], pa.int32()), lists(np.add.reduceat(w[order], edges, axis=0) / count)], names=["place", "w"])

    for epoch in range(sgd.epochs):
        made = own.groupBy("part").cogroup(part_weights(needs, weights, parts).groupBy("part")).applyInArrow(learner(epoch), "range int, place int, w array<float>")
        weights = materialised(made.groupBy("range").applyInArrow(average, "place int, w array<float>"), "weights")
    return weights


def predict(rows: DataFrame, weights: DataFrame, classes: list, keep: list[str], part_rows: int = Sgd.part_rows) -> DataFrame:
    """The columns ``keep`` with ``predicted``, the class of largest probability, and ``confidence``, its share of all classes'."""
    own, needs, parts = dealt(rows.select(*keep, "idx", "val"), part_rows)
    k, schema = len(classes), rows.select(*keep).schema

    def score(rows: pa.Table, weights: pa.Table) -> pa.Table:
        places, w = _matrix(weights, k)
        idx, val, sizes = _csr(rows)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        p = probabilities(np.add.reduceat(w[np.searchsorted(places, idx)] * val[:, None], first, axis=0))
        best = p.argmax(axis=1)
        share = p[np.arange(len(p)), best] / p.sum(axis=1)
        return rows.select(keep).append_column("_best", pa.array(best, pa.int32())).append_column("confidence", pa.array(share.astype(np.float64)))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out = own.groupBy("part").cogroup(part_weights(needs, weights, parts).groupBy("part")).applyInArrow(score, f"{kept}, _best int, confidence double")
    return out.withColumn("predicted", F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("_best") + 1)).drop("_best")


@dataclass
class Hashed:
    """N-grams by their hashed places, as ``place_of`` gives them; all weigh the same."""

    low: int
    high: int
    places: int

    def pool(self) -> X.Pool:
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        return X.Pool(self.low, self.high, lambda g: signed(xxhash.xxh64_intdigest(g.encode(), 42)) % self.places)

    @property
    def idf(self) -> np.ndarray:
        return np.ones(self.places)


def text_numbers(table: pa.Table, numerics: dict[str, float]) -> np.ndarray:
    """(rows, numbers and a constant); a missing number is zero."""
    return np.stack([*(table.column(c).fill_null(0.0).to_numpy() / scale for c, scale in numerics.items()), np.ones(table.num_rows)], axis=1)


def dealt_texts(rows: DataFrame, keep: list[str], numerics: dict[str, float], grams: Hashed, part_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Stored blocks of rows with texts ``_t``, a row for each part; the places that each part needs; the number of parts."""
    parts = max(1, -(-rows.count() // part_rows))
    own = [F.col(c).cast("double").alias(c) for c in numerics]
    numbered = rows.select("_t", *keep, *own).withColumn("_row", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        names, code, _ = X.distinct(table)
        texts = X.Texts(grams)
        texts.start()
        arrays, _ = texts.of(names)
        places, at = np.unique(arrays.pop("place"), return_inverse=True)
        arrays.pop("idf")
        kept = {c: table.column(c).to_pylist() for c in keep}
        block = pickle.dumps(dict(**arrays, at=at.astype(np.int32), code=code.astype(np.int32), numbers=text_numbers(table, numerics), kept=kept), protocol=5)
        free = np.arange(len(numerics) + 1) + grams.places
        return pa.table({"part": table.column("part").slice(0, 1), "places": pa.array([np.concatenate([places, free])], pa.list_(pa.int32())), "block": pa.array([block], pa.binary())})

    stored = materialised(numbered.repartition(parts, "part").groupBy("part").applyInArrow(pack, "part int, places array<int>, block binary"), "parts")
    return stored.select("part", "block"), materialised(stored.select("part", F.explode("places").alias("place")), "needs"), parts


def text_rows(block: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (by number), values and sizes of the given rows; places may come again."""
    texts, words = int(block["code"].max()) + 1, int(max(block["word"].max(initial=-1), block["of_word"].max(initial=-1))) + 1
    pairs, grams = np.bincount(block["text"], minlength=texts), np.bincount(block["of_word"], minlength=words)
    text = block["code"][rows]
    pair = X.ranges((np.cumsum(pairs) - pairs)[text], pairs[text])
    word = block["word"][pair]
    size = grams[word]
    at = block["at"][X.ranges((np.cumsum(grams) - grams)[word], size)]
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(pairs[text])))]
    return at, np.repeat(block["times"][pair], size), np.diff(ends)


def fit_texts(rows: DataFrame, label: str, classes: list, numerics: dict[str, float], grams: Hashed, sgd: Sgd = Sgd()) -> DataFrame:
    """As ``fit``, of rows with texts ``_t`` in lower case."""
    numbered = F.element_at(F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))]), F.col(label))
    known = rows.withColumn("_y", numbered.cast("int")).where(F.col("_y").isNotNull())
    own, needs, parts = dealt_texts(known, ["_y"], numerics, grams, sgd.part_rows)

    def learn(rows: pa.Table, places: np.ndarray, weights: np.ndarray, epoch: int) -> np.ndarray:
        block = pickle.loads(rows.column("block")[0].as_py())
        order = shuffled(len(block["code"]), epoch, int(rows.column("part")[0].as_py()))
        return steps(weights, *text_rows(block, order), np.array(block["kept"]["_y"])[order], block["numbers"][order], sgd, epoch)

    return epochs(own, needs, parts, len(classes), sgd, learn)


def predict_texts(rows: DataFrame, weights: DataFrame, classes: list, keep: list[str], numerics: dict[str, float], grams: Hashed, part_rows: int = Sgd.part_rows) -> DataFrame:
    """As ``predict``, of rows with texts ``_t`` in lower case."""
    own, needs, parts = dealt_texts(rows, keep, numerics, grams, part_rows)
    k, types = len(classes), rows.select(*keep).schema

    def score(rows: pa.Table, weights: pa.Table) -> pa.Table:
        block = pickle.loads(rows.column("block")[0].as_py())
        _, w = _matrix(weights, k)
        numbers, texts = block["numbers"], int(block["code"].max()) + 1
        own = X.scores(dict(block, place=block["at"], idf=1.0), np.ascontiguousarray(w[: len(w) - numbers.shape[1]].T), texts)
        p = probabilities(own[:, block["code"]].T + numbers @ w[len(w) - numbers.shape[1] :])
        best = p.argmax(axis=1)
        share = p[np.arange(len(p)), best] / p.sum(axis=1)
        return pa.table([*(pa.array(block["kept"][c], t) for c, t in zip(keep, arrow)), pa.array(best, pa.int32()), pa.array(share)], names=[*keep, "_best", "confidence"])

    arrow = [to_arrow_type(f.dataType) for f in types]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)
    out = own.groupBy("part").cogroup(part_weights(needs, weights, parts).groupBy("part")).applyInArrow(score, f"{kept}, _best int, confidence double")
    return out.withColumn("predicted", F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("_best") + 1)).drop("_best")
