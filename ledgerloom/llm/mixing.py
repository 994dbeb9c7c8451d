"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words.  Sources get cyclic weights in code-point order (null last); targets share
the total size by weight and stop at ``cap`` times a source's size, the excess going to the others by weight.

The document rates are those of least entropy, relative to one copy of each word and with at most ``cap`` copies, that
meet the token constraints of the sources and keep the mix's mean log length of documents at that of the corpus:

    rate = min(cap, exp(x[source] + y * (log(1 + size) - mean)))

The dual is convex in the ``x`` of all sources and the one ``y`` that ties them together.  Each Newton step sums its
gradient and its Hessian (an arrow: a diagonal over sources and the row of ``y``) over partitions by a pre-aggregated
group, solves for ``y`` by the Schur complement of the diagonal and updates every ``x`` in the table of sources.  The
length constraint is soft: ``y`` stays within ``most_tilt`` either way, which is a price of ``most_tilt`` for each unit
of its violation, so targets that leave no room for it (sources of one document) still have an optimum.

Rates are then rounded to whole copies by error diffusion: a source is dealt by a hash of id and text into buckets of
about ``bucket_rows`` rows or ``bucket_words`` words (more buckets for a larger source, so a hot source is spread), and
within a bucket, largest documents first, each takes the copies that bring the sum nearest its target.

Defined results: a null text has size 0 and a document of size 0 takes nothing; a source without words has target 0;
repeated rows are separate documents, and so are rows of one id; an empty table gives an empty table; columns of
clashing names are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD_RE, stored, text_of


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """``source, n_docs, source_size, target`` for each source; the windows run over the small table of sources.

    With sources in order of cap size over weight, those whose share would exceed the cap come first; the level that
    the others share by weight is the largest one found at any place of that order.
    """
    each = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    each = each.withColumn("weight", F.element_at(table, ((place - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    each = each.withColumns({"room": cap * F.col("source_size"), "total": F.sum("source_size").over(every).cast("double"), "weights": F.sum("weight").over(every)})
    before = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    taken, used = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("room", "weight"))
    each = each.withColumn("level", (F.col("total") - taken) / (F.col("weights") - used))
    each = each.withColumn("target", F.least("room", F.col("weight") * F.max("level").over(every)))
    return each.select("source", "n_docs", "source_size", "target")


def log_length(mean: float) -> Column:
    """A document's log length, less the corpus mean."""
    return F.log1p(F.col("size").cast("double")) - mean


def tilted(y: float, mean: float, cap: float) -> Column:
    """A document's rate under the dual variables ``x`` of its source and ``y``."""
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(60.0), F.col("x") + y * log_length(mean))))


def balance(sizes: DataFrame, targets: DataFrame, cap: float = 3.0, most_tilt: float = 1.0, steps: int = 40, close: float = 1e-7, missed: float = 1e-4) -> tuple[DataFrame, float, float]:
    """``targets`` with the dual variable ``x`` of each source, the tilt ``y`` and the mean log length.

    The last third of the steps leaves ``y`` as it is, so the sources' constraints are met whatever became of the other.
    Raises an error where some source is further than the share ``missed`` from its target after all steps.
    """
    kinds = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).withColumn("words", F.col("size") * F.col("n")), "kinds")
    whole = kinds.agg(F.sum(F.col("words") * F.log1p("size")).alias("length"), F.sum("words").alias("words")).first()
    if not whole.words:
        return targets.withColumn("x", F.lit(None).cast("double")), 0.0, 0.0
    mean, y = round(whole.length / whole.words, 9), 0.0
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    # A source at its cap takes every copy there is, and needs no dual variable.
    start = F.when(full, F.lit(60.0)).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = targets.withColumn("x", F.when((F.col("source_size") > 0) & (F.col("target") > 0), start))
    # Sums of the tilted sizes (mass), their log lengths (pull) and, over documents below the cap, the Hessian's parts.
    free = lambda c: F.sum(F.when(F.col("rate") < cap, c).otherwise(0.0))
    mass = F.col("words") * F.col("rate")
    for step in range(steps):
        rated = kinds.join(state.select(F.col("source").alias("of"), "x"), F.col("source").eqNullSafe(F.col("of")))
        rated = rated.where("x is not null").withColumn("rate", tilted(y, mean, cap)).withColumn("f", log_length(mean))
        sums = rated.groupBy("of").agg(F.sum(mass).alias("mass"), F.sum(mass * F.col("f")).alias("pull"), free(mass).alias("h"), free(mass * F.col("f")).alias("hy"), free(mass * F.col("f") * F.col("f")).alias("yy"))
        state = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        state = stored(state, "dual")
        short = F.col("target") - F.col("mass")
        moved = F.when(F.col("h") > 0, F.col("hy") / F.col("h"))
        got = state.agg(
            F.sum("pull").alias("pull"),
            F.sum("yy").alias("yy"),
            F.sum(moved * F.col("hy")).alias("taken"),
            F.sum(moved * short).alias("given"),
            F.max(F.abs(short) / F.greatest("target", F.lit(1.0))).alias("off"),
            F.sum("mass").alias("mass"),
        ).first()
        curve, slope = (got.yy or 0.0) - (got.taken or 0.0), -(got.pull or 0.0) - (got.given or 0.0)
        dy = slope / curve if step < steps * 2 // 3 and curve > 1e-9 * (got.mass or 1.0) else 0.0
        dy = max(-most_tilt, min(most_tilt, y + max(-0.5, min(0.5, dy)))) - y
        if (got.off or 0.0) < close and abs(dy) < close:
            state = state.drop("mass", "pull", "h", "hy", "yy")
            break
        y += dy
        dx = F.when(F.col("h") > 0, (short - F.col("hy") * dy) / F.col("h")).otherwise(0.0)
        state = state.withColumn("x", F.col("x") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dx))).drop("mass", "pull", "h", "hy", "yy")
    else:
        if (got.off or 0.0) > missed:
            raise RuntimeError(f"after {steps} Newton steps a source is {got.off:.2%} off its target")
    # Sums depend on the order of partitions in their last digits; what follows from them must not.
    return state.withColumn("x", F.round("x", 9)), round(y, 9), mean


def diffuse(sizes: np.ndarray, rates: np.ndarray, cap: int) -> np.ndarray:
    """Whole copies for sizes in falling order, each the count that keeps the running sum nearest its target."""
    out, error = [], 0.0
    for s, rate in zip(sizes.tolist(), rates.tolist()):
        want = rate * s + error
        copies = min(cap, max(0, int(want / s + 0.5))) if s else 0
        out.append(copies)
        error = want - copies * s
    return np.array(out, np.int64)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, bucket_rows: int = 4096, bucket_words: int = 1 << 20, carry: list[Column] | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` of every document.

    With ``carry`` the struct ``rest`` of those columns goes along, which saves joining them back.
    """
    rest = [F.struct(*carry).alias("rest")] if carry else []
    text = text_of()
    size = F.regexp_count(text, F.lit(WORD_RE)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("name"), *rest)
    sizes = stored(rows.drop("rest"), "sizes")
    targets = stored(source_targets(sizes, weights, cap), "targets")
    dual, y, mean = balance(sizes, targets, cap)
    joined = (rows if carry else sizes).join(dual.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.withColumn("rate", F.when(F.col("size") > 0, F.coalesce(tilted(y, mean, cap), F.lit(0.0))).otherwise(0.0)).drop("x")
    buckets = F.ceil(F.greatest(F.col("n_docs") / bucket_rows, F.col("source_size") / bucket_words, F.lit(1)))
    joined = joined.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "name"), buckets))
    kept = ["doc_id", "source", "size", "source_size", "target", "rate", *(["rest"] if carry else [])]
    types = dict(joined.dtypes)

    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("size", "descending"), ("doc_id", "ascending"), ("name", "ascending")])
        copies = diffuse(bucket.column("size").to_numpy(), bucket.column("rate").to_numpy(), cap)
        out = bucket.select(kept).append_column("copies", pa.array(copies))
        return out.append_column("taken", pa.array(copies * bucket.column("size").to_numpy()))

    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", copies long, taken long"
    return joined.groupBy("source", "bucket").applyInArrow(run, schema)
