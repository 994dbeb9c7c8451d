"""Approximate evidence with constant state for each key: top values and quantiles by mergeable sketches.

The exact forms in ``evidence.py`` count every value of a key.  These keep at most ``tracked`` values and ``accuracy``
numbers a key, in tasks before the exchange and after it, so a key of any size costs the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_values(col: str | Column, k: int, tracked: int) -> Column:
    """The k most frequent values, null counting as one: ``array<struct<value, count>>``, ties by value, null last.

    A count is exact while a key has at most about three quarters of ``tracked`` values, a power of two; beyond that it
    is below the truth by no more than ``count_error``.
    """
    if tracked & (tracked - 1) or tracked < 2 * k:
        raise ValueError("tracked must be a power of two and twice k at least")
    # More are asked for than shown, so that ties at the end are settled by value wherever the sketch holds them all.
    some = F.call_function("approx_top_k", F.col(col) if isinstance(col, str) else col, F.lit(min(tracked, max(64, 2 * k))), F.lit(tracked))
    keyed = F.transform(some, lambda x: F.struct((-x["count"]).alias("n"), x["item"].isNull().alias("none"), x["item"].alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: F.struct(x["value"].alias("value"), (-x["n"]).alias("count")))


def count_error(rows: int, tracked: int) -> float:
    """The most by which a count of ``top_values`` is below the truth, of so many rows of a key."""
    return 3.5 * rows / tracked


def quantile(col: Column, q: float, accuracy: int) -> Column:
    """A quantile by a sketch whose ranks are off by about 1.7 / ``accuracy`` of the rows; null without values."""
    return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(col.cast("double"), F.lit(accuracy)), F.lit(q))


def evidence(feed_b: DataFrame, tracked: int = 1024, accuracy: int = 400) -> DataFrame:
    """Credit share, median absolute amount, top 2 categories and top 3 narratives of each merchant ``m``, in one exchange."""
    have = F.count(F.col("amount"))
    return feed_b.groupBy("m").agg(
        F.round(F.avg((F.col("direction") == "credit").cast("int")), 2).alias("pct_credit"),
        F.when(have > 0, F.round(quantile(F.abs("amount"), 0.5, accuracy), 4)).alias("median_amount"),
        top_values("cat", 2, tracked).alias("cats"),
        top_values("description_raw", 3, tracked).alias("descs"),
    )
