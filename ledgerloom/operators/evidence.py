"""Evidence about merchant strings for labelling, and the requests made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.tables import stable_ids


def top_k_counts(df: DataFrame, key: str, col: str, k: int) -> DataFrame:
    """``key, value, n, rank``: the k most frequent values of each key, null counting as one; ties by value, null last."""
    counts = df.groupBy(key, F.col(col).alias("value")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def evidence(feed_b: DataFrame) -> DataFrame:
    """Credit share, median absolute amount, top 2 categories and top 3 narratives of each merchant ``m``.

    Amounts are counted apart from categories and narratives; the two scans read different columns.  Counts run over each
    merchant's amounts in order (the exact median), a sort that spills where a merchant is hot.  Of categories and
    narratives only the first ranks of each partition reach the exchange by merchant.
    """
    counts = feed_b.groupBy("m", F.abs("amount").cast("double").alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "credit").alias("c"))
    own = Window.partitionBy("m")
    valued = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    run = counts.withColumns({"upto": F.sum(valued).over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(valued).over(own)})
    at = lambda place: F.max(F.when(F.col("v").isNotNull() & (place < F.col("upto")) & (place >= F.col("upto") - F.col("n")), F.col("v")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    amounts = run.groupBy("m").agg(F.round(F.sum("c") / F.sum("n"), 2).alias("pct_credit"), F.round((at(low) + at(high)) / 2, 4).alias("median_amount"))
    kind = lambda name, value: F.struct(F.lit(name).alias("kind"), F.col(value).cast("string").alias("value"))
    values = feed_b.select("m", F.inline(F.array(kind("cat", "cat"), kind("desc", "description_raw")))).groupBy("m", "kind", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("m", "kind").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()))
    ranked = values.withColumn("rank", rank).where("rank <= 3")
    top = lambda name, k: F.array_sort(F.collect_list(F.when((F.col("kind") == name) & (F.col("rank") <= k), F.struct("rank", "value", "n"))))
    shown = lambda c: F.transform(c, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count")))
    tops = ranked.groupBy(F.col("m").alias("_m")).agg(shown(top("cat", 2)).alias("cats"), shown(top("desc", 3)).alias("descs"))
    return amounts.join(tops, F.col("m").eqNullSafe(F.col("_m"))).select("m", "pct_credit", "median_amount", "cats", "descs")


def render_evidence(df: DataFrame, col: str, trim: int = 70) -> DataFrame:
    """``value countx; value countx`` of a list of values and counts, values cut to ``trim`` characters."""
    text = F.array_join(F.transform(col, lambda x: F.concat(F.substring(F.coalesce(x["value"], F.lit("n/a")), 1, trim), F.lit(" "), x["count"].cast("string"), F.lit("x"))), "; ")
    return df.withColumn(f"{col}_text", text)


def category_mix(df: DataFrame, key: str, col: str, k: int, between: str = ", ") -> DataFrame:
    """The k largest categories of each key with their share in percent, as one text."""
    whole = Window.partitionBy(key)
    counts = df.groupBy(key, col).agg(F.count("*").alias("n"))
    counts = counts.withColumns({"total": F.sum("n").over(whole), "rank": F.row_number().over(whole.orderBy(F.col("n").desc(), F.col(col).asc_nulls_last()))}).where(F.col("rank") <= k)
    part = F.concat(F.coalesce(F.col(col), F.lit("n/a")), F.lit(" "), F.round(100 * F.col("n") / F.col("total"), 0).cast("int").cast("string"), F.lit("%"))
    out = counts.select(key, F.struct("rank", part.alias("part")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return out.select(key, F.array_join(F.transform("ps", lambda x: x["part"]), between).alias("mix"))


def native_share(df: DataFrame, key: str, col: str, k: int = 2) -> DataFrame:
    """The provider's own k largest categories of each key with their share."""
    return category_mix(df, key, col, k, " · ").withColumnRenamed("mix", "native")


def render_requests(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Numbered request lines in batches of ``n`` rows: ``batch, request``."""
    rows = stable_ids(df, order, -1).withColumnRenamed("row_id", "_rn")
    line = F.concat((F.col("_rn") % n + 1).cast("string"), F.lit(". "), F.coalesce("merchant", F.lit("n/a")))
    each = rows.select(F.floor(F.col("_rn") / n).alias("batch"), F.struct((F.col("_rn") % n).alias("i"), line.alias("line")).alias("l"))
    return each.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("request"))


def leaf_examples(dictionary: DataFrame, k: int) -> DataFrame:
    """Up to k example merchants of each leaf, in order, as one line."""
    order = Window.partitionBy("leaf").orderBy("merchant")
    rows = dictionary.select("leaf", "merchant").distinct().withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
    return rows.groupBy("leaf").agg(F.array_join(F.array_sort(F.collect_list("merchant")), ", ").alias("examples"))


def top_strings(population: DataFrame, exclude: DataFrame, n: int) -> DataFrame:
    """The n strings of largest volume that are not in ``exclude``."""
    return population.join(exclude.select("merchant"), "merchant", "left_anti").orderBy(F.col("volume").desc(), "merchant").limit(n)


def coverage(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Strings and share of volume whose key is in a lookup."""
    known = lookup.select("merchant").distinct().withColumn("_k", F.lit(1))
    return df.join(known, "merchant", "left").agg(F.count_if(F.col("_k").isNotNull()).alias("strings"), F.round(F.sum(F.when(F.col("_k").isNotNull(), F.col("volume")).otherwise(0)) / F.sum("volume"), 6).alias("share"))


def topn_share(df: DataFrame, n: int) -> DataFrame:
    """Share of the volume that the n largest strings have."""
    top = df.orderBy(F.col("volume").desc(), "merchant").limit(n).agg(F.sum("volume").alias("t"))
    return top.crossJoin(F.broadcast(df.agg(F.sum("volume").alias("v")))).select(F.round(F.col("t") / F.col("v"), 6).alias("share"))
