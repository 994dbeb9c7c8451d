"""Data-quality checks; each returns the rows that break its rule.  Also dictionary and verdict merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.seeds import parse_sources


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, with their number."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def multi_parent(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Children of more than one parent."""
    return df.groupBy(child).agg(F.countDistinct(parent).alias("parents")).where("parents > 1")


def bad_domain(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is not allowed; null is not."""
    return df.where(~F.coalesce(F.col(col).isin(allowed), F.lit(False)))


def bad_boolean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a flag that is neither the text true nor false."""
    wrong = F.lit(False)
    for c in cols:
        wrong = wrong | ~F.coalesce(F.col(c).isin("true", "false"), F.lit(False))
    return df.where(wrong)


def ambiguous_sources(taxonomy: DataFrame, col: str = "sources") -> DataFrame:
    """Provider values that map to more than one leaf; compound entries are not looked at."""
    return parse_sources(taxonomy, col).groupBy("kind", "value").agg(F.countDistinct("leaf").alias("leaves")).where("leaves > 1")


def set_drift(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """What is there but not expected, and expected but not there."""
    return actual.exceptAll(expected).withColumn("side", F.lit("unexpected")).unionByName(expected.exceptAll(actual).withColumn("side", F.lit("missing")))


def unknown_leaves(df: DataFrame, taxonomy: DataFrame, col: str = "leaf") -> DataFrame:
    return df.where(f"coalesce({col}, '') <> ''").join(taxonomy.select(F.col("leaf").alias(col)), col, "left_anti")


def uncovered_values(feed: DataFrame, col: str, known: DataFrame) -> DataFrame:
    """Distinct feed values that no source names."""
    values = feed.where(f"{col} is not null").select(F.col(col).alias("value")).distinct()
    return values.join(known.select("value"), "value", "left_anti")


def split_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both sides of a split; must be empty."""
    return a.select(key).intersect(b.select(key))


def first_seen_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def build_dictionary(sources: list[DataFrame], key: str = "merchant") -> DataFrame:
    """Sources of (merchant, leaf) in order of trust; the first that names a merchant wins."""
    ranked = [s.select(key, "leaf").withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    return first_seen_wins(every, key, ["source_rank", "leaf"])


def merge_verdicts(sources: list[DataFrame], key: str = "merchant") -> DataFrame:
    """Sources of verdicts in order of time; the last that judges a key wins."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    return first_seen_wins(every, key, [F.col("source_rank").desc(), "verdict"])


def promotable(gold: DataFrame, known: DataFrame, rails: str, mechanism_leaves: list[str], order: str = "row_no") -> DataFrame:
    """Gold merchants fit for the dictionary: one leaf, a reviewer's note, no generic payment rail, no mechanism leaf,
    not known yet.  The first note by ``order`` goes along."""
    said = F.when(F.trim(F.coalesce("notes", F.lit(""))) != "", F.struct(order, "notes"))
    one = gold.groupBy("merchant").agg(F.countDistinct("gold_leaf").alias("n"), F.min("gold_leaf").alias("leaf"), F.min(said)["notes"].alias("notes"))
    one = one.where("n = 1 and notes is not null").drop("n")
    fit = one.where(~F.col("merchant").rlike(rails) & ~F.col("leaf").isin(mechanism_leaves))
    return fit.join(known.select("merchant"), "merchant", "left_anti")
