"""Provider feeds in their raw columns, brought to common ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_feed_a(df: DataFrame) -> DataFrame:
    """Curated-vendor feed: primary and sub category, vendor, description, direction from the type id (1: credit)."""
    return df.select(
        F.col("PrimaryCategoryDescription").alias("pri"),
        F.col("SubCategoryDescription").alias("sub"),
        F.col("VendorDescription").alias("vendor"),
        F.col("Description").alias("description_raw"),
        F.when(F.col("TransactionTypeId") == 1, "credit").otherwise("debit").alias("direction"),
        F.col("Amount").alias("amount"),
        *[c for c in df.columns if c in ("ts", "applicant")],
    )


def read_feed_b(df: DataFrame) -> DataFrame:
    """Raw-text feed: first description that is there, direction from the sign (negative: credit)."""
    return df.select(
        F.col("credit_category_detailed").alias("cat"),
        F.col("merchant_name").alias("merchant_raw"),
        F.coalesce("original_description", "transaction_name").alias("description_raw"),
        F.when(F.col("amount") < 0, "credit").otherwise("debit").alias("direction"),
        "amount",
        *[c for c in df.columns if c in ("ts", "applicant")],
    )


def union_feeds(a: DataFrame, b: DataFrame, tag_a: str = "A", tag_b: str = "B") -> DataFrame:
    """Rows of both, each with its provider."""
    return a.withColumn("provider", F.lit(tag_a)).unionByName(b.withColumn("provider", F.lit(tag_b)))


def debit_only_a(df: DataFrame) -> DataFrame:
    return df.where(F.col("TransactionTypeId") == 2)


def debit_only_b(df: DataFrame) -> DataFrame:
    return df.where(F.col("amount") > 0)


def has_merchant(df: DataFrame, col: str) -> DataFrame:
    """Rows whose merchant is there and not blank."""
    return df.where(F.col(col).isNotNull() & (F.regexp_replace(F.col(col), r"\s+", "") != ""))


def exclude_primaries(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """Rows whose value is none of ``values``; null goes too, as in SQL's NOT IN."""
    return df.where(~F.col(col).isin(values))
