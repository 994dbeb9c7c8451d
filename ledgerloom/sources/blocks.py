"""Reports that hold tagged transaction blocks in one text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import safe_double, safe_ts, surrogate_key


def explode_blocks(df: DataFrame, col: str, tag: str) -> DataFrame:
    """A row for each ``<tag>...</tag>`` block, its inside in ``block``."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return df.withColumn("block", F.explode(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)))).drop(col)


def extract_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A column for each tag: the first match in ``block``, null if there is none or it is empty."""
    return df.withColumns({c: F.nullif(F.regexp_extract("block", f"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit("")) for c, tag in fields.items()}).drop("block")


def typed_transactions(df: DataFrame) -> DataFrame:
    """Amount and time cast where they can be, and a key over all fields."""
    return df.select("id", F.col("merchant"), safe_double(F.col("amount")).alias("amount"), safe_ts(F.col("booked_at")).alias("booked_at"), surrogate_key(F.col("id"), F.col("merchant"), F.col("amount"), F.col("booked_at")).alias("key"))


def latest_row(df: DataFrame, key: str, by: str, *ties: str) -> DataFrame:
    """The row of greatest ``by`` for each key; ties by the other columns given."""
    order = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last(), *ties)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
