"""Accuracy at leaf and general level, by group, weighted, calibrated, and with leakage flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_generals(df: DataFrame, taxonomy: DataFrame, *leaf_cols: str) -> DataFrame:
    """``<col>_general`` of each leaf column; null for unknown leaves."""
    meta = taxonomy.select(F.col("leaf").alias("_l"), F.col("general").alias("_g"))
    for c in leaf_cols:
        df = df.join(meta.withColumnRenamed("_g", f"{c}_general"), F.col(c) == F.col("_l"), "left").drop("_l")
    return df


def gold_with_pred(gold: DataFrame, preds: DataFrame, key: str = "merchant", pred: str = "pred") -> DataFrame:
    """Gold rows with their prediction; rows that have none are left out."""
    return gold.join(preds.where(F.col(pred).isNotNull()), key)


def score_votes(votes: DataFrame, gold: DataFrame, taxonomy: DataFrame, *by: str, pred: str = "leaf", other: str = "alt_leaf") -> DataFrame:
    """Accuracy of voted leaves over gold merchants at leaf and general level; an alternative leaf counts as right.

    A right leaf is right at general level too.  With ``by``, for each value of those columns.
    """
    rows = with_generals(gold_with_pred(gold, votes.withColumnRenamed(pred, "pred")), taxonomy, "pred", "gold_leaf")
    alt = (F.coalesce(other, F.lit("")) != "") & (F.col("pred") == F.col(other))
    rows = rows.withColumn("_leaf", (F.col("pred") == F.col("gold_leaf")) | F.coalesce(alt, F.lit(False)))
    general = F.col("_leaf") | F.col("pred_general").eqNullSafe(F.col("gold_leaf_general"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), _share(F.col("_leaf")).alias("leaf_accuracy"), _share(general).alias("general_accuracy"))


def _share(c: Column) -> Column:
    return F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)


def _shares(pred: str, gold: str, null_equal: bool) -> list[Column]:
    a, b = F.col(f"{pred}_general"), F.col(f"{gold}_general")
    return [F.count("*").alias("n"), _share(F.col(pred) == F.col(gold)).alias("leaf_accuracy"), _share(a.eqNullSafe(b) if null_equal else a == b).alias("general_accuracy")]


def accuracy(df: DataFrame, pred: str, gold: str, null_equal: bool = True, *by: str) -> DataFrame:
    """Rows with a prediction, and the shares that are right at leaf and at general level; null and 0 without rows.

    ``null_equal``: whether two unknown general categories count as equal.
    """
    rows = df.where(F.coalesce(pred, F.lit("")) != "")
    return (rows.groupBy(*by) if by else rows).agg(*_shares(pred, gold, null_equal))


def accuracy_by(df: DataFrame, pred: str, gold: str, col: str) -> DataFrame:
    """As ``accuracy`` for each value of a column, and for ALL, in one pass."""
    out = df.where(F.coalesce(pred, F.lit("")) != "").rollup(col).agg(*_shares(pred, gold, True), F.grouping(col).alias("_all"))
    return out.withColumn("grp", F.when(F.col("_all") == 1, "ALL").otherwise(F.col(col))).drop(col, "_all")


def volume_accuracy(df: DataFrame, pred: str, gold: str, weight: str) -> DataFrame:
    """Share of the volume that is right."""
    rows = df.where(F.coalesce(pred, F.lit("")) != "")
    right = lambda c: F.round(F.sum(F.when(c, F.col(weight)).otherwise(0)) / F.sum(weight), 6)
    return rows.agg(right(F.col(pred) == F.col(gold)).alias("leaf_accuracy"), right(F.col(f"{pred}_general").eqNullSafe(F.col(f"{gold}_general"))).alias("general_accuracy"))


def accepted_accuracy(df: DataFrame, pred: str, gold: str, other: str) -> DataFrame:
    """Right if the prediction is the gold leaf or the other accepted one (a curated or an alternative leaf)."""
    alt = (F.coalesce(other, F.lit("")) != "") & (F.col(pred) == F.col(other))
    rows = df.where(F.coalesce(pred, F.lit("")) != "")
    return rows.agg(F.count("*").alias("n"), _share((F.col(pred) == F.col(gold)) | F.coalesce(alt, F.lit(False))).alias("accuracy"))


def error_profile(df: DataFrame, pred: str, gold: str, curated: str, residual: str = "unclassified_other") -> DataFrame:
    """Rates of abstaining, of near misses (right general, wrong leaf) and of rows that the curated leaf rescues."""
    wrong = F.coalesce(F.col(pred) != F.col(gold), F.lit(True))
    return df.agg(
        F.count("*").alias("n"),
        _share(F.coalesce(pred, F.lit("")).isin("", residual)).alias("abstained"),
        _share(wrong & (F.col(f"{pred}_general") == F.col(f"{gold}_general"))).alias("near_miss"),
        _share(wrong & (F.col(pred) == F.col(curated))).alias("rescued"),
    )


def calibration(df: DataFrame, pred: str, gold: str, bucket: Column) -> DataFrame:
    """Accuracy in each confidence bucket."""
    return df.where(F.coalesce(pred, F.lit("")) != "").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), _share(F.col(pred) == F.col(gold)).alias("accuracy"))


def circular_flags(gold: DataFrame, dictionary: DataFrame, circular_sources: list[str]) -> DataFrame:
    """Whether a gold row's label came from what is being judged: its source, or a dictionary entry of that source."""
    known = dictionary.groupBy("merchant").agg(F.min("source").alias("dictionary_source"))
    out = gold.join(known, "merchant", "left")
    flag = F.col("gold_source").isin(circular_sources) | ((F.col("gold_source") == "dictionary") & F.col("dictionary_source").isNotNull())
    return out.withColumn("circular", F.coalesce(flag, F.lit(False)))


def clean_vs_full(df: DataFrame, pred: str, gold: str) -> DataFrame:
    """Accuracy over all rows and over those that are not circular."""
    full = accuracy(df, pred, gold).withColumn("rows", F.lit("full"))
    return full.unionByName(accuracy(df.where("not circular"), pred, gold).withColumn("rows", F.lit("clean")))


def by_coverage(df: DataFrame, dictionary: DataFrame, pred: str, gold: str) -> DataFrame:
    """Accuracy of rows in and out of the dictionary."""
    known = dictionary.select("merchant").distinct().withColumn("_k", F.lit(1))
    flagged = df.join(known, "merchant", "left").withColumn("in_dictionary", F.col("_k").isNotNull())
    return accuracy(flagged, pred, gold, True, "in_dictionary")


def wins(df: DataFrame, ours: str, native: str, gold: str) -> DataFrame:
    """Rows where we are right and the feed is wrong, and the other way round."""
    us, them = F.coalesce(F.col(ours) == F.col(gold), F.lit(False)), F.coalesce(F.col(native) == F.col(gold), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(us & ~them).alias("wins"), F.count_if(~us & them).alias("losses"))


def modal_vote(preds: DataFrame, key: str, leaf: str, confidence: str) -> DataFrame:
    """The leaf most rows of a key are given (ties: the lesser), with the mean confidence of the key."""
    counts = preds.groupBy(key, leaf).agg(F.count("*").alias("votes"), F.sum(confidence).alias("_c"), F.count(confidence).alias("_n"))
    whole = Window.partitionBy(key)
    ranked = counts.withColumns({"_rn": F.row_number().over(whole.orderBy(F.col("votes").desc(), leaf)), "confidence": F.round(F.sum("_c").over(whole) / F.nullif(F.sum("_n").over(whole), F.lit(0)), 6)})
    return ranked.where("_rn = 1").select(key, leaf, "votes", "confidence")
