"""Reproducible samples and splits: every draw is the md5 of a seed and the row's key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import draw_key


def percent_sample(df: DataFrame, pct: float, seed: int, *key: str) -> DataFrame:
    """Each row with a chance of ``pct`` percent, by the draw of its key, however the rows are partitioned."""
    return df.where(uniform(seed, *map(F.col, key)) < pct / 100)


def block_sample(df: DataFrame, pct: float, seed: int) -> DataFrame:
    """Every row of about ``pct`` percent of the files of a table read from files; the others are not opened.

    As in a sample by blocks, rows of one file come or stay together, so the share of rows varies with the files' sizes.  The
    draw is of a file's place alone: Spark applies the condition to the list of files before it plans the scan.
    """
    return df.where(F.pmod(F.xxhash64("_metadata.file_path", F.lit(seed)), F.lit(1_000_000)) < round(pct * 10_000))


def cap_per_group(df: DataFrame, group: str | list[str], n: int, seed: int, *key: str) -> DataFrame:
    """Up to ``n`` rows of each group in drawn order; Spark prunes to n a partition before the exchange."""
    cols = [group] if isinstance(group, str) else group
    order = Window.partitionBy(*cols).orderBy(draw_key(seed, *map(F.col, key)), *key)
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def one_per_key(df: DataFrame, key: str, seed: int, *tie: str) -> DataFrame:
    return cap_per_group(df, key, 1, seed, *tie)


def least_drawn(keys: DataFrame, share: float | int, seed: int, key: str) -> DataFrame:
    """The keys of least draw: a number of them, or a share (a float; at least one): whole ranges of draws, and the first rows of one.

    Draws are counted by their first three digits (4,096 ranges), which tells the number of keys too; only within the
    range where the wanted number is reached are keys put in order.
    """
    drawn = keys.select(key, draw_key(seed, F.col(key)).alias("_d")).withColumn("_b", F.substring("_d", 1, 3))
    counts = drawn.groupBy("_b").agg(F.count("*").alias("n")).orderBy("_b").collect()
    left = max(1, math.floor(sum(r.n for r in counts) * share)) if isinstance(share, float) else share
    last = "zzz"
    for r in counts:
        if r.n > left:
            last = r._b
            break
        left -= r.n
    within = drawn.where(F.col("_b") == last).orderBy("_d", key).limit(left)
    return drawn.where(F.col("_b") < last).unionByName(within).select(key)


def random_n(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    return df.orderBy(draw_key(seed, *map(F.col, key)), *key).limit(n)


def stratified_sample(df: DataFrame, bucket: str, cap: int, n: int, seed: int, *key: str) -> DataFrame:
    """Up to ``cap`` of each bucket, then ``n`` of those in drawn order."""
    return random_n(cap_per_group(df, bucket, cap, seed, *key), n, seed + 1, *key)


def cap_then_trim(df: DataFrame, group: str, cap: int, n: int, order: str) -> DataFrame:
    """Up to ``cap`` of each group in input order, groups in order of their first row, cut to ``n`` rows."""
    within = Window.partitionBy(group).orderBy(order)
    rows = df.withColumns({"_rn": F.row_number().over(within), "_first": F.min(order).over(Window.partitionBy(group))})
    return rows.where(F.col("_rn") <= cap).orderBy("_first", order).limit(n).drop("_rn", "_first")


def claim_strata(df: DataFrame, strata: list[tuple[str, Column, int]], seed: int, key: str) -> DataFrame:
    """Rows of each stratum (name, condition, number) in turn; a key belongs to the first stratum that draws it."""
    left, out = df, None
    for i, (name, condition, n) in enumerate(strata):
        took = random_n(left.where(condition), n, seed + i, key).withColumn("stratum", F.lit(name))
        out = took if out is None else out.unionByName(took)
        left = left.join(took.select(key), key, "left_anti")
    return out


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) from the first 12 hexadecimal digits of the draw."""
    return (F.conv(F.substring(draw_key(seed, *key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows without replacement with chances by weight: the least -ln(u) / weight."""
    return df.orderBy(-F.log(uniform(seed, F.col(key))) / F.col(weight), key).limit(n)


def targeted_sample(matched: DataFrame, n: int, seed: int, key: str, leaf: str = "leaf") -> DataFrame:
    """Up to ``n`` keys of each wanted leaf; a key drawn for several goes to the first leaf by name.

    The cap comes before the keys are made unique, so a leaf may end with fewer.
    """
    capped = cap_per_group(matched, leaf, n, seed, key)
    order = Window.partitionBy(key).orderBy(leaf)
    return capped.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def gap_fill(matched: DataFrame, n: int, seed: int, key: str, previous: DataFrame, leaf: str = "leaf") -> DataFrame:
    """A targeted sample that leaves out what earlier passes took."""
    return targeted_sample(matched.join(previous.select(key), key, "left_anti"), n, seed, key, leaf)


def split_quota(n: int, ratio: float) -> tuple[int, int]:
    """``n`` shared between two providers; the remainder goes to the second."""
    first = int(n * ratio)
    return first, n - first


def merchant_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """``split``: validation for a drawn share of the keys (at least one), train for the rest; no key is in both.

    The rank is over distinct keys.
    """
    keys = df.select(key).distinct()
    chosen = least_drawn(keys, float(fraction), seed, key).withColumn("_v", F.lit(1))
    return df.join(chosen, key, "left").withColumn("split", F.when(F.col("_v") == 1, "validation").otherwise("train")).drop("_v")


def holdout(gold: DataFrame, key: str, label: str, fraction: float, seed: int) -> DataFrame:
    """As ``merchant_split`` over keys of one label; keys of conflicting labels always train."""
    agreed = gold.groupBy(key).agg((F.countDistinct(label) > 1).alias("conflicting"))
    calm = agreed.where("not conflicting").select(key)
    chosen = least_drawn(calm, float(fraction), seed, key).withColumn("_v", F.lit(1))
    out = gold.join(agreed, key).join(chosen, key, "left")
    return out.withColumn("split", F.when(F.col("_v") == 1, "holdout").otherwise("train")).drop("_v")


def oversample(df: DataFrame, flag: str, k: int) -> DataFrame:
    """Flagged rows ``k`` times."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col(flag), k).otherwise(1))))


def supersede(tier_b: DataFrame, tier_a: DataFrame, key: str) -> DataFrame:
    """Rows of the lesser tier whose key the better one lacks, below those of the better one."""
    return tier_a.unionByName(tier_b.join(tier_a.select(key), key, "left_anti"))


def map_abstain(df: DataFrame, leaf: str = "leaf", residual: str = "unclassified_other") -> DataFrame:
    """Abstaining tiers carry the residual leaf; no row is dropped."""
    return df.withColumn(leaf, F.when(F.col("tier").startswith("abstain"), residual).otherwise(F.col(leaf)))


def auto_resolve(sample: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Sampled rows with the established leaf, or marked for review."""
    out = sample.join(truth.select(key, F.col("leaf").alias("known_leaf")), key, "left")
    return out.withColumn("provenance", F.when(F.col("known_leaf").isNotNull(), "established").otherwise("review"))


def thin_classes(leaves: DataFrame, examples: DataFrame, least: int) -> DataFrame:
    """Leaves with fewer than ``least`` examples, those without any included."""
    counts = examples.groupBy("leaf").agg(F.count("*").alias("n"))
    return leaves.join(counts, "leaf", "left").select("leaf", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def class_profile(leaves: DataFrame, train: DataFrame) -> DataFrame:
    """Examples of each leaf and their share."""
    total = train.agg(F.count("*").alias("_t"))
    counts = train.groupBy("leaf").agg(F.count("*").alias("n"))
    out = leaves.join(counts, "leaf", "left").crossJoin(F.broadcast(total))
    return out.select("leaf", F.coalesce("n", F.lit(0)).alias("n"), F.round(100 * F.coalesce("n", F.lit(0)) / F.col("_t"), 4).alias("pct"))
