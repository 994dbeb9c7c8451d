"""Agreement and coverage of two providers over shared merchants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import norm_merchant, split_pair
from ledgerloom.operators.waterfall import Seeds


def with_coarse(df: DataFrame, coarse: list[str]) -> DataFrame:
    """Whether the leaf is a catch-all."""
    return df.withColumn("is_coarse", F.col("leaf").isin(coarse))


def with_risk(df: DataFrame, taxonomy: DataFrame, risky_generals: list[str], leaf: str = "leaf") -> DataFrame:
    """Whether a leaf is risky: by general category, priority debt, age restriction or debt; an unknown leaf is not."""
    flags = (F.col("general").isin(risky_generals)) | (F.col("is_priority") == "true") | (F.col("is_age") == "true") | (F.col("is_debt") == "true")
    known = taxonomy.select(F.col("leaf").alias("_leaf"), flags.alias("_risky"))
    return df.join(known, F.col(leaf) == F.col("_leaf"), "left").withColumn("risky", F.coalesce("_risky", F.lit(False))).drop("_leaf", "_risky")


def keys_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def keys_not_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def category_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def modal_row(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key (ties: the lesser value, null last), its count and the key's volume.

    Counts are grouped first, so a hot key reaches the window as one row for each of its values.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col(value).asc_nulls_last())
    whole = Window.partitionBy(key)
    return counts.withColumns({"_rn": F.row_number().over(order), "volume": F.sum("n").over(whole)}).where("_rn = 1").drop("_rn").select(key, value, "n", "volume")


def shared_merchants(modal_a: DataFrame, modal_b: DataFrame) -> DataFrame:
    """Merchants of both feeds with each feed's modal category and volume."""
    one = modal_a.select("m", "pair", F.col("volume").alias("volume_a"))
    return one.join(modal_b.select("m", "cat", F.col("volume").alias("volume_b")), "m").select("m", "pair", "cat", "volume_a", "volume_b")


def distinct_vendors(feed_a: DataFrame) -> DataFrame:
    return feed_a.where("vendor is not null").select(norm_merchant(F.col("vendor")).alias("merchant")).distinct()


def unmatched(strings: DataFrame, vendors: DataFrame) -> DataFrame:
    """Merchants of feed B that feed A has no vendor for."""
    return strings.join(vendors, "merchant", "left_anti")


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def all_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def with_leaves(shared: DataFrame, seeds: Seeds) -> DataFrame:
    """Both feeds' leaves of shared merchants by the plain crosswalk (null where it has none)."""
    pri, sub = split_pair(F.col("pair"))
    out = shared.withColumns({"_p": pri, "_s": sub})
    out = out.join(seeds.lookup(seeds.kind("sub"), "_s", "_sub"), "_s", "left").join(seeds.lookup(seeds.kind("pri"), "_p", "_pri"), "_p", "left")
    out = out.join(seeds.lookup(seeds.crosswalk_b, "cat", "leaf_b"), "cat", "left")
    return out.select(*shared.columns, F.coalesce("_sub", "_pri").alias("leaf_a"), "leaf_b")


def agreement_summary(agreed: DataFrame, coarse: list[str]) -> DataFrame:
    """Merchants and volume that agree; of those that do not, how many involve a coarse leaf and how many are genuine."""
    same, differ = F.col("leaf_a") == F.col("leaf_b"), F.col("leaf_a") != F.col("leaf_b")
    either = F.col("leaf_a").isin(coarse) | F.col("leaf_b").isin(coarse)
    return agreed.agg(
        F.count("*").alias("merchants"),
        F.sum("volume_b").alias("volume"),
        F.count_if(same).alias("agree"),
        F.coalesce(F.sum(F.when(same, F.col("volume_b"))), F.lit(0)).alias("agree_volume"),
        F.count_if(differ & either).alias("coarse"),
        F.count_if(differ & ~either).alias("genuine"),
    )


def top_conflicts(agreed: DataFrame, k: int) -> DataFrame:
    return agreed.where("leaf_a <> leaf_b").orderBy(F.col("volume_b").desc(), "m").limit(k).select("m", "leaf_a", "leaf_b", "volume_b")


def category_bridge(shared: DataFrame) -> DataFrame:
    """Each category of one feed with the other feed's modal category, its share and the number of categories met."""
    counts = shared.where("pair is not null").groupBy("pair", "cat").agg(F.count("*").alias("n"))
    order, whole = Window.partitionBy("pair").orderBy(F.col("n").desc(), "cat"), Window.partitionBy("pair")
    out = counts.withColumns({"_rn": F.row_number().over(order), "pct": F.round(100 * F.col("n") / F.sum("n").over(whole), 2), "kinds": F.count("*").over(whole)})
    return out.where("_rn = 1").select("pair", "cat", "n", "pct", "kinds")


def ground_truth(agreed: DataFrame, mechanisms: list[str]) -> DataFrame:
    """Shared merchants whose primary is no mechanism and whose leaf is resolved."""
    pri, _ = split_pair(F.col("pair"))
    return agreed.where(~pri.isin(mechanisms) & F.col("leaf_a").isNotNull())


def ground_truth_counts(agreed: DataFrame, mechanisms: list[str]) -> DataFrame:
    """How many shared merchants each exclusion takes."""
    pri, _ = split_pair(F.col("pair"))
    by_mechanism = pri.isin(mechanisms)
    none = F.col("leaf_a").isNull()
    return agreed.agg(F.count("*").alias("shared"), F.count_if(by_mechanism).alias("mechanism"), F.count_if(~by_mechanism & none).alias("unresolved"), F.count_if(~by_mechanism & ~none).alias("kept"))


def per_applicant(df: DataFrame) -> DataFrame:
    """Applicants, and the mean, greatest, least, median and high percentiles of their numbers of transactions.

    The percentiles are over counts of counts, a table of as many rows as there are different numbers.
    """
    each = df.groupBy("applicant").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    marks = F.percentile("n", [0.5, 0.9, 0.95, 0.99], F.col("k"))
    out = each.agg(F.sum("k").alias("applicants"), F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k"), 4).alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"), marks.alias("_p"))
    return out.select("applicants", "mean", "most", "least", *[F.round(F.col("_p")[i], 4).alias(c) for i, c in enumerate(("median", "p90", "p95", "p99"))])


def source_match(feed: DataFrame, predicates: DataFrame, compounds: DataFrame | None = None) -> DataFrame:
    """Transactions of each parsed source, by one equi join: on sub, on primary category, and for compound sources on both.

    A compound source (``leaf, pri, subs``) may leave either side out, which then is any; its value is ``pri + sub``.
    The feed is read once: each row asks by its sub, by its primary category and by both.
    """
    kind, value, none = F.col("kind"), F.col("value"), F.lit("")
    sources = predicates.where(kind.isin("sub", "pri")).select("value", "leaf", kind.alias("_kind"), F.when(kind == "pri", value).otherwise(none).alias("_p"), F.when(kind == "sub", value).otherwise(none).alias("_s"))
    if compounds is not None:
        each = compounds.select("leaf", F.col("pri").alias("_p"), F.explode_outer(F.array_distinct("subs")).alias("_s")).distinct().where("_p is not null or _s is not null")
        which = F.when(F.col("_s").isNull(), "pri").when(F.col("_p").isNull(), "sub").otherwise("both")
        sources = sources.unionByName(each.select(F.concat_ws(" + ", "_p", "_s").alias("value"), "leaf", which.alias("_kind"), F.coalesce("_p", none).alias("_p"), F.coalesce("_s", none).alias("_s")))
    asks = [F.struct(F.lit(k).alias("kind"), p.alias("p"), s.alias("s")) for k, p, s in (("sub", none, F.col("sub")), ("pri", F.col("pri"), none), ("both", F.col("pri"), F.col("sub")))]
    asked = feed.select("*", F.explode(F.array(*asks)).alias("_ask"))
    hit = (F.col("_ask.kind") == F.col("_kind")) & (F.col("_ask.p") == F.col("_p")) & (F.col("_ask.s") == F.col("_s"))
    return asked.join(sources, hit).drop("_ask", "_kind", "_p", "_s")


def label_rows(df: DataFrame, labels: DataFrame, key: str = "merchant", label: str = "leaf") -> DataFrame:
    """Transactions with the label of their key; those without one are left out."""
    return df.join(labels.where(F.col(label).isNotNull()).select(key, label), key)


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The row of ``first`` for a key if there is one with a category, else that of ``second``; keys of neither are absent."""
    return first.where("category is not null").withColumn("provider", F.lit("B")).unionByName(second.join(first.select(key), key, "left_anti").withColumn("provider", F.lit("A")))
