"""The categorisation waterfall: the first tier that fires gives a transaction its leaf.

Production order is direction, compound, mechanism, dictionary, rules, crosswalk, residual.  Evaluation order puts the
dictionary and the rules before the feed's own category; the two are not the same and both stay.  Lookup tables are
user seeds with one row a key; whether they are broadcast is the planner's choice by their size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import desc_text, norm_merchant, split_pair
from ledgerloom.operators.seeds import Rule, active_rules, parse_sources, rule_matches

RESIDUAL = "unclassified_other"


@dataclass
class Seeds:
    """Everything the waterfall looks up."""

    sources_a: DataFrame
    crosswalk_b: DataFrame
    dictionary: DataFrame
    rules: list[Rule]
    mechanisms: dict[str, str]
    gambling_primary: str = "Gambling and Betting"
    gambling_category: str = "ENTERTAINMENT_CASINOS_AND_GAMBLING"
    council_sub: str = "Council"
    salary_primary: str = "Identified Salary"
    gig_subs: tuple[str, ...] = ("Taxis", "Delivery", "Take Away")
    agency_subs: tuple[str, ...] = ("Recruitment Services", "Employment Agencies")

    def lookup(self, df: DataFrame, key: str, leaf: str) -> DataFrame:
        """A two-column lookup with one row a key."""
        return df.select(F.col(df.columns[0]).alias(key), F.col(df.columns[1]).alias(leaf)).groupBy(key).agg(F.min(leaf).alias(leaf))

    def kind(self, kind: str) -> DataFrame:
        return parse_sources(self.sources_a).where(F.col("kind") == kind).select("value", "leaf")


def _tiers(*tiers: tuple[Column, Column | str, str | Column]) -> Column:
    """One struct (leaf, resolution_tier) from the first tier whose condition holds."""
    out = None
    for condition, leaf, tier in tiers:
        value = F.struct((leaf if isinstance(leaf, Column) else F.lit(leaf)).alias("leaf"), (tier if isinstance(tier, Column) else F.lit(tier)).alias("resolution_tier"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.struct(F.lit(RESIDUAL).alias("leaf"), F.lit("T7_unclassified").alias("resolution_tier")))


def _rule_tiers(seeds: Seeds, merchant: Column, description: Column, label: str) -> list[tuple]:
    return [(rule_matches(r, merchant, description, F.col("direction")), r.leaf, f"{label}{r.rule_id}") for r in active_rules(seeds.rules)]


def _direction_a(s: Seeds) -> list[tuple]:
    credit = F.col("direction") == "credit"
    return [(F.col("pri").startswith(s.gambling_primary) & credit, "gambling_unspecified", "T1_direction"), ((F.col("sub") == s.council_sub) & credit, "salary", "T1_direction")]


def _compound_a(s: Seeds) -> list[tuple]:
    salary = F.col("pri") == s.salary_primary
    return [(salary & F.col("sub").isin(*s.gig_subs), "salary_gig", "T2_compound"), (salary & F.col("sub").isin(*s.agency_subs), "income_agency_work", "T2_compound")]


def _mechanism_a(s: Seeds) -> list[tuple]:
    return [(F.col("pri") == pri, leaf, "T3_mechanism_override") for pri, leaf in s.mechanisms.items()]


def _joined_a(df: DataFrame, s: Seeds, dictionary: bool = True) -> DataFrame:
    df = df.join(s.lookup(s.kind("sub"), "sub", "_sub"), "sub", "left").join(s.lookup(s.kind("pri"), "pri", "_pri"), "pri", "left")
    if dictionary:
        df = df.withColumn("_m", norm_merchant(F.col("vendor"))).join(s.lookup(s.dictionary, "_m", "_dict"), "_m", "left")
    return df


def _crosswalk_a() -> list[tuple]:
    return [(F.col(c).isNotNull(), F.col(c), "T6_provider_crosswalk") for c in ("_sub", "_pri")]


def _finish(df: DataFrame, cols: list[str], hit: Column) -> DataFrame:
    return df.withColumn("_hit", hit).select(*cols, "_hit.leaf", "_hit.resolution_tier")


def categorise_a(df: DataFrame, seeds: Seeds, order: str = "production") -> DataFrame:
    """Leaf and tier of every row of the curated-vendor feed."""
    cols = df.columns
    df = _joined_a(df, seeds)
    merchant, description = norm_merchant(F.col("vendor")), desc_text(F.col("description_raw"))
    known = (F.col("_dict").isNotNull(), F.col("_dict"))
    if order == "production":
        hit = _tiers(*_direction_a(seeds), *_compound_a(seeds), *_mechanism_a(seeds), (*known, "T4_merchant_dictionary"), *_rule_tiers(seeds, merchant, description, "T5_rule_"), *_crosswalk_a())
    else:
        native = [(c, leaf, "T6_native_fallback") for c, leaf, _ in [*_direction_a(seeds), *_compound_a(seeds), *_mechanism_a(seeds), *_crosswalk_a()]]
        hit = _tiers((*known, "T4_dictionary"), *_rule_tiers(seeds, merchant, description, "T5_"), *native, (F.lit(True), RESIDUAL, "T6_native_fallback"))
    return _finish(df, cols, hit)


def categorise_b(df: DataFrame, seeds: Seeds, order: str = "production") -> DataFrame:
    """Leaf and tier of every row of the raw-text feed."""
    cols = df.columns
    df = df.withColumn("_m", norm_merchant(F.col("merchant_raw"))).join(seeds.lookup(seeds.dictionary, "_m", "_dict"), "_m", "left")
    df = df.join(seeds.lookup(seeds.crosswalk_b, "cat", "_cat"), "cat", "left")
    merchant, description = norm_merchant(F.col("merchant_raw")), desc_text(F.col("description_raw"))
    direction = ((F.col("cat") == seeds.gambling_category) & (F.col("direction") == "credit"), "gambling_unspecified")
    known, native = (F.col("_dict").isNotNull(), F.col("_dict")), (F.col("_cat").isNotNull(), F.col("_cat"))
    if order == "production":
        hit = _tiers((*direction, "T1_direction"), (*known, "T4_merchant_dictionary"), *_rule_tiers(seeds, merchant, description, "T5_rule_"), (*native, "T6_provider_crosswalk"))
    else:
        hit = _tiers((*known, "T4_dictionary"), *_rule_tiers(seeds, merchant, description, "T5_"), (*direction, "T6_native_fallback"), (*native, "T6_native_fallback"), (F.lit(True), RESIDUAL, "T6_native_fallback"))
    return _finish(df, cols, hit)


def native_a(df: DataFrame, seeds: Seeds, variant: str = "full") -> DataFrame:
    """The feed's own leaf: ``full`` (direction, compound, mechanism, crosswalk, residual), ``mechanism`` (no direction or
    compound) or ``plain`` (sub, then primary, else null)."""
    cols = df.columns
    df = _joined_a(df, seeds, dictionary=False)
    if variant == "plain":
        return df.select(*cols, F.coalesce("_sub", "_pri").alias("native_leaf"))
    early = [*_direction_a(seeds), *_compound_a(seeds)] if variant == "full" else []
    hit = _tiers(*early, *_mechanism_a(seeds), *_crosswalk_a())
    return df.withColumn("_hit", hit).select(*cols, F.col("_hit.leaf").alias("native_leaf"))


def native_b(df: DataFrame, seeds: Seeds) -> DataFrame:
    """The feed's own leaf: direction, crosswalk, residual."""
    cols = df.columns
    df = df.join(seeds.lookup(seeds.crosswalk_b, "cat", "_cat"), "cat", "left")
    leaf = F.when((F.col("cat") == seeds.gambling_category) & (F.col("direction") == "credit"), "gambling_unspecified").otherwise(F.coalesce("_cat", F.lit(RESIDUAL)))
    return df.select(*cols, leaf.alias("native_leaf"))


def native_from_pair(df: DataFrame, seeds: Seeds, pair: str = "native_category") -> DataFrame:
    """Native leaf of rows that carry ``primary | sub`` in one column; a null pair has neither side."""
    primary, sub = split_pair(F.col(pair))
    return native_a(df.withColumns({"pri": primary, "sub": sub}), seeds)


def attach_metadata(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """General category and flags of each row's leaf, null where the taxonomy lacks it."""
    return df.join(taxonomy.drop("sources", "sources_b"), "leaf", "left")


def tier_report(resolved: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Rows, share of the provider, distinct leaves and rows without metadata for each provider and tier."""
    known = taxonomy.select("leaf", F.lit(1).alias("_known"))
    out = resolved.join(known, "leaf", "left").groupBy("provider", "resolution_tier")
    out = out.agg(F.count("*").alias("n"), F.countDistinct("leaf").alias("distinct_leaves"), F.count_if(F.col("_known").isNull()).alias("leaves_missing_metadata"))
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("provider")), 2)
    return out.withColumn("pct_of_provider", share).orderBy("provider", F.col("n").desc(), "resolution_tier")
