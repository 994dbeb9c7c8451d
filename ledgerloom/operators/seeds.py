"""Taxonomy, crosswalk and rule seeds as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_taxonomy(leaves: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each leaf with its general category's defaults where it has no value of its own; absent flags become false, none or blank."""
    d = defaults.select("general", *[F.col(c).alias(f"d_{c}") for c in defaults.columns if c != "general"])
    last = {"necessity": "none", "flow": "none", "is_debt": "false", "is_priority": "false", "is_age": "false", "risk": ""}
    out = leaves.join(d, "general", "left")
    return out.withColumns({c: F.coalesce(c, f"d_{c}", F.lit(v)) for c, v in last.items()}).drop(*[f"d_{c}" for c in last])


def _entries(taxonomy: DataFrame, col: str) -> DataFrame:
    return taxonomy.select("leaf", F.explode(F.split(col, ";")).alias("entry")).withColumn("entry", F.trim("entry")).where("entry <> ''")


def parse_sources(taxonomy: DataFrame, col: str = "sources") -> DataFrame:
    """``kind, value, leaf`` of every simple source: ``primary:`` entries (but ``(null)``) are of kind pri, others sub."""
    simple = _entries(taxonomy, col).where(~F.col("entry").contains("+") & ~F.col("entry").contains("|"))
    kind = F.when(F.col("entry").startswith("primary:"), "pri").otherwise("sub")
    out = simple.select(kind.alias("kind"), F.trim(F.regexp_replace("entry", "^primary:", "")).alias("value"), "leaf")
    return out.where("value <> '(null)'")


def parse_compound(taxonomy: DataFrame, col: str = "sources") -> DataFrame:
    """``leaf, pri, subs`` of sources such as ``primary:X + sub:A|B``; either side may be absent (any)."""
    entry = _entries(taxonomy, col).where(F.col("entry").contains("+") | F.col("entry").contains("|"))
    pri = F.nullif(F.trim(F.regexp_extract("entry", r"primary:([^+]*)", 1)), F.lit(""))
    subs = F.nullif(F.trim(F.regexp_extract("entry", r"sub:([^+]*)", 1)), F.lit(""))
    return entry.select("leaf", pri.alias("pri"), F.transform(F.split(subs, r"\|"), F.trim).alias("subs"))


@dataclass(frozen=True)
class Rule:
    """One deterministic rule; all kinds but ``regex`` search their words anywhere between word edges; case is ignored."""

    rule_id: str
    priority: int
    field: str
    kind: str
    pattern: str
    leaf: str
    direction: str = "any"
    enabled: bool = True
    exclude: str = ""


def active_rules(rules: list[Rule]) -> list[Rule]:
    """Enabled rules by priority, then id."""
    return sorted((r for r in rules if r.enabled), key=lambda r: (r.priority, r.rule_id))


def exact_set_match(c: Column, words: str) -> Column:
    return c.rlike(rf"(?i)\b({words})\b")


def rule_matches(rule: Rule, merchant: Column, description: Column, direction: Column) -> Column:
    """Whether a rule fires; a null field never matches."""
    field = merchant if rule.field == "merchant" else description
    hit = field.rlike(f"(?i){rule.pattern}") if rule.kind == "regex" else exact_set_match(field, rule.pattern)
    if rule.exclude:
        hit = hit & ~field.rlike(f"(?i){rule.exclude}")
    if rule.direction != "any":
        hit = hit & (direction == rule.direction)
    return F.coalesce(hit, F.lit(False))


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Rows of ``child`` whose key ``parent`` lacks."""
    return child.join(parent.select(on).distinct(), on, "left_anti")
