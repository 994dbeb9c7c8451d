"""Merchant normalisation: overlap, drift and fuzzy matches to canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct keys of both sides and of their intersection."""
    n = lambda df, c: df.distinct().agg(F.count("*").alias(c))
    return n(a, "left_keys").crossJoin(n(b, "right_keys")).crossJoin(n(a.intersect(b), "common"))


def drift(resolved: DataFrame, period: str) -> DataFrame:
    """Rows, share that fell through to the residual and share that the dictionary knew, by period."""
    return resolved.groupBy(F.date_trunc(period, "ts").alias("period")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("resolution_tier") == "T7_unclassified").cast("int")), 6).alias("fall_through"), F.round(F.avg((F.col("resolution_tier") == "T4_merchant_dictionary").cast("int")), 6).alias("dictionary")
    )


def new_values(feed: DataFrame, col: str, ts: str, since: str) -> DataFrame:
    """Values seen from ``since`` on and never before."""
    late, early = feed.where(F.col(ts) >= since), feed.where(F.col(ts) < since)
    return late.select(col).distinct().join(early.select(col).distinct(), col, "left_anti")


#: Letters of a name for each edit that it may have, so that short names do not match all names of their length.
LETTERS = 3


def _allowed(n: Column, edits: int) -> Column:
    """Edits within which a canonical name of a length may be matched."""
    return F.least(F.lit(edits), F.floor(n / LETTERS)).cast("int")


def _start(length: Column, i: Column, parts: Column) -> Column:
    """First character (from 1) of the i-th of ``parts`` even segments of a text of the length; the last ones are longer."""
    short, longer = F.floor(length / parts), length % parts
    return ((i - 1) * short + F.greatest(F.lit(0), i - 1 - (parts - longer)) + 1).cast("int")


def _segments(name: Column, edits: int) -> Column:
    """(length, number, text) of the even segments of a name, one more than the edits that it may have."""
    n = F.length(name)
    parts = _allowed(n, edits) + 1
    one = lambda i: F.struct(n.alias("n"), i.alias("i"), name.substr(_start(n, i, parts), _start(n, i + 1, parts) - _start(n, i, parts)).alias("s"))
    return F.transform(F.sequence(F.lit(1), parts), one)


def _probes(name: Column, edits: int) -> Column:
    """(length, number, text) of the parts of a name that a segment of a name within so many edits may equal.

    If two names are within the edits, one segment of the one stands whole in the other, at a place that the edits before
    it and after it allow.
    """
    m = F.length(name)

    def of(n: Column, i: Column) -> Column:
        parts = _allowed(n, edits) + 1
        start, length, more = _start(n, i, parts), _start(n, i + 1, parts) - _start(n, i, parts), m - n
        low = F.greatest(F.lit(1), start + F.greatest(1 - i, more - (parts - i)))
        high = F.least(m - length + 1, start + F.least(i - 1, more + (parts - i)))
        found = F.transform(F.sequence(low, high), lambda p: F.struct(n.alias("n"), i.alias("i"), name.substr(p, length).alias("s")))
        return F.when((low <= high) & (F.abs(m - n) < parts), found).otherwise(F.expr("cast(array() as array<struct<n: int, i: int, s: string>>)"))

    lengths = F.sequence(F.greatest(F.lit(0), m - edits), m + edits)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(F.sequence(F.lit(1), _allowed(n, edits) + 1), lambda i: of(n, i))))))


def fuzzy_match(raw: DataFrame, canonical: DataFrame, edits: int = 4) -> DataFrame:
    """``raw, canonical, edits``: the nearest canonical name of each raw one; ties go to the lesser name.

    A canonical name is matched within ``edits``, and within one edit for each LETTERS letters that it has.  Candidates share a segment of the canonical name at a fitting place, so none is missed; the edit distance decides.
    """
    names = lambda df, out: df.select(F.col(df.columns[0]).alias(out)).where(F.col(out).isNotNull()).distinct()
    left = names(raw, "raw").select("raw", F.explode(_probes(F.col("raw"), edits)).alias("k"))
    right = names(canonical, "canonical").select("canonical", F.explode(_segments(F.col("canonical"), edits)).alias("k"))
    pairs = left.join(right, "k").select("raw", "canonical").distinct()
    pairs = pairs.withColumn("edits", F.levenshtein("raw", "canonical")).where(F.col("edits") <= _allowed(F.length("canonical"), edits))
    return pairs.groupBy("raw").agg(F.min(F.struct("edits", "canonical")).alias("m")).select("raw", "m.canonical", "m.edits")


def _grams(names: DataFrame, name: str, n: int) -> DataFrame:
    """``name, g, k``: distinct n-grams of a padded name and how often each stands in it."""
    text = F.concat(F.lit(" "), F.col(name), F.lit(" "))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
    return names.select(name, F.explode(F.transform(places, lambda i: F.substring(text, i, F.lit(n)))).alias("g")).groupBy(name, "g").agg(F.count("*").alias("k"))


def similar_names(raw: DataFrame, canonical: DataFrame, least: float = 0.6, n: int = 3) -> DataFrame:
    """``raw, canonical, similarity``: the canonical name of greatest cosine of weighted n-grams, ``least`` or more.

    An n-gram weighs by how often it stands in the name and by how few names of both sides have it.  The n-grams of each
    name are put in order of rarity; two names of that cosine always share one of the first of both, up to where the rest
    of the vector is shorter than ``least``.  So candidates meet over their rare n-grams, none is missed, and names made of
    frequent ones alone are compared with names of that kind only.  Ties go to the lesser name.
    """
    names = lambda df, out: df.select(F.col(df.columns[0]).alias(out)).where(F.col(out).isNotNull()).distinct()
    left, right = _grams(names(raw, "raw"), "raw", n), _grams(names(canonical, "canonical"), "canonical", n)
    counts = left.select("g").unionAll(right.select("g")).groupBy("g").agg(F.count("*").alias("df"))
    whole = counts.agg(F.sum("df").alias("all"))
    counts = counts.crossJoin(F.broadcast(whole)).select("g", "df", F.log(1 + F.col("all") / F.col("df")).alias("idf"))  # one row

    def vectors(grams: DataFrame, name: str) -> DataFrame:
        entry = F.struct("df", "g", (F.col("k") * F.col("idf")).alias("w"))
        own = grams.join(counts, "g").groupBy(name).agg(F.array_sort(F.collect_list(entry)).alias("v"))
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
        own = own.withColumn("size", size).withColumn("v", F.transform("v", lambda x: F.struct(x["g"].alias("g"), (x["w"] / F.col("size")).alias("w"))))
        # A rest of exactly the bound stays out of the first part only by rounding; a little more is kept.
        rest = lambda i: F.aggregate(F.slice("v", i + 1, F.size("v")), F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
        first = F.filter(F.transform("v", lambda x, i: F.when(rest(i) >= least * least - 1e-9, x["g"])), lambda g: g.isNotNull())
        return own.select(name, F.map_from_entries("v").alias(f"{name}_v"), F.explode(first).alias("g"))

    x, y = vectors(left, "raw"), vectors(right, "canonical")
    pairs = x.join(y, "g").drop("g").dropDuplicates(["raw", "canonical"])
    dot = F.aggregate(F.map_entries("raw_v"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("canonical_v", e["key"]), F.lit(0.0)))
    found = pairs.select("raw", "canonical", F.round(dot, 6).alias("similarity")).where(F.col("similarity") >= least)
    best = found.groupBy("raw").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "canonical")).alias("m"))
    return best.select("raw", "m.canonical", (-F.col("m.s")).alias("similarity"))
