"""Queries of samples, splits and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import consensus as C
from ledgerloom.operators import evaluation as V
from ledgerloom.operators import sampling as G
from ledgerloom.operators import waterfall as W
from ledgerloom.plans.feeds import CAT_B, EVAL_B, MAPS, NATIVE_A, NATIVE_B, STRIP, _MA, _S, a, b, sourced
from ledgerloom.plans.labels import ALIGNED, BROKEN, GATED, aligned, broken
from ledgerloom.plans.registry import query
from ledgerloom.sources import feeds, tables

_draw = lambda seed, key: f"md5('{seed}' || {key})"


@query("w3_g2_cap_per_group", f"""
SELECT merchant, volume FROM (SELECT *, row_number() OVER (PARTITION BY substr(merchant, 1, 5) ORDER BY {_draw(42, 'merchant')}, merchant) AS rn
FROM strings) x WHERE rn <= 4
""")
def w3(fx):
    return G.cap_per_group(fx.strings.withColumn("g", F.substring("merchant", 1, 5)), "g", 4, 42, "merchant").drop("g")


@query("w4_one_per_key", f"""
SELECT merchant, row_no, gold_leaf FROM (SELECT *, row_number() OVER (PARTITION BY merchant
ORDER BY {_draw(7, 'CAST(row_no AS VARCHAR)')}, row_no) AS rn FROM gold_rows) x WHERE rn = 1
""")
def w4(fx):
    return G.one_per_key(fx.gold_rows, "merchant", 7, "row_no").select("merchant", "row_no", "gold_leaf")


@query("k3_random_n", f"SELECT merchant, volume FROM strings ORDER BY {_draw(1, 'merchant')}, merchant LIMIT 30")
def k3(fx):
    return G.random_n(fx.strings, 30, 1, "merchant")


@query("g2_stratified_sample", f"""
SELECT merchant, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_draw(5, 'merchant')}, merchant) AS rn FROM gold) x
WHERE rn <= 15 ORDER BY {_draw(6, 'merchant')}, merchant LIMIT 25
""")
def g2(fx):
    return G.stratified_sample(fx.gold, "stratum", 15, 25, 5, "merchant").select("merchant", "stratum")


@query("g3_cap_then_trim", """
SELECT merchant, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum
ORDER BY merchant) AS rn, min(merchant) OVER (PARTITION BY stratum) AS first FROM gold) x WHERE rn <= 20 ORDER BY first, merchant LIMIT 45
""")
def g3(fx):
    return G.cap_then_trim(fx.gold, "stratum", 20, 45, "merchant").select("merchant", "stratum")


_S1, _S2 = "SELECT merchant, volume, 'person' AS stratum FROM strings WHERE merchant LIKE 'mr %' ORDER BY " + _draw(9, "merchant") + ", merchant LIMIT 10", "SELECT merchant, volume, 'large' AS stratum FROM strings WHERE volume > 20 AND merchant NOT IN (SELECT merchant FROM one) ORDER BY " + _draw(10, "merchant") + ", merchant LIMIT 20"
_S3 = """
SELECT merchant, volume, 'any' AS stratum FROM strings WHERE merchant NOT IN (SELECT merchant FROM one) AND merchant NOT IN (SELECT merchant FROM two)
ORDER BY 
""" + _draw(11, "merchant") + ", merchant LIMIT 30"


@query("g4_claim_strata", "SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three", one=_S1, two=_S2, three=_S3)
def g4(fx):
    c = F.col
    return G.claim_strata(fx.strings, [("person", c("merchant").startswith("mr "), 10), ("large", c("volume") > 20, 20), ("any", F.lit(True), 30)], 9, "merchant")


@query("g5_weighted_sample", f"""
SELECT merchant, volume FROM strings ORDER BY -ln((CAST(('0x' || substr({_draw(3, 'merchant')}, 1,
12)) AS BIGINT) + 0.5) / 281474976710656.0) / volume, merchant LIMIT 40
""")
def g5(fx):
    return G.weighted_sample(fx.strings, "volume", 40, 3, "merchant")


MATCHED = "SELECT DISTINCT merchant, gold_leaf AS leaf FROM gold_rows"
_CAPPED = f"""
SELECT merchant, leaf FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY {_draw(21, 'merchant')}, merchant) AS rn FROM matched) x
WHERE rn <= 5
"""
_TARGET = "SELECT merchant, min(leaf) AS leaf FROM capped GROUP BY 1"


@query("g6_targeted_sample", "SELECT * FROM target", matched=MATCHED, capped=_CAPPED, target=_TARGET)
def g6(fx):
    return G.targeted_sample(fx.gold_rows.select("merchant", F.col("gold_leaf").alias("leaf")).distinct(), 5, 21, "merchant")


@query(
    "g7_gap_fill",
    "SELECT merchant, min(leaf) AS leaf FROM capped2 GROUP BY 1",
    matched=MATCHED,
    capped=_CAPPED,
    target=_TARGET,
    capped2=f"""
SELECT merchant, leaf FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY {_draw(22, 'merchant')}, merchant) AS rn FROM matched
WHERE merchant NOT IN (SELECT merchant FROM target)) x WHERE rn <= 5
""",
)
def g7(fx):
    matched = fx.gold_rows.select("merchant", F.col("gold_leaf").alias("leaf")).distinct()
    return G.gap_fill(matched, 5, 22, "merchant", G.targeted_sample(matched, 5, 21, "merchant"))


_FROM_SOURCES = f"""
SELECT merchant, leaf
FROM (
  SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY {_draw(23, 'merchant')}, merchant) AS rn
  FROM (SELECT DISTINCT {_MA} AS merchant, leaf FROM sourced WHERE vendor IS NOT NULL AND trim(vendor) <> '') d
  WHERE merchant NOT IN (SELECT merchant FROM gold)
) x WHERE rn <= 5
"""


@query("g6_from_sources", "SELECT merchant, min(leaf) AS leaf FROM capped GROUP BY 1", **_S, capped=_FROM_SOURCES)
def g6s(fx):
    """Merchants for leaves from their own provider categories, compound ones included, without those of the gold set."""
    rows = feeds.has_merchant(sourced(fx), "vendor").select(S.norm_merchant(F.col("vendor")).alias("merchant"), "leaf").distinct()
    return G.gap_fill(rows, 5, 23, "merchant", fx.gold)


@query("g8_split_quota", f"""
SELECT * FROM (SELECT 'A' AS provider, merchant FROM dictionary GROUP BY 2 ORDER BY {_draw(2, 'merchant')}, merchant LIMIT 18) x UNION ALL SELECT *
FROM (SELECT 'B', merchant FROM strings ORDER BY {_draw(2, 'merchant')}, merchant LIMIT 12) y
""")
def g8(fx):
    one, two = G.split_quota(30, 0.6)
    first = G.random_n(fx.dictionary.select("merchant").distinct(), one, 2, "merchant")
    return first.select(F.lit("A").alias("provider"), "merchant").union(G.random_n(fx.strings, two, 2, "merchant").select(F.lit("B"), "merchant"))


@query("g9_merchant_split", f"""
SELECT merchant, row_no, CASE WHEN merchant IN (SELECT merchant FROM (SELECT DISTINCT merchant FROM gold_rows) k
ORDER BY {_draw(42, 'merchant')}, merchant LIMIT (SELECT greatest(1, CAST(floor(count(DISTINCT merchant) * 0.15) AS BIGINT))
FROM gold_rows)) THEN 'validation' ELSE 'train' END AS split FROM gold_rows
""")
def g9(fx):
    return G.merchant_split(fx.gold_rows, "merchant", 0.15, 42).select("merchant", "row_no", "split")


_CALM = "SELECT merchant, count(DISTINCT gold_leaf) > 1 AS conflicting FROM gold_rows GROUP BY 1"
_HELD = f"""
SELECT merchant FROM calm WHERE NOT conflicting ORDER BY {_draw(8, 'merchant')}, merchant LIMIT (SELECT greatest(1,
CAST(floor(count(*) * 0.4) AS BIGINT)) FROM calm WHERE NOT conflicting)
"""


@query("g10_g15_holdout_manifest", """
SELECT DISTINCT g.merchant, conflicting, CASE WHEN g.merchant IN (SELECT merchant FROM held) THEN 'holdout' ELSE 'train' END AS split FROM gold_rows g
JOIN calm USING (merchant)
""", calm=_CALM, held=_HELD)
def g10(fx):
    return G.holdout(fx.gold_rows, "merchant", "gold_leaf", 0.4, 8).select("merchant", "conflicting", "split").distinct()


@query("g11_oversample", "SELECT g.merchant, row_no, copy FROM gold_rows g JOIN calm USING (merchant) JOIN (SELECT unnest([1, 2, 3]) AS copy) c ON copy = 1 OR conflicting", calm=_CALM)
def g11(fx):
    return G.oversample(G.holdout(fx.gold_rows, "merchant", "gold_leaf", 0.4, 8), "conflicting", 3).select("merchant", "row_no", "copy")


@query("g12_supersede", """
SELECT merchant, gold_leaf AS leaf FROM gold UNION ALL SELECT merchant, llm_leaf FROM labels_b
WHERE llm_leaf <> '' AND merchant NOT IN (SELECT merchant FROM gold)
""")
def g12(fx):
    return G.supersede(fx.labels_b.where("llm_leaf <> ''").select("merchant", F.col("llm_leaf").alias("leaf")), fx.gold.select("merchant", F.col("gold_leaf").alias("leaf")), "merchant")


@query("g13_map_abstain", "SELECT merchant, CASE WHEN starts_with(tier, 'abstain') THEN 'unclassified_other' ELSE coalesce(final_leaf, '') END AS leaf FROM broken", aligned=ALIGNED, gated=GATED, broken=BROKEN)
def g13(fx):
    return G.map_abstain(broken(fx).select("merchant", "tier", F.coalesce("final_leaf", F.lit("")).alias("leaf"))).drop("tier")


@query("g14_cap_rows", f"SELECT merchant, row_no FROM gold_rows ORDER BY md5('4' || merchant || CAST(row_no AS VARCHAR)), merchant, row_no LIMIT 500")
def g14(fx):
    return G.random_n(fx.gold_rows, 500, 4, "merchant", "row_no").select("merchant", "row_no")


@query("g16_auto_resolve", """
SELECT s.merchant, e.leaf AS known_leaf, CASE WHEN e.leaf IS NULL THEN 'review' ELSE 'established' END AS provenance FROM strings s LEFT
JOIN (SELECT merchant, min(gold_leaf) AS leaf FROM gold_rows GROUP BY 1 HAVING count(DISTINCT gold_leaf) = 1) e USING (merchant)
""")
def g16(fx):
    truth = fx.gold_rows.groupBy("merchant").agg(F.countDistinct("gold_leaf").alias("n"), F.min("gold_leaf").alias("leaf")).where("n = 1")
    return G.auto_resolve(fx.strings, truth, "merchant").select("merchant", "known_leaf", "provenance")


_KEY = "CAST(l_orderkey AS VARCHAR) || CAST(l_linenumber AS VARCHAR)"


@query("g1_percent_sample", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (CAST(('0x' || substr({_draw(42, _KEY)}, 1,
12)) AS BIGINT) + 0.5) / 281474976710656.0 < 0.05
""")
def g1(fx):
    return G.percent_sample(fx.lineitem, 5, 42, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey")


@query("w7_stable_ids", "SELECT merchant, 100 + row_number() OVER (ORDER BY volume DESC, merchant) AS row_id FROM strings")
def w7(fx):
    return tables.stable_ids(fx.strings, [F.col("volume").desc(), F.col("merchant")], 100).select("merchant", "row_id")


@query("a12_thin_classes", """
SELECT leaf, coalesce(c, 0) AS n FROM leaf_numbers LEFT JOIN (SELECT gold_leaf AS leaf, count(*) AS c FROM gold GROUP BY 1) g USING (leaf)
WHERE coalesce(c, 0) < 17
""")
def a12(fx):
    return G.thin_classes(fx.leaf_numbers.select("leaf"), fx.gold.select(F.col("gold_leaf").alias("leaf")), 17)


@query("a13_class_profile", """
SELECT leaf, coalesce(c, 0) AS n, round(100.0 * coalesce(c, 0) / (SELECT count(*) FROM gold_rows), 4) AS pct FROM leaf_numbers LEFT
JOIN (SELECT gold_leaf AS leaf, count(*) AS c FROM gold_rows GROUP BY 1) g USING (leaf)
""")
def a13(fx):
    return G.class_profile(fx.leaf_numbers.select("leaf"), fx.gold_rows.select(F.col("gold_leaf").alias("leaf")))


# Gold merchants with the consensus leaf, the second labeller's confidence and general categories.
SCORED = f"""
SELECT g.merchant, g.gold_leaf, g.gold_source, g.stratum, g.volume, CASE WHEN coalesce(leaf_a, '') <> '' AND leaf_a = leaf_b THEN leaf_a
WHEN coalesce(leaf_b, '') <> '' AND conf_b >= 0.7 THEN leaf_b END AS pred, leaf_c AS other, conf_b, tg.general AS gold_general FROM gold g
JOIN ({ALIGNED}) al ON g.merchant = al.merchant LEFT JOIN taxonomy tg ON g.gold_leaf = tg.leaf
"""
SCORED2 = "SELECT s.*, tp.general AS pred_general FROM scored s LEFT JOIN taxonomy tp ON s.pred = tp.leaf"
_E = {"scored": SCORED, "sc": SCORED2}
_ACC = "count(*) AS n, round(avg(CASE WHEN pred = gold_leaf THEN 1.0 ELSE 0.0 END), 6) AS leaf_accuracy, round(avg(CASE WHEN pred_general IS NOT DISTINCT FROM gold_general THEN 1.0 ELSE 0.0 END), 6) AS general_accuracy"


def scored(fx):
    rows = C.consensus_or_confident(aligned(fx)).select("merchant", F.col("chosen").alias("pred"), F.col("leaf_c").alias("other"), "conf_b")
    return V.with_generals(fx.gold.join(rows, "merchant"), fx.taxonomy, "pred", "gold_leaf")


@query("e1_e2_accuracy", f"SELECT {_ACC} FROM sc WHERE coalesce(pred, '') <> ''", **_E)
def e1(fx):
    return V.accuracy(scored(fx), "pred", "gold_leaf")


@query("e2_unknown_unequal", f"""
SELECT count(*) AS n, round(avg(CASE WHEN pred = gold_leaf THEN 1.0 ELSE 0.0 END), 6) AS leaf_accuracy, round(avg(CASE
WHEN pred_general = gold_general THEN 1.0 ELSE 0.0 END), 6) AS general_accuracy FROM sc WHERE coalesce(pred, '') <> ''
""", **_E)
def e2(fx):
    return V.accuracy(scored(fx), "pred", "gold_leaf", False)


@query("e3_volume_accuracy", """
SELECT round(sum(CASE WHEN pred = gold_leaf THEN volume ELSE 0 END) / sum(volume), 6) AS leaf_accuracy, round(sum(CASE
WHEN pred_general IS NOT DISTINCT FROM gold_general THEN volume ELSE 0 END) / sum(volume), 6) AS general_accuracy FROM sc
WHERE coalesce(pred, '') <> ''
""", **_E)
def e3(fx):
    return V.volume_accuracy(scored(fx), "pred", "gold_leaf", "volume")


@query("e4_e5_accepted_accuracy", """
SELECT count(*) AS n, round(avg(CASE WHEN pred = gold_leaf OR (coalesce(other, '') <> '' AND pred = other) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM sc WHERE coalesce(pred, '') <> ''
""", **_E)
def e4(fx):
    return V.accepted_accuracy(scored(fx), "pred", "gold_leaf", "other")


@query("e6_accuracy_by", f"SELECT stratum AS grp, {_ACC} FROM sc WHERE coalesce(pred, '') <> '' GROUP BY 1 UNION ALL SELECT 'ALL', {_ACC} FROM sc WHERE coalesce(pred, '') <> ''", **_E)
def e6(fx):
    return V.accuracy_by(scored(fx), "pred", "gold_leaf", "stratum")


@query("e7_error_profile", """
SELECT count(*) AS n, round(avg(CASE WHEN coalesce(pred, '') IN ('', 'unclassified_other') THEN 1.0 ELSE 0.0 END), 6) AS abstained, round(avg(CASE
WHEN coalesce(pred <> gold_leaf, true) AND pred_general = gold_general THEN 1.0 ELSE 0.0 END), 6) AS near_miss, round(avg(CASE
WHEN coalesce(pred <> gold_leaf, true) AND pred = other THEN 1.0 ELSE 0.0 END), 6) AS rescued FROM sc
""", **_E)
def e7(fx):
    return V.error_profile(scored(fx), "pred", "gold_leaf", "other")


@query("e8_calibration", """
SELECT CASE WHEN conf_b >= 0.9 THEN '0.9-1.0' WHEN conf_b >= 0.7 THEN '0.7-0.9' WHEN conf_b >= 0.5 THEN '0.5-0.7'
ELSE '0.0-0.5' END AS bucket, count(*) AS n, round(avg(CASE WHEN pred = gold_leaf THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM sc
WHERE coalesce(pred, '') <> '' GROUP BY 1
""", **_E)
def e8(fx):
    return V.calibration(scored(fx), "pred", "gold_leaf", S.conf_bucket(F.col("conf_b")))


_CIRC = """
SELECT s.*, coalesce(gold_source IN ('first') OR (gold_source = 'dictionary' AND d.source IS NOT NULL), false) AS circular FROM sc s LEFT
JOIN (SELECT merchant, min(source) AS source FROM dictionary GROUP BY 1) d USING (merchant)
"""


@query("e9_e10_clean_vs_full", f"""
SELECT 'full' AS rows, {_ACC} FROM circ WHERE coalesce(pred, '') <> '' UNION ALL SELECT 'clean', {_ACC} FROM circ
WHERE coalesce(pred, '') <> '' AND NOT circular
""", **_E, circ=_CIRC)
def e9(fx):
    return V.clean_vs_full(V.circular_flags(scored(fx), fx.dictionary, ["first"]), "pred", "gold_leaf")


@query("e12_by_coverage", f"SELECT merchant IN (SELECT merchant FROM dictionary) AS in_dictionary, {_ACC} FROM sc WHERE coalesce(pred, '') <> '' GROUP BY 1", **_E)
def e12(fx):
    return V.by_coverage(scored(fx), fx.dictionary, "pred", "gold_leaf")


@query("j8_gold_with_pred", "SELECT g.merchant, g.gold_leaf, b.llm_leaf AS pred FROM gold g JOIN labels_b b USING (merchant) WHERE b.llm_confidence >= 0.5")
def j8(fx):
    preds = fx.labels_b.where("llm_confidence >= 0.5").select("merchant", F.col("llm_leaf").alias("pred"))
    return V.gold_with_pred(fx.gold, preds).select("merchant", "gold_leaf", "pred")


_ROWS = f"SELECT {STRIP.format('lower(merchant_raw)')} AS merchant, leaf FROM cat_b WHERE merchant_raw IS NOT NULL"
_VOTES = """
SELECT merchant, leaf FROM (SELECT merchant, leaf, row_number() OVER (PARTITION BY merchant ORDER BY count(*) DESC, leaf) AS rn FROM rowed
GROUP BY 1, 2) x WHERE rn = 1
"""
_ALT = "SELECT g.merchant, g.gold_leaf, g.stratum, a.llm_leaf AS alt_leaf FROM gold g LEFT JOIN labels_a a USING (merchant)"
_OK = "v.leaf = g.gold_leaf OR (coalesce(alt_leaf, '') <> '' AND v.leaf = alt_leaf)"
_M8 = {**MAPS, "cat_b": CAT_B, "rowed": _ROWS, "votes": _VOTES, "alts": _ALT}


@query(
    "m8_vote_scoring",
    f"""
SELECT stratum, count(*) AS n, round(avg(CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END), 6) AS leaf_accuracy,
  round(avg(CASE WHEN {_OK} OR tv.general IS NOT DISTINCT FROM tg.general THEN 1.0 ELSE 0.0 END), 6) AS general_accuracy
FROM alts g JOIN votes v USING (merchant) LEFT JOIN taxonomy tv ON v.leaf = tv.leaf LEFT JOIN taxonomy tg ON g.gold_leaf = tg.leaf GROUP BY 1
""",
    **_M8,
)
def m8(fx):
    """Predictions of transactions voted by merchant and held against gold merchants, by stratum."""
    rows = W.categorise_b(b(fx), fx.seeds()).withColumn("merchant", S.norm_merchant(F.col("merchant_raw"))).where("merchant is not null").withColumn("confidence", F.lit(1.0))
    gold = fx.gold.join(fx.labels_a.select("merchant", F.col("llm_leaf").alias("alt_leaf")), "merchant", "left").select("merchant", "gold_leaf", "stratum", "alt_leaf")
    return V.score_votes(V.modal_vote(rows, "merchant", "leaf", "confidence"), gold, fx.taxonomy, "stratum")


# Transactions of merchants with a gold leaf, scored in evaluation order against the feed's own category.
_GB = """
SELECT e.leaf AS ours, e.resolution_tier, n.native_leaf AS native, g.gold_leaf, g.merchant
FROM (SELECT *, row_number() OVER (PARTITION BY cat, merchant_raw, description_raw, direction, amount, ts, applicant) AS k FROM ev) e
JOIN (SELECT *, row_number() OVER (PARTITION BY cat, merchant_raw, description_raw, direction, amount, ts, applicant) AS k
FROM nat) n ON e.merchant_raw = n.merchant_raw AND e.cat = n.cat AND e.description_raw = n.description_raw AND e.direction = n.direction AND e.amount = n.amount AND e.ts = n.ts AND e.applicant = n.applicant AND e.k = n.k
JOIN gold g ON lower(trim(e.merchant_raw)) = g.merchant
"""
_EB = {**MAPS, "ev": EVAL_B, "nat": NATIVE_B, "gb": _GB}


def gold_b(fx):
    rows = W.categorise_b(b(fx), fx.seeds(), order="evaluation").withColumnRenamed("leaf", "ours")
    rows = W.native_b(rows, fx.seeds()).withColumnsRenamed({"native_leaf": "native"})
    return rows.withColumn("merchant", S.norm_merchant(F.col("merchant_raw"))).join(fx.gold.select("merchant", "gold_leaf"), "merchant")


@query("e13_tier_breakdown", "SELECT resolution_tier, count(*) AS n FROM gb GROUP BY 1", **_EB)
def e13(fx):
    return gold_b(fx).groupBy("resolution_tier").agg(F.count("*").alias("n"))


@query("e14_wins", """
SELECT count(*) AS n, count(*) FILTER (ours = gold_leaf AND coalesce(native <> gold_leaf, true)) AS wins, count(*) FILTER (coalesce(ours <> gold_leaf,
true) AND native = gold_leaf) AS losses FROM gb
""", **_EB)
def e14(fx):
    return V.wins(gold_b(fx), "ours", "native", "gold_leaf")


@query("e16_score_transactions", """
SELECT count(*) AS n, round(avg(CASE WHEN ours = gold_leaf THEN 1.0 ELSE 0.0 END), 6) AS leaf_accuracy, round(avg(CASE WHEN a.general IS NOT DISTINCT
FROM g.general THEN 1.0 ELSE 0.0 END), 6) AS general_accuracy FROM gb LEFT JOIN taxonomy a ON ours = a.leaf LEFT JOIN taxonomy g ON gold_leaf = g.leaf
""", **_EB)
def e16(fx):
    return V.accuracy(V.with_generals(gold_b(fx), fx.taxonomy, "ours", "gold_leaf"), "ours", "gold_leaf")


@query("e15_three_way", """
SELECT s.merchant, s.gold_leaf, s.pred, m.native_leaf AS native_b FROM scored s LEFT JOIN (SELECT m, native_leaf
FROM (SELECT lower(trim(merchant_raw)) AS m, native_leaf, row_number() OVER (PARTITION BY lower(trim(merchant_raw))
ORDER BY count(*) DESC, native_leaf) AS rn FROM nat WHERE merchant_raw IS NOT NULL GROUP BY 1, 2) x WHERE rn = 1) m ON s.merchant = m.m
""", **MAPS, **_E, nat=NATIVE_B)
def e15(fx):
    votes = W.native_b(b(fx), fx.seeds()).withColumn("merchant", S.norm_merchant(F.col("merchant_raw"))).where("merchant is not null").withColumn("one", F.lit(1.0))
    native = V.modal_vote(votes, "merchant", "native_leaf", "one").select("merchant", F.col("native_leaf").alias("native_b"))
    return scored(fx).select("merchant", "gold_leaf", "pred").join(native, "merchant", "left")


@query("a10_modal_vote", """
SELECT merchant, leaf, votes, confidence FROM (SELECT merchant, leaf, votes,
round(sum(c) OVER (PARTITION BY merchant) / nullif(sum(k) OVER (PARTITION BY merchant), 0), 6) AS confidence, row_number() OVER (PARTITION BY merchant
ORDER BY votes DESC, leaf) AS rn FROM (SELECT merchant, llm_leaf AS leaf, count(*) AS votes, sum(llm_confidence) AS c, count(llm_confidence) AS k
FROM (SELECT * FROM labels_a UNION ALL SELECT * FROM labels_b UNION ALL SELECT * FROM labels_c) u GROUP BY 1, 2) g) x WHERE rn = 1
""")
def a10(fx):
    rows = fx.labels_a.unionByName(fx.labels_b).unionByName(fx.labels_c).withColumnRenamed("llm_leaf", "leaf")
    return V.modal_vote(rows, "merchant", "leaf", "llm_confidence")


@query("e16_native_from_pair", """
SELECT native_leaf, count(*) AS n FROM (SELECT CASE WHEN sub IS NULL THEN 'unclassified_other' ELSE native_leaf END AS native_leaf FROM nat) x
GROUP BY 1
""", **MAPS, nat=NATIVE_A)
def e16n(fx):
    rows = a(fx).withColumn("native_category", S.native_pair(F.col("pri"), F.col("sub"))).drop("pri", "sub")
    return W.native_from_pair(rows, fx.seeds()).groupBy("native_leaf").agg(F.count("*").alias("n"))
