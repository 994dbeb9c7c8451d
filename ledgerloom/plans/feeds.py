"""Queries of feeds, scalar functions, filters, the waterfall and cross-feed analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import crossfeed as X
from ledgerloom.operators import waterfall as W
from ledgerloom.operators.seeds import active_rules, exact_set_match, expand_taxonomy, orphans, parse_compound, parse_sources, rule_matches
from ledgerloom.plans.fixtures import MECHANISMS, RULE_SQL, RULES, rule_case
from ledgerloom.plans.registry import query
from ledgerloom.sources import feeds

FEED_A = """
SELECT PrimaryCategoryDescription AS pri, SubCategoryDescription AS sub, VendorDescription AS vendor, Description AS description_raw, CASE
WHEN TransactionTypeId = 1 THEN 'credit' ELSE 'debit' END AS direction, Amount AS amount, ts, applicant FROM raw_a
"""
FEED_B = """
SELECT credit_category_detailed AS cat, merchant_name AS merchant_raw, coalesce(original_description, transaction_name) AS description_raw, CASE
WHEN amount < 0 THEN 'credit' ELSE 'debit' END AS direction, amount, ts, applicant FROM raw_b
"""
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SOURCES = "SELECT leaf, trim(e) AS entry FROM (SELECT leaf, unnest(string_split({c}, ';')) AS e FROM taxonomy) x WHERE trim(e) <> ''"
SUB_MAP = """
SELECT entry AS value, min(leaf) AS leaf FROM entries WHERE NOT contains(entry, '+') AND NOT contains(entry, '|') AND NOT starts_with(entry,
'primary:') GROUP BY 1
"""
PRI_MAP = """
SELECT trim(replace(entry, 'primary:', '')) AS value, min(leaf) AS leaf FROM entries
WHERE NOT contains(entry, '+') AND NOT contains(entry, '|') AND starts_with(entry, 'primary:') AND entry <> 'primary:(null)' GROUP BY 1
"""
CAT_MAP = "SELECT entry AS value, min(leaf) AS leaf FROM entries_b GROUP BY 1"
DICT = "SELECT merchant AS value, min(leaf) AS leaf FROM dictionary GROUP BY 1"
_T1A = [("starts_with(pri, 'Gambling and Betting') AND direction = 'credit'", "gambling_unspecified"), ("sub = 'Council' AND direction = 'credit'", "salary")]
_T2A = [("pri = 'Identified Salary' AND sub IN ('Taxis', 'Delivery', 'Take Away')", "salary_gig"), ("pri = 'Identified Salary' AND sub IN ('Recruitment Services', 'Employment Agencies')", "income_agency_work")]
_T3A = [(f"pri = '{p}'", leaf) for p, leaf in MECHANISMS.items()]
_when = lambda rows, tier=None: " ".join(f"WHEN {c} THEN '{tier or leaf}'" for c, leaf in rows)
_MA, _DA, _MB = STRIP.format("lower(vendor)"), "lower(coalesce(description_raw, ''))", STRIP.format("lower(merchant_raw)")
_JOIN_A = f"FROM feed_a LEFT JOIN sub_map s ON sub = s.value LEFT JOIN pri_map p ON pri = p.value LEFT JOIN dict d ON {_MA} = d.value"
_JOIN_B = f"FROM feed_b LEFT JOIN cat_map c ON cat = c.value LEFT JOIN dict d ON {_MB} = d.value"
_ALL_A = "pri, sub, vendor, description_raw, direction, amount, ts, applicant"
_ALL_B = "cat, merchant_raw, description_raw, direction, amount, ts, applicant"
CAT_A = f"""
SELECT {_ALL_A}, CASE {_when(_T1A)} {_when(_T2A)} {_when(_T3A)} WHEN d.leaf IS NOT NULL THEN d.leaf {rule_case(None, _MA, _DA)}
ELSE coalesce(s.leaf, p.leaf, 'unclassified_other') END AS leaf,
CASE {_when(_T1A, 'T1_direction')} {_when(_T2A, 'T2_compound')} {_when(_T3A, 'T3_mechanism_override')}
WHEN d.leaf IS NOT NULL THEN 'T4_merchant_dictionary' {rule_case('T5_rule_', _MA, _DA)}
WHEN coalesce(s.leaf, p.leaf) IS NOT NULL THEN 'T6_provider_crosswalk' ELSE 'T7_unclassified' END AS resolution_tier {_JOIN_A}
"""
_GAMBLE = "cat = 'ENTERTAINMENT_CASINOS_AND_GAMBLING' AND direction = 'credit'"
CAT_B = f"""
SELECT {_ALL_B}, CASE WHEN {_GAMBLE} THEN 'gambling_unspecified' WHEN d.leaf IS NOT NULL THEN d.leaf {rule_case(None, _MB, _DA)}
ELSE coalesce(c.leaf, 'unclassified_other') END AS leaf, CASE WHEN {_GAMBLE} THEN 'T1_direction'
WHEN d.leaf IS NOT NULL THEN 'T4_merchant_dictionary' {rule_case('T5_rule_', _MB, _DA)} WHEN c.leaf IS NOT NULL THEN 'T6_provider_crosswalk'
ELSE 'T7_unclassified' END AS resolution_tier {_JOIN_B}
"""
EVAL_A = f"""
SELECT {_ALL_A}, CASE WHEN d.leaf IS NOT NULL THEN d.leaf {rule_case(None, _MA, _DA)} {_when(_T1A)} {_when(_T2A)} {_when(_T3A)}
ELSE coalesce(s.leaf, p.leaf, 'unclassified_other') END AS leaf, CASE WHEN d.leaf IS NOT NULL THEN 'T4_dictionary' {rule_case('T5_', _MA, _DA)}
ELSE 'T6_native_fallback' END AS resolution_tier {_JOIN_A}
"""
EVAL_B = f"""
SELECT {_ALL_B}, CASE WHEN d.leaf IS NOT NULL THEN d.leaf {rule_case(None, _MB, _DA)} WHEN {_GAMBLE} THEN 'gambling_unspecified'
ELSE coalesce(c.leaf, 'unclassified_other') END AS leaf, CASE WHEN d.leaf IS NOT NULL THEN 'T4_dictionary' {rule_case('T5_', _MB, _DA)}
ELSE 'T6_native_fallback' END AS resolution_tier {_JOIN_B}
"""
NATIVE_A = f"SELECT {_ALL_A}, CASE {_when(_T1A)} {_when(_T2A)} {_when(_T3A)} ELSE coalesce(s.leaf, p.leaf, 'unclassified_other') END AS native_leaf {_JOIN_A}"
NATIVE_B = f"SELECT {_ALL_B}, CASE WHEN {_GAMBLE} THEN 'gambling_unspecified' ELSE coalesce(c.leaf, 'unclassified_other') END AS native_leaf {_JOIN_B}"
MAPS = {"entries": SOURCES.format(c="sources"), "entries_b": SOURCES.format(c="sources_b"), "sub_map": SUB_MAP, "pri_map": PRI_MAP, "cat_map": CAT_MAP, "dict": DICT, "feed_a": FEED_A, "feed_b": FEED_B}
#: Counts of categorised rows by these columns keep results small while every row counts.
_BY = "count(*) AS n, round(sum(amount), 2) AS total"


def a(fx):
    return feeds.read_feed_a(fx.raw_a)


def b(fx):
    return feeds.read_feed_b(fx.raw_b)


def by(df, *cols):
    return df.groupBy(*cols).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query("s1_read_feed_a", FEED_A)
def s1(fx):
    return a(fx)


@query("s2_read_feed_b", FEED_B)
def s2(fx):
    return b(fx)


@query("p1_norm_merchant", f"SELECT DISTINCT vendor, {_MA} AS key, coalesce({_MA}, '') AS key_or_blank FROM feed_a", feed_a=FEED_A)
def p1(fx):
    v = F.col("vendor")
    return a(fx).select("vendor", S.norm_merchant(v).alias("key"), S.norm_merchant(v, True).alias("key_or_blank")).distinct()


@query(
    "p2_p10_scalars",
    f"""
SELECT {_DA} AS desc_text, pri || ' | ' || sub AS pair, CASE WHEN sub IS NULL THEN pri
ELSE pri || ' | ' || sub END AS pair_kept, round(abs(amount), 2) AS amount_2dp, round(ln(1 + abs(amount)), 6) AS log_amount, CASE
WHEN direction = 'credit' THEN 1 ELSE 0 END AS is_credit, lower(coalesce(vendor, '') || ' | ' || coalesce(description_raw, '')) AS model_text,
sha256(coalesce(pri, '') || '|' || coalesce(sub, '') || '|' || coalesce(vendor, '')) AS key FROM feed_a
""",
    feed_a=FEED_A,
)
def p2(fx):
    c = F.col
    return a(fx).select(
        S.desc_text(c("description_raw")).alias("desc_text"),
        S.native_pair(c("pri"), c("sub")).alias("pair"),
        S.native_pair(c("pri"), c("sub"), True).alias("pair_kept"),
        S.abs_amount(c("amount")).alias("amount_2dp"),
        F.round(S.log_amount(c("amount")), 6).alias("log_amount"),
        S.is_credit(c("direction")).alias("is_credit"),
        S.model_text(c("vendor"), c("description_raw")).alias("model_text"),
        S.surrogate_key(c("pri"), c("sub"), c("vendor")).alias("key"),
    )


@query("p4_split_pair", """
SELECT DISTINCT pair, split_part(coalesce(pair, ''), ' | ', 1) AS pri, CASE WHEN contains(coalesce(pair, ''), ' | ') THEN substr(pair, strpos(pair,
' | ') + 3) ELSE '' END AS sub FROM (SELECT pri || ' | ' || sub AS pair FROM feed_a) x
""", feed_a=FEED_A)
def p4(fx):
    rows = a(fx).select(S.native_pair(F.col("pri"), F.col("sub")).alias("pair")).distinct()
    pri, sub = S.split_pair(F.col("pair"))
    return rows.select("pair", pri.alias("pri"), sub.alias("sub"))


@query("p11_string_shape", """
SELECT CASE WHEN regexp_matches(merchant, '^(mr|mrs|ms|miss|dr) [a-z]') OR regexp_matches(merchant, '^[a-z]\\.? [a-z]+$') THEN 'person_like'
WHEN length(merchant) <= 4 THEN 'short_token' WHEN regexp_matches(merchant, '^[a-z]+ [a-z]+$') THEN 'two_word'
ELSE 'long_tail' END AS shape, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM strings GROUP BY 1
""")
def p11(fx):
    return fx.strings.groupBy(S.string_shape(F.col("merchant")).alias("shape")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


COARSE = ("unclassified_other", "bills_other", "leisure_other", "shopping_other")


@query("p12_coarse_leaf", f"SELECT leaf, leaf IN {COARSE} AS is_coarse, count(*) AS n FROM cat_a GROUP BY 1, 2", **MAPS, cat_a=CAT_A)
def p12(fx):
    return X.with_coarse(W.categorise_a(a(fx), fx.seeds()), list(COARSE)).groupBy("leaf", "is_coarse").agg(F.count("*").alias("n"))


RISKY = ("gambling", "debt")


@query("p13_risky_leaf", f"""
SELECT g.merchant, g.gold_leaf AS leaf, coalesce(t.general IN {RISKY} OR t.is_priority = 'true' OR t.is_age = 'true' OR t.is_debt = 'true',
false) AS risky FROM gold g LEFT JOIN taxonomy t ON g.gold_leaf = t.leaf
""")
def p13(fx):
    return X.with_risk(fx.gold.select("merchant", F.col("gold_leaf").alias("leaf")), fx.taxonomy, list(RISKY)).select("merchant", "leaf", "risky")


#: Source lists as a feed's own columns give them: each part names a sub, a primary, a compound, a blank and the null primary.
PART_SOURCES = """
SELECT p_name AS leaf, p_brand || '; primary:' || p_type || ' ;; primary:' || p_type || ' + sub:' || p_brand || '|Other; '
  || CASE WHEN p_partkey % 3 = 0 THEN 'primary:(null)' ELSE p_name || ' ' END AS sources
FROM {part}
"""


@query(
    "p14_parse_sources",
    """
SELECT kind, value, leaf, count(*) AS n
FROM (
  SELECT leaf, CASE WHEN starts_with(entry, 'primary:') THEN 'pri' ELSE 'sub' END AS kind, trim(replace(entry, 'primary:', '')) AS value
  FROM (SELECT leaf, trim(unnest(string_split(sources, ';'))) AS entry FROM listed) e
  WHERE entry <> '' AND NOT contains(entry, '+') AND NOT contains(entry, '|') AND entry <> 'primary:(null)'
) x GROUP BY 1, 2, 3
""",
    listed=PART_SOURCES.replace("{part}", "part"),
)
def p14(fx):
    listed = fx.spark.sql(PART_SOURCES, part=fx.part)
    return parse_sources(listed).groupBy("kind", "value", "leaf").agg(F.count("*").alias("n"))


@query("p15_parse_compound", """
SELECT e.leaf, 'Identified Salary' AS pri, t.sub AS sub, count(*) AS n FROM (SELECT leaf, trim(unnest(string_split(substr(entry, strpos(entry,
'sub:') + 4), '|'))) AS sub FROM entries WHERE contains(entry, '+')) e JOIN feed_a t ON t.pri = 'Identified Salary' AND t.sub = e.sub GROUP BY 1, 2, 3
""", **MAPS)
def p15(fx):
    rules = parse_compound(fx.taxonomy).where("pri is not null").select("leaf", "pri", F.explode("subs").alias("sub"))
    return a(fx).join(rules, ["pri", "sub"]).groupBy("leaf", "pri", "sub").agg(F.count("*").alias("n"))


@query("p16_expand_taxonomy", """
SELECT c_mktsegment AS leaf, 'general' || CAST(c_nationkey % 3 AS VARCHAR) AS general, CASE WHEN c_nationkey % 2 = 0 THEN 'essential'
WHEN c_nationkey % 3 = 0 THEN 'discretionary' ELSE 'none' END AS necessity, CASE WHEN c_nationkey % 3 = 0 THEN 'expense'
ELSE 'none' END AS flow, 'false' AS is_debt, CASE WHEN c_nationkey % 3 = 1 THEN 'true' ELSE 'false' END AS is_priority, 'false' AS is_age, '' AS risk
FROM customer
""")
def p16(fx):
    c = F.col("c_nationkey")
    none = F.lit(None).cast("string")
    leaves = fx.customer.select(F.col("c_mktsegment").alias("leaf"), F.concat(F.lit("general"), c % 3).alias("general"), F.when(c % 2 == 0, "essential").alias("necessity"), none.alias("flow"), none.alias("is_debt"), none.alias("is_priority"), none.alias("is_age"), none.alias("risk"))
    defaults = fx.spark.createDataFrame([("general0", "discretionary", "expense", None, None, None, None), ("general1", None, None, None, "true", None, None)], "general string, necessity string, flow string, is_debt string, is_priority string, is_age string, risk string")
    return expand_taxonomy(leaves, defaults).select("leaf", "general", "necessity", "flow", "is_debt", "is_priority", "is_age", "risk")


@query("f1_debit_only", "SELECT 'A' AS provider, count(*) AS n FROM raw_a WHERE TransactionTypeId = 2 UNION ALL SELECT 'B', count(*) FROM raw_b WHERE amount > 0")
def f1(fx):
    n = F.count("*").alias("n")
    return feeds.debit_only_a(fx.raw_a).agg(n).select(F.lit("A").alias("provider"), "n").union(feeds.debit_only_b(fx.raw_b).agg(n).select(F.lit("B"), "n"))


@query("f2_has_merchant", "SELECT merchant_raw, count(*) AS n FROM feed_b WHERE merchant_raw IS NOT NULL AND trim(merchant_raw) <> '' GROUP BY 1", feed_b=FEED_B)
def f2(fx):
    return feeds.has_merchant(b(fx), "merchant_raw").groupBy("merchant_raw").agg(F.count("*").alias("n"))


@query("f3_exclude_primaries", f"SELECT sub, {_BY} FROM feed_a WHERE sub NOT IN ('Council', 'Fuel') GROUP BY 1", feed_a=FEED_A)
def f3(fx):
    return by(feeds.exclude_primaries(a(fx), "sub", ["Council", "Fuel"]), "sub")


@query("f4_keys_in_and_out", """
SELECT k.side, count(*) AS n FROM (SELECT CASE WHEN merchant IN (SELECT merchant FROM dictionary) THEN 'in' ELSE 'out' END AS side FROM strings) k
GROUP BY 1
""")
def f4(fx):
    inside, outside = X.keys_in(fx.strings, fx.dictionary, "merchant"), X.keys_not_in(fx.strings, fx.dictionary, "merchant")
    n = F.count("*").alias("n")
    return inside.agg(n).select(F.lit("in").alias("side"), "n").union(outside.agg(n).select(F.lit("out"), "n"))


@query("f5_rule_matches", f"SELECT r.rule_id, count(*) AS n, round(sum(amount), 2) AS total FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, amount FROM feed_a WHERE coalesce({c.format(m=_MA, d=_DA)}, false)" for r, c, _ in RULE_SQL) + ") r GROUP BY 1", feed_a=FEED_A)
def f5(fx):
    m, d, way = S.norm_merchant(F.col("vendor")), S.desc_text(F.col("description_raw")), F.col("direction")
    hits = F.filter(F.array(*[F.when(rule_matches(r, m, d, way), r.rule_id) for r in active_rules(RULES)]), lambda x: x.isNotNull())
    return by(a(fx).select("amount", F.explode(hits).alias("rule_id")), "rule_id")


@query("f6_exact_set", "SELECT count(*) AS n FROM strings WHERE regexp_matches(merchant, '\\b(anvil|bolt 1)\\b')")
def f6(fx):
    return fx.strings.where(exact_set_match(F.col("merchant"), "anvil|bolt 1")).agg(F.count("*").alias("n"))


@query("c1_c7_categorise_a", f"SELECT leaf, resolution_tier, {_BY} FROM cat_a GROUP BY 1, 2", **MAPS, cat_a=CAT_A)
def c_a(fx):
    return by(W.categorise_a(a(fx), fx.seeds()), "leaf", "resolution_tier")


@query("c1_c7_categorise_b", f"SELECT leaf, resolution_tier, {_BY} FROM cat_b GROUP BY 1, 2", **MAPS, cat_b=CAT_B)
def c_b(fx):
    return by(W.categorise_b(b(fx), fx.seeds()), "leaf", "resolution_tier")


@query("c8_native_a", f"SELECT native_leaf, {_BY} FROM nat GROUP BY 1", **MAPS, nat=NATIVE_A)
def c8(fx):
    return by(W.native_a(a(fx), fx.seeds()), "native_leaf")


@query("c9_native_b", f"SELECT native_leaf, {_BY} FROM nat GROUP BY 1", **MAPS, nat=NATIVE_B)
def c9(fx):
    return by(W.native_b(b(fx), fx.seeds()), "native_leaf")


@query("c10_evaluation_order_a", f"SELECT leaf, resolution_tier, {_BY} FROM e GROUP BY 1, 2", **MAPS, e=EVAL_A)
def c10a(fx):
    return by(W.categorise_a(a(fx), fx.seeds(), order="evaluation"), "leaf", "resolution_tier")


@query("c10_evaluation_order_b", f"SELECT leaf, resolution_tier, {_BY} FROM e GROUP BY 1, 2", **MAPS, e=EVAL_B)
def c10b(fx):
    return by(W.categorise_b(b(fx), fx.seeds(), order="evaluation"), "leaf", "resolution_tier")


@query("c11_mechanism_variant", f"""
SELECT native_leaf, {_BY} FROM (SELECT amount, CASE {_when(_T3A)} ELSE coalesce(s.leaf, p.leaf, 'unclassified_other') END AS native_leaf {_JOIN_A}) x
GROUP BY 1
""", **MAPS)
def c11(fx):
    return by(W.native_a(a(fx), fx.seeds(), "mechanism"), "native_leaf")


@query("c12_plain_variant", f"SELECT native_leaf, {_BY} FROM (SELECT amount, coalesce(s.leaf, p.leaf) AS native_leaf {_JOIN_A}) x GROUP BY 1", **MAPS)
def c12(fx):
    return by(W.native_a(a(fx), fx.seeds(), "plain"), "native_leaf")


@query("c13_attach_metadata", f"SELECT general, necessity, flow, {_BY} FROM cat_b LEFT JOIN taxonomy t USING (leaf) GROUP BY 1, 2, 3", **MAPS, cat_b=CAT_B)
def c13(fx):
    return by(W.attach_metadata(W.categorise_b(b(fx), fx.seeds()), fx.taxonomy), "general", "necessity", "flow")


BOTH = "SELECT 'A' AS provider, leaf, resolution_tier, amount FROM cat_a UNION ALL SELECT 'B', leaf, resolution_tier, amount FROM cat_b"


def both(fx):
    cols = ["leaf", "resolution_tier", "amount"]
    return feeds.union_feeds(W.categorise_a(a(fx), fx.seeds()).select(*cols), W.categorise_b(b(fx), fx.seeds()).select(*cols))


@query("a2_tier_report", """
SELECT provider, resolution_tier, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY provider), 2) AS pct_of_provider,
count(DISTINCT u.leaf) AS distinct_leaves, count(*) FILTER (t.leaf IS NULL) AS leaves_missing_metadata FROM u LEFT JOIN taxonomy t ON u.leaf = t.leaf
GROUP BY 1, 2
""", **MAPS, cat_a=CAT_A, cat_b=CAT_B, u=BOTH)
def a2(fx):
    return W.tier_report(both(fx), fx.taxonomy)


@query("u1_union_feeds", f"SELECT provider, leaf, {_BY} FROM u GROUP BY 1, 2", **MAPS, cat_a=CAT_A, cat_b=CAT_B, u=BOTH)
def u1(fx):
    return by(both(fx), "provider", "leaf")


MODAL_A = f"""
SELECT m, pair, n, volume FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY n DESC, pair ASC NULLS LAST) AS rn,
CAST(sum(n) OVER (PARTITION BY m) AS BIGINT) AS volume FROM (SELECT {_MA} AS m, pri || ' | ' || sub AS pair, count(*) AS n FROM feed_a
WHERE direction = 'debit' AND vendor IS NOT NULL AND trim(vendor) <> '' GROUP BY 1, 2) g) r WHERE rn = 1
"""
MODAL_B = f"""
SELECT m, cat, n, volume FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY n DESC, cat ASC NULLS LAST) AS rn,
CAST(sum(n) OVER (PARTITION BY m) AS BIGINT) AS volume FROM (SELECT {_MB} AS m, cat, count(*) AS n FROM feed_b
WHERE amount > 0 AND merchant_raw IS NOT NULL AND trim(merchant_raw) <> '' GROUP BY 1, 2) g) r WHERE rn = 1
"""


def modal_a(fx):
    rows = feeds.has_merchant(a(fx).where("direction = 'debit'"), "vendor")
    return X.modal_row(rows.select(S.norm_merchant(F.col("vendor")).alias("m"), S.native_pair(F.col("pri"), F.col("sub")).alias("pair")), "m", "pair")


def modal_b(fx):
    rows = feeds.has_merchant(b(fx).where("amount > 0"), "merchant_raw")
    return X.modal_row(rows.select(S.norm_merchant(F.col("merchant_raw")).alias("m"), "cat"), "m", "cat")


@query("w1_modal_row_a", MODAL_A, feed_a=FEED_A)
def w1a(fx):
    return modal_a(fx)


@query("w1_modal_row_b", MODAL_B, feed_b=FEED_B)
def w1b(fx):
    return modal_b(fx)


@query("a1_category_counts", f"SELECT {_MB} AS m, cat, direction, count(*) AS n FROM feed_b WHERE merchant_raw IS NOT NULL AND trim(merchant_raw) <> '' GROUP BY 1, 2, 3", feed_b=FEED_B)
def a1(fx):
    rows = feeds.has_merchant(b(fx), "merchant_raw").withColumn("m", S.norm_merchant(F.col("merchant_raw")))
    return X.category_counts(rows, ["m", "cat", "direction"])


SHARED = "SELECT a.m, a.pair, b.cat, a.volume AS volume_a, b.volume AS volume_b FROM modal_a a JOIN modal_b b ON a.m = b.m"
_MODALS = {"feed_a": FEED_A, "feed_b": FEED_B, "modal_a": MODAL_A, "modal_b": MODAL_B}


@query("j2_shared_merchants", SHARED, **_MODALS)
def j2(fx):
    return X.shared_merchants(modal_a(fx), modal_b(fx))


@query("j3_unmatched", f"SELECT merchant, volume FROM strings WHERE merchant NOT IN (SELECT {_MA} FROM feed_a WHERE vendor IS NOT NULL)", feed_a=FEED_A)
def j3(fx):
    return X.unmatched(fx.strings, X.distinct_vendors(a(fx)))


@query("u2_distinct_vendors", f"SELECT DISTINCT {_MA} AS merchant FROM feed_a WHERE vendor IS NOT NULL", feed_a=FEED_A)
def u2(fx):
    return X.distinct_vendors(a(fx))


@query("u3_common_and_all_keys", """
SELECT 'common' AS side, count(*) AS n FROM (SELECT merchant FROM strings INTERSECT SELECT merchant FROM dictionary) x
UNION ALL SELECT 'all', count(*) FROM (SELECT merchant FROM strings UNION SELECT merchant FROM dictionary) y
""")
def u3(fx):
    n = F.count("*").alias("n")
    one, two = fx.strings.select("merchant"), fx.dictionary.select("merchant")
    return X.common_keys(one, two).agg(n).select(F.lit("common").alias("side"), "n").union(X.all_keys(one, two).agg(n).select(F.lit("all"), "n"))


AGREED = f"""
SELECT s.*, coalesce(sm.leaf, pm.leaf) AS leaf_a, cm.leaf AS leaf_b FROM ({SHARED}) s LEFT JOIN sub_map sm ON split_part(s.pair, ' | ', 2) = sm.value
LEFT JOIN pri_map pm ON split_part(s.pair, ' | ', 1) = pm.value LEFT JOIN cat_map cm ON s.cat = cm.value
"""
_AGREED = {**MAPS, **{k: v for k, v in _MODALS.items() if k.startswith("modal")}, "agreed": AGREED}


def agreed(fx):
    return X.with_leaves(X.shared_merchants(modal_a(fx), modal_b(fx)), fx.seeds())


@query("a7_agreement_summary", f"""
SELECT count(*) AS merchants, CAST(sum(volume_b) AS BIGINT) AS volume, count(*) FILTER (leaf_a = leaf_b) AS agree,
CAST(coalesce(sum(volume_b) FILTER (leaf_a = leaf_b), 0) AS BIGINT) AS agree_volume,
count(*) FILTER (leaf_a <> leaf_b AND (leaf_a IN {COARSE} OR leaf_b IN {COARSE})) AS coarse,
count(*) FILTER (leaf_a <> leaf_b AND NOT (leaf_a IN {COARSE} OR leaf_b IN {COARSE})) AS genuine FROM agreed
""", **_AGREED)
def a7(fx):
    return X.agreement_summary(agreed(fx), list(COARSE))


@query("k2_top_conflicts", "SELECT m, leaf_a, leaf_b, volume_b FROM agreed WHERE leaf_a <> leaf_b ORDER BY volume_b DESC, m LIMIT 20", **_AGREED)
def k2(fx):
    return X.top_conflicts(agreed(fx), 20)


@query("a16_category_bridge", """
SELECT pair, cat, n, round(100.0 * n / total, 2) AS pct, kinds FROM (SELECT *, row_number() OVER (PARTITION BY pair
ORDER BY n DESC, cat) AS rn, sum(n) OVER (PARTITION BY pair) AS total, count(*) OVER (PARTITION BY pair) AS kinds
FROM (SELECT pair, cat, count(*) AS n FROM agreed WHERE pair IS NOT NULL GROUP BY 1, 2) g) r WHERE rn = 1
""", **_AGREED)
def a16(fx):
    return X.category_bridge(agreed(fx))


@query("l16_ground_truth", f"""
SELECT (SELECT count(*) FROM agreed) AS shared, (SELECT count(*) FROM agreed
WHERE split_part(pair, ' | ', 1) IN ('Identified Salary', 'Refund')) AS mechanism, count(*) FILTER (leaf_a IS NULL) AS unresolved,
count(*) FILTER (leaf_a IS NOT NULL) AS kept FROM agreed WHERE split_part(coalesce(pair, ''), ' | ', 1) NOT IN ('Identified Salary', 'Refund')
""", **_AGREED)
def l16(fx):
    return X.ground_truth_counts(agreed(fx), list(MECHANISMS))


@query("a17_unclassified_rate", "SELECT provider, round(avg(CASE WHEN leaf = 'unclassified_other' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM u GROUP BY 1", **MAPS, cat_a=CAT_A, cat_b=CAT_B, u=BOTH)
def a17(fx):
    return both(fx).groupBy("provider").agg(F.round(F.avg((F.col("leaf") == W.RESIDUAL).cast("int")), 6).alias("rate"))


@query("a18_per_applicant", """
SELECT count(*) AS applicants, round(avg(n), 4) AS mean, max(n) AS most, min(n) AS least, round(quantile_cont(n, 0.5), 4) AS median,
round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.95), 4) AS p95, round(quantile_cont(n, 0.99), 4) AS p99
FROM (SELECT applicant, count(*) AS n FROM (SELECT applicant FROM raw_a UNION ALL SELECT applicant FROM raw_b) x GROUP BY 1) y
""")
def a18(fx):
    return X.per_applicant(fx.raw_a.select("applicant").union(fx.raw_b.select("applicant")))


@query("e11_feed_independence", """
SELECT count(*) AS merchants, round(avg(CASE WHEN leaf_a = leaf_b THEN 1.0 ELSE 0.0 END), 6) AS same FROM agreed
WHERE leaf_a IS NOT NULL AND leaf_b IS NOT NULL
""", **_AGREED)
def e11(fx):
    rows = agreed(fx).where("leaf_a is not null and leaf_b is not null")
    return rows.agg(F.count("*").alias("merchants"), F.round(F.avg((F.col("leaf_a") == F.col("leaf_b")).cast("int")), 6).alias("same"))


@query("j9_orphans", "SELECT merchant, verdict, correct_leaf AS leaf FROM verdicts WHERE correct_leaf NOT IN (SELECT leaf FROM taxonomy)")
def j9(fx):
    return orphans(fx.verdicts.withColumnRenamed("correct_leaf", "leaf"), fx.taxonomy, "leaf").select("merchant", "verdict", "leaf")


#: Every source as a pair of sides, either of which may be any (null); values of compounds are ``pri + sub``.
SIDES = """
SELECT leaf, value, CASE WHEN kind = 'pri' THEN value END AS p, CASE WHEN kind = 'sub' THEN value END AS s
FROM (
  SELECT leaf, CASE WHEN starts_with(entry, 'primary:') THEN 'pri' ELSE 'sub' END AS kind, trim(replace(entry, 'primary:', '')) AS value
  FROM entries WHERE NOT contains(entry, '+') AND NOT contains(entry, '|') AND entry <> 'primary:(null)'
) x
UNION ALL
SELECT leaf, concat_ws(' + ', p, s), p, s
FROM (
  SELECT leaf, nullif(trim(regexp_extract(entry, 'primary:([^+]*)', 1)), '') AS p, trim(unnest(string_split(regexp_extract(entry, 'sub:([^+]*)', 1), '|'))) AS s
  FROM entries WHERE contains(entry, '+') OR contains(entry, '|')
) y
"""
SOURCED = "SELECT f.*, t.leaf, t.value FROM sides t JOIN feed_a f ON (t.p IS NULL OR f.pri = t.p) AND (t.s IS NULL OR f.sub = t.s)"
_S = {"entries": MAPS["entries"], "sides": SIDES, "feed_a": FEED_A, "sourced": SOURCED}


def sourced(fx):
    """Transactions of feed A by the sources of each leaf, compound ones included."""
    return X.source_match(a(fx), parse_sources(fx.taxonomy), parse_compound(fx.taxonomy))


@query("j10_source_match", "SELECT leaf, value, count(*) AS n FROM sourced GROUP BY 1, 2", **_S)
def j10(fx):
    return sourced(fx).groupBy("leaf", "value").agg(F.count("*").alias("n"))


@query("j11_label_rows", f"SELECT leaf, {_BY} FROM (SELECT f.amount, g.gold_leaf AS leaf FROM feed_b f JOIN gold g ON {_MB} = g.merchant) x GROUP BY 1", feed_b=FEED_B)
def j11(fx):
    rows = b(fx).withColumn("merchant", S.norm_merchant(F.col("merchant_raw")))
    return by(X.label_rows(rows, fx.gold.withColumnRenamed("gold_leaf", "leaf")), "leaf")


@query("j6_prefer", f"""
SELECT coalesce(b.m, a.m) AS m, coalesce(b.cat, a.pair) AS category, CASE WHEN b.m IS NULL THEN 'A' ELSE 'B' END AS provider FROM modal_a a FULL
JOIN modal_b b ON a.m = b.m WHERE (b.m IS NOT NULL AND b.cat IS NOT NULL) OR b.m IS NULL
""", **_MODALS)
def j6(fx):
    return X.prefer(modal_b(fx).select("m", F.col("cat").alias("category")), modal_a(fx).select("m", F.col("pair").alias("category")), "m")


@query("k4_ordered_report", f"SELECT provider, leaf, {_BY} FROM u GROUP BY 1, 2", **MAPS, cat_a=CAT_A, cat_b=CAT_B, u=BOTH)
def k4(fx):
    return by(both(fx), "provider", "leaf").orderBy("provider", F.col("n").desc(), "leaf")
