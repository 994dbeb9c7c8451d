"""Queries of evidence, consensus, gating, checks and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import checks as Q
from ledgerloom.operators import consensus as C
from ledgerloom.operators import evidence as E
from ledgerloom.operators import sketches as K
from ledgerloom.operators.crossfeed import keys_not_in
from ledgerloom.operators.seeds import parse_sources
from ledgerloom.plans.feeds import FEED_A, FEED_B, MAPS, RISKY, _MB, a, b
from ledgerloom.plans.registry import query
from ledgerloom.sources import feeds, tables

ALIGNED = """
SELECT s.merchant, s.volume, a.llm_leaf AS leaf_a, a.llm_confidence AS conf_a, b.llm_leaf AS leaf_b, b.llm_confidence AS conf_b, c.llm_leaf AS leaf_c,
c.llm_confidence AS conf_c FROM strings s LEFT JOIN labels_a a USING (merchant) LEFT JOIN labels_b b USING (merchant) LEFT
JOIN labels_c c USING (merchant)
"""
_AGREE = "coalesce(leaf_a, '') <> '' AND leaf_a = leaf_b"
GATED = f"""
SELECT *, coalesce(conf_b, 0.0) AS confidence, CASE WHEN {_AGREE} AND leaf_a = 'unclassified_other' THEN 'abstain_confirmed'
WHEN {_AGREE} AND coalesce(conf_b, 0) >= 0.9 THEN 'auto_accept' WHEN {_AGREE} AND coalesce(conf_b, 0) >= 0.7 THEN 'accepted'
ELSE 'needs_review' END AS tier, CASE WHEN coalesce(leaf_b, '') <> '' THEN leaf_b ELSE coalesce(leaf_a, '') END AS final_leaf FROM aligned
"""
_RISK = f"(general IN {RISKY} OR is_priority = 'true' OR is_age = 'true' OR is_debt = 'true')"
BROKEN = f"""SELECT merchant, volume, leaf_a, leaf_b, leaf_c, confidence, CASE WHEN NOT third THEN tier WHEN hit AND leaf_c = 'unclassified_other' THEN 'abstain_confirmed' WHEN hit THEN 'accepted_tiebreak' WHEN ga = gb AND gb = gc THEN 'accepted_general' WHEN ra <> rb OR rb <> rc THEN 'needs_review' ELSE 'abstain_residual' END AS tier, CASE WHEN NOT third THEN final_leaf WHEN hit THEN leaf_c WHEN ga = gb AND gb = gc THEN leaf_b WHEN ra <> rb OR rb <> rc THEN leaf_b ELSE 'unclassified_other' END AS final_leaf FROM (SELECT g.*, tier = 'needs_review' AND coalesce(leaf_c, '') <> '' AS third, coalesce(leaf_c = leaf_a, false) OR coalesce(leaf_c = leaf_b, false) AS hit, ta.general AS ga, tb.general AS gb, tc.general AS gc, coalesce({_RISK.replace("general", "ta.general").replace("is_", "ta.is_")}, false) AS ra, coalesce({_RISK.replace("general", "tb.general").replace("is_", "tb.is_")}, false) AS rb, coalesce({_RISK.replace("general", "tc.general").replace("is_", "tc.is_")}, false) AS rc FROM gated g LEFT JOIN taxonomy ta ON leaf_a = ta.leaf LEFT JOIN taxonomy tb ON leaf_b = tb.leaf LEFT JOIN taxonomy tc ON leaf_c = tc.leaf) x"""
_G = {"aligned": ALIGNED, "gated": GATED, "broken": BROKEN}
_A = {"aligned": ALIGNED}


def aligned(fx):
    return C.align_labellers(fx.strings, {"a": fx.labels_a, "b": fx.labels_b, "c": fx.labels_c})


def broken(fx):
    return C.tiebreak(C.gate(aligned(fx)), fx.taxonomy, list(RISKY))


def keyed_b(fx):
    return feeds.has_merchant(b(fx), "merchant_raw").withColumn("m", S.norm_merchant(F.col("merchant_raw")))


_KEYED = f"SELECT {_MB} AS m, cat, description_raw, direction, amount FROM feed_b WHERE merchant_raw IS NOT NULL AND trim(merchant_raw) <> ''"
_K = {"feed_b": FEED_B, "keyed": _KEYED}


@query("j7_align_labellers", ALIGNED)
def j7(fx):
    return aligned(fx)


@query("l1_draft_label", """
SELECT merchant, CASE WHEN coalesce(leaf_a, '') = '' OR coalesce(leaf_b, '') = '' THEN 'missing' WHEN leaf_a = leaf_b THEN leaf_a ELSE '' END AS draft
FROM aligned
""", **_A)
def l1(fx):
    return C.draft_label(aligned(fx)).select("merchant", "draft")


CLASSED = """
SELECT a.*, g.gold_leaf, CASE WHEN leaf_a = leaf_b AND leaf_a = gold_leaf THEN 'agree_right' WHEN leaf_a = leaf_b THEN 'agree_wrong'
ELSE 'disagree' END AS consensus FROM aligned a JOIN (SELECT merchant, gold_leaf FROM gold) g USING (merchant)
WHERE leaf_a <> '' AND leaf_b <> '' AND leaf_a <> 'unclassified_other' AND leaf_b <> 'unclassified_other'
"""


def classed(fx):
    return C.consensus_class(aligned(fx).join(fx.gold.select("merchant", "gold_leaf"), "merchant"), "gold_leaf")


@query("l2_consensus_class", "SELECT consensus, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM classed GROUP BY 1", **_A, classed=CLASSED)
def l2(fx):
    return classed(fx).groupBy("consensus").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("l3_dispute_queue", "SELECT merchant, volume, leaf_a, gold_leaf FROM classed WHERE consensus = 'agree_wrong'", **_A, classed=CLASSED)
def l3(fx):
    return C.dispute_queue(aligned(fx).join(fx.gold.select("merchant", "gold_leaf"), "merchant"), "gold_leaf").select("merchant", "volume", "leaf_a", "gold_leaf")


@query("l4_gate", "SELECT merchant, tier, final_leaf, confidence FROM gated", **_G)
def l4(fx):
    return C.gate(aligned(fx)).select("merchant", "tier", "final_leaf", "confidence")


@query("l5_l6_tiebreak", "SELECT merchant, tier, coalesce(final_leaf, '') AS final_leaf FROM broken", **_G)
def l5(fx):
    return broken(fx).select("merchant", "tier", F.coalesce("final_leaf", F.lit("")).alias("final_leaf"))


FOLDED = """
SELECT b.merchant, b.volume, CASE WHEN turn AND verdict IN ('agreed', 'first') THEN coalesce(leaf_a, '')
WHEN turn AND verdict = 'second' THEN coalesce(leaf_b, '') WHEN turn AND verdict = 'other' THEN coalesce(correct_leaf, '')
WHEN turn THEN 'unclassified_other' ELSE final_leaf END AS final_leaf, CASE WHEN turn AND verdict = 'context_dependent' THEN 'context_dependent'
WHEN turn AND verdict = 'unsure' THEN 'abstain_human' WHEN turn THEN 'human_reviewed' ELSE tier END AS tier
FROM (SELECT b.*, v.verdict, v.correct_leaf, b.tier = 'needs_review' AND v.verdict IS NOT NULL AS turn FROM broken b LEFT JOIN (SELECT * FROM verdicts
WHERE verdict <> '') v USING (merchant)) b
"""


@query("l7_fold_verdicts", "SELECT merchant, tier, coalesce(final_leaf, '') AS final_leaf FROM folded", **_G, folded=FOLDED)
def l7(fx):
    return C.fold_verdicts(broken(fx), fx.verdicts).select("merchant", "tier", F.coalesce("final_leaf", F.lit("")).alias("final_leaf"))


@query(
    "l8_verdict_to_gold",
    """
SELECT merchant, gold_leaf, verdict AS gold_source
FROM (
  SELECT a.merchant, verdict, CASE verdict WHEN 'agreed' THEN leaf_a WHEN 'first' THEN leaf_a WHEN 'second' THEN leaf_b WHEN 'other' THEN correct_leaf
    WHEN 'unclassifiable' THEN 'unclassified_other' END AS gold_leaf
  FROM aligned a JOIN verdicts v USING (merchant)
) x WHERE gold_leaf <> ''
""",
    **_A,
)
def l8(fx):
    return C.verdict_to_gold(aligned(fx), fx.verdicts)


@query("l8_excluded_verdicts", """
SELECT CASE WHEN verdict = '' THEN 'blank' ELSE verdict END AS verdict, count(*) AS n FROM verdicts
WHERE verdict NOT IN ('agreed', 'first', 'second', 'other', 'unclassifiable') GROUP BY 1
""")
def l8x(fx):
    return C.excluded_verdicts(fx.verdicts)


_CORR = """
SELECT count(*) FILTER (consensus = 'agree_right') AS \"right\", count(*) FILTER (consensus = 'agree_wrong' AND verdict IN ('agreed', 'first',
'second')) AS confirmed, count(*) FILTER (consensus = 'agree_wrong' AND verdict = 'context_dependent') AS excluded,
count(*) FILTER (consensus = 'agree_wrong' AND (verdict IS NULL OR verdict IN ('', 'unsure'))) AS open, count(*) AS rows FROM classed LEFT
JOIN verdicts USING (merchant) WHERE consensus <> 'disagree'
"""


@query("l9_l10_corrected_accuracy", """
SELECT *, CASE WHEN pessimistic >= 0.95 THEN 'go' WHEN optimistic < 0.8 THEN 'stop' ELSE 'undecided' END AS decision
FROM (SELECT *, round((\"right\" + confirmed) / (rows - excluded), 6) AS pessimistic, round((\"right\" + confirmed + open) / (rows - excluded),
6) AS optimistic FROM corr) x
""", **_A, classed=CLASSED, corr=_CORR)
def l9(fx):
    return C.corrected_accuracy(classed(fx), fx.verdicts)


@query("l11_new_entries", """
SELECT merchant, correct_leaf AS leaf FROM verdicts WHERE verdict = 'other' AND correct_leaf <> '' AND merchant NOT IN (SELECT merchant
FROM dictionary)
""")
def l11(fx):
    return C.new_entries(fx.verdicts, fx.dictionary)


@query("l12_pairwise_agreement", """
SELECT count(*) AS n, round(avg(CASE WHEN a.llm_leaf = b.llm_leaf THEN 1.0 ELSE 0.0 END), 6) AS leaf, round(avg(CASE WHEN ta.general IS NOT DISTINCT
FROM tb.general THEN 1.0 ELSE 0.0 END), 6) AS general FROM labels_a a JOIN labels_b b USING (merchant) LEFT JOIN taxonomy ta ON a.llm_leaf = ta.leaf
LEFT JOIN taxonomy tb ON b.llm_leaf = tb.leaf WHERE a.llm_leaf <> '' AND b.llm_leaf <> ''
""")
def l12(fx):
    return C.pairwise_agreement(fx.labels_a, fx.labels_b, fx.taxonomy)


@query("l13_accept_agreed", f"""
SELECT count(*) FILTER ({_AGREE}) AS accepted, count(*) FILTER (NOT coalesce({_AGREE}, false)) AS dropped,
count(*) FILTER ({_AGREE} AND leaf_a <> gold_leaf) AS off_target FROM aligned JOIN gold USING (merchant)
""", **_A)
def l13(fx):
    return C.accept_agreed(aligned(fx).join(fx.gold.select("merchant", "gold_leaf"), "merchant"), "gold_leaf")


@query("l14_apply_review", """
SELECT CASE WHEN coalesce(correct_leaf, '') = '' THEN 'blank' WHEN correct_leaf NOT IN (SELECT leaf FROM taxonomy) THEN 'invalid'
ELSE 'gold' END AS outcome, count(*) AS n FROM gold_rows LEFT JOIN verdicts USING (merchant) GROUP BY 1
""")
def l14(fx):
    return C.apply_review(fx.gold_rows, fx.verdicts, fx.taxonomy)


@query("l15_consensus_or_confident", f"SELECT merchant, CASE WHEN {_AGREE} THEN leaf_a WHEN coalesce(leaf_b, '') <> '' AND conf_b >= 0.7 THEN leaf_b END AS chosen FROM aligned", **_A)
def l15(fx):
    return C.consensus_or_confident(aligned(fx)).select("merchant", "chosen")


@query("a11_tier_stats", """
SELECT tier, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct,
round(100 * sum(volume) / sum(sum(volume)) OVER (), 2) AS pct_volume FROM broken GROUP BY 1
""", **_G)
def a11(fx):
    return C.tier_stats(broken(fx))


@query("p17_conf_bucket", """
SELECT CASE WHEN llm_confidence >= 0.9 THEN '0.9-1.0' WHEN llm_confidence >= 0.7 THEN '0.7-0.9' WHEN llm_confidence >= 0.5 THEN '0.5-0.7'
ELSE '0.0-0.5' END AS bucket, count(*) AS n FROM labels_b GROUP BY 1
""")
def p17(fx):
    return fx.labels_b.groupBy(S.conf_bucket(F.col("llm_confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@query("a4_top_k_counts", """
SELECT m, value, n, rank FROM (SELECT m, cat AS value, count(*) AS n, row_number() OVER (PARTITION BY m
ORDER BY count(*) DESC, cat ASC NULLS LAST) AS rank FROM keyed GROUP BY 1, 2) x WHERE rank <= 2
""", **_K)
def a4(fx):
    return E.top_k_counts(keyed_b(fx), "m", "cat", 2)


@query("a3_evidence", """
SELECT m, round(avg(CASE WHEN direction = 'credit' THEN 1.0 ELSE 0.0 END), 2) AS pct_credit, round(quantile_cont(abs(amount), 0.5),
4) AS median_amount, count(DISTINCT cat) > 1 AS more FROM keyed GROUP BY 1
""", **_K)
def a3(fx):
    return E.evidence(keyed_b(fx)).select("m", "pct_credit", "median_amount", (F.size("cats") > 1).alias("more"))


@query("a4_top_k_sketched", """
SELECT m, CAST(rank AS INTEGER) AS rank, value, n FROM (SELECT m, cat AS value, count(*) AS n, row_number() OVER (PARTITION BY m
ORDER BY count(*) DESC, cat ASC NULLS LAST) AS rank FROM keyed GROUP BY 1, 2) x WHERE rank <= 2
""", **_K)
def a4s(fx):
    """Top categories by a sketch that holds all of a merchant's, so that the counts are exact."""
    tops = keyed_b(fx).groupBy("m").agg(K.top_values("cat", 2, 1024).alias("cats"))
    return tops.select("m", F.posexplode("cats").alias("at", "one")).select("m", (F.col("at") + 1).alias("rank"), "one.value", F.col("one.count").alias("n"))


@query("a3_evidence_sketched", """
SELECT m, round(avg(CASE WHEN direction = 'credit' THEN 1.0 ELSE 0.0 END), 2) AS pct_credit, count(amount) > 0 AS has_median,
CASE WHEN count(amount) > 0 THEN true END AS within FROM keyed GROUP BY 1
""", **_K)
def a3s(fx):
    """Evidence by sketches, and whether the true ranks around each median are within the sketch's error."""
    rows, accuracy = keyed_b(fx), 400
    told = K.evidence(rows, accuracy=accuracy).select(F.col("m").alias("own"), "pct_credit", "median_amount")
    met = rows.join(told, F.col("m").eqNullSafe(F.col("own"))).where(F.col("amount").isNotNull())
    at = F.round(F.abs("amount"), 4)
    ranks = met.groupBy(F.col("own").alias("o")).agg(F.avg((at < F.col("median_amount")).cast("int")).alias("below"), F.avg((at <= F.col("median_amount")).cast("int")).alias("upto"))
    error = 1.7 / accuracy
    out = told.join(ranks, F.col("own").eqNullSafe(F.col("o")), "left")
    return out.select(F.col("own").alias("m"), "pct_credit", F.col("median_amount").isNotNull().alias("has_median"), ((F.col("below") <= 0.5 + error) & (F.col("upto") >= 0.5 - error)).alias("within"))


@query("p18_render_evidence", """
SELECT m, string_agg(substr(coalesce(value, 'n/a'), 1, 70) || ' ' || n || 'x', '; ' ORDER BY rank) AS cats_text
FROM (SELECT m, cat AS value, count(*) AS n, row_number() OVER (PARTITION BY m ORDER BY count(*) DESC, cat ASC NULLS LAST) AS rank FROM keyed
GROUP BY 1, 2) x WHERE rank <= 2 GROUP BY 1
""", **_K)
def p18(fx):
    return E.render_evidence(E.evidence(keyed_b(fx)), "cats").select("m", "cats_text")


@query("a5_category_mix", """
SELECT m, string_agg(coalesce(cat, 'n/a') || ' ' || CAST(round(100.0 * n / total) AS INTEGER) || '%', ', ' ORDER BY rank) AS mix
FROM (SELECT m, cat, n, sum(n) OVER (PARTITION BY m) AS total, row_number() OVER (PARTITION BY m ORDER BY n DESC, cat ASC NULLS LAST) AS rank
FROM (SELECT m, cat, count(*) AS n FROM keyed GROUP BY 1, 2) g) x WHERE rank <= 3 GROUP BY 1
""", **_K)
def a5(fx):
    return E.category_mix(keyed_b(fx), "m", "cat", 3)


@query("a6_native_share", """
SELECT m, string_agg(coalesce(cat, 'n/a') || ' ' || CAST(round(100.0 * n / total) AS INTEGER) || '%', ' · ' ORDER BY rank) AS native
FROM (SELECT m, cat, n, sum(n) OVER (PARTITION BY m) AS total, row_number() OVER (PARTITION BY m ORDER BY n DESC, cat ASC NULLS LAST) AS rank
FROM (SELECT m, cat, count(*) AS n FROM keyed GROUP BY 1, 2) g) x WHERE rank <= 2 GROUP BY 1
""", **_K)
def a6(fx):
    return E.native_share(keyed_b(fx), "m", "cat")


@query("p19_render_requests", """
SELECT CAST(floor(rn / 20) AS BIGINT) AS batch, string_agg((rn % 20 + 1) || '. ' || merchant, chr(10) ORDER BY rn) AS request
FROM (SELECT merchant, row_number() OVER (ORDER BY volume DESC, merchant) - 1 AS rn FROM strings) x GROUP BY 1
""")
def p19(fx):
    return E.render_requests(fx.strings, [F.col("volume").desc(), F.col("merchant")], 20)


ECHO = """
SELECT idx, CASE WHEN idx % 7 = 0 THEN 'garbled' WHEN idx % 11 = 0 THEN nxt ELSE merchant END AS echo, 'answer ' || idx AS answer
FROM (SELECT merchant, row_number() OVER (ORDER BY merchant) AS idx, lead(merchant) OVER (ORDER BY merchant) AS nxt FROM strings) x
"""


@query("p20_reconcile", """
SELECT merchant, answer FROM (SELECT merchant, answer, row_number() OVER (PARTITION BY merchant ORDER BY rank, answer) AS rn
FROM (SELECT b.merchant, e.answer, 0 AS rank FROM (SELECT merchant, row_number() OVER (ORDER BY merchant) AS idx FROM strings) b
JOIN echo e ON b.idx = e.idx WHERE e.echo = b.merchant OR (e.echo IS NULL OR e.echo NOT IN (SELECT merchant FROM strings))
UNION ALL SELECT echo, answer, 1 FROM echo WHERE echo IN (SELECT merchant FROM strings)) u) x WHERE rn = 1
""", echo=ECHO)
def p20(fx):
    answers = fx.spark.sql(ECHO.replace("FROM strings", "FROM {strings}"), strings=fx.strings)
    return C.reconcile(tables.stable_ids(fx.strings, ["merchant"]).withColumnRenamed("row_id", "idx"), answers)


@query("p21_leaf_from_index", "SELECT s.merchant, n.leaf FROM strings s JOIN leaf_numbers n ON s.volume % 30 = n.leaf_no + 1")
def p21(fx):
    return C.leaf_from_index(fx.strings.select("merchant", (F.col("volume") % 30).alias("place")), fx.leaf_numbers)


@query("p22_leaf_examples", """
SELECT leaf, string_agg(merchant, ', ' ORDER BY merchant) AS examples FROM (SELECT leaf, merchant, row_number() OVER (PARTITION BY leaf
ORDER BY merchant) AS rn FROM (SELECT DISTINCT leaf, merchant FROM dictionary) d) x WHERE rn <= 4 GROUP BY 1
""")
def p22(fx):
    return E.leaf_examples(fx.dictionary, 4)


@query("k1_top_strings", "SELECT merchant, volume FROM strings WHERE merchant NOT IN (SELECT merchant FROM gold) ORDER BY volume DESC, merchant LIMIT 50")
def k1(fx):
    return E.top_strings(fx.strings, fx.gold, 50)


@query("a15_coverage", """
SELECT count(*) FILTER (merchant IN (SELECT merchant FROM dictionary)) AS strings, round(sum(CASE WHEN merchant IN (SELECT merchant
FROM dictionary) THEN volume ELSE 0 END) / sum(volume), 6) AS share FROM strings
""")
def a15(fx):
    return E.coverage(fx.strings, fx.dictionary)


@query("a15_topn_share", """
SELECT round((SELECT sum(volume) FROM (SELECT volume FROM strings ORDER BY volume DESC, merchant LIMIT 100) t) / (SELECT sum(volume)
FROM strings), 6) AS share
""")
def a15n(fx):
    return E.topn_share(fx.strings, 100)


@query("s12_upsert_predictions", """
SELECT merchant, llm_leaf FROM labels_b WHERE llm_confidence >= 0.5 UNION ALL SELECT merchant, llm_leaf FROM labels_a
WHERE merchant NOT IN (SELECT merchant FROM labels_b WHERE llm_confidence >= 0.5)
""")
def s12(fx):
    cols = ["merchant", "llm_leaf"]
    return tables.upsert_predictions(fx.labels_a.select(*cols), fx.labels_b.where("llm_confidence >= 0.5").select(*cols), "merchant")


@query("s13_pending", "SELECT merchant, volume FROM strings WHERE merchant NOT IN (SELECT merchant FROM labels_c WHERE coalesce(llm_leaf, '') <> '')")
def s13(fx):
    return tables.pending(fx.strings, fx.labels_c, "merchant")


VOCABULARY = ["agreed", "first", "second", "other", "unclassifiable", "context_dependent", "unsure"]


@query("s14_read_verdicts", f"""
SELECT CASE WHEN verdict IN {tuple(VOCABULARY)} AND (correct_leaf = '' OR correct_leaf IN (SELECT leaf FROM taxonomy)) THEN 'good'
ELSE 'bad' END AS side, count(*) AS n FROM verdicts GROUP BY 1
""")
def s14(fx):
    good, bad = tables.read_verdicts(fx.verdicts, VOCABULARY, fx.taxonomy.select("leaf"))
    n = F.count("*").alias("n")
    return good.agg(n).select(F.lit("good").alias("side"), "n").union(bad.agg(n).select(F.lit("bad"), "n"))


@query("a14_verdict_counts", "SELECT verdict, count(*) AS n FROM verdicts GROUP BY 1")
def a14(fx):
    return fx.verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


@query("q1_q8_duplicate_keys", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def q1(fx):
    return Q.duplicates(fx.part, "p_name")


@query("q2_multi_parent", f"SELECT merchant, count(DISTINCT gold_leaf) AS parents FROM gold_rows GROUP BY 1 HAVING count(DISTINCT gold_leaf) > 1")
def q2(fx):
    return Q.multi_parent(fx.gold_rows, "merchant", "gold_leaf")


@query("q3_bad_domain", "SELECT merchant, verdict FROM verdicts WHERE verdict NOT IN ('first', 'second', 'other')")
def q3(fx):
    return Q.bad_domain(fx.verdicts, "verdict", ["first", "second", "other"]).select("merchant", "verdict")


@query("q4_bad_boolean", """
SELECT vendor, count(*) AS n FROM (SELECT vendor, CASE WHEN sub IS NULL THEN '' WHEN sub = 'Fuel' THEN 'yes' ELSE 'true' END AS flag FROM feed_a) x
WHERE flag NOT IN ('true', 'false') GROUP BY 1
""", feed_a=FEED_A)
def q4(fx):
    rows = a(fx).withColumn("flag", F.when(F.col("sub").isNull(), "").when(F.col("sub") == "Fuel", "yes").otherwise("true"))
    return Q.bad_boolean(rows, ["flag"]).groupBy("vendor").agg(F.count("*").alias("n"))


@query("q5_ambiguous_sources", "SELECT 'sub' AS kind, sub AS value, count(DISTINCT pri) AS leaves FROM feed_a WHERE sub IS NOT NULL GROUP BY 2 HAVING count(DISTINCT pri) > 1", feed_a=FEED_A)
def q5(fx):
    seen = a(fx).where("sub is not null").select(F.col("pri").alias("leaf"), F.col("sub").alias("sources")).distinct()
    return Q.ambiguous_sources(seen)


@query("q6_u4_set_drift", """
(SELECT merchant, 'unexpected' AS side FROM labels_a WHERE llm_leaf <> '' EXCEPT SELECT merchant, 'unexpected' FROM gold)
UNION ALL (SELECT merchant, 'missing' FROM gold EXCEPT SELECT merchant, 'missing' FROM labels_a WHERE llm_leaf <> '')
""")
def q6(fx):
    return Q.set_drift(fx.labels_a.where("llm_leaf <> ''").select("merchant"), fx.gold.select("merchant"))


@query("q7_unknown_leaves", "SELECT merchant, correct_leaf FROM verdicts WHERE correct_leaf <> '' AND correct_leaf NOT IN (SELECT leaf FROM taxonomy)")
def q7(fx):
    return Q.unknown_leaves(fx.verdicts, fx.taxonomy, "correct_leaf").select("merchant", "correct_leaf")


@query("q9_q10_missing_members", "SELECT DISTINCT n.leaf FROM leaf_numbers n WHERE n.leaf NOT IN (SELECT leaf FROM dictionary WHERE leaf IS NOT NULL)")
def q9(fx):
    return keys_not_in(fx.leaf_numbers.select("leaf"), fx.dictionary, "leaf").distinct()


@query("q11_uncovered_values", "SELECT DISTINCT sub AS value FROM feed_a WHERE sub IS NOT NULL AND sub NOT IN (SELECT value FROM sub_map)", **{k: MAPS[k] for k in ("entries", "sub_map", "feed_a")})
def q11(fx):
    return Q.uncovered_values(a(fx), "sub", parse_sources(fx.taxonomy).where("kind = 'sub'"))


@query("q12_split_overlap", "SELECT merchant FROM gold INTERSECT SELECT merchant FROM dictionary")
def q12(fx):
    return Q.split_overlap(fx.gold, fx.dictionary, "merchant")


@query("u5_w6_build_dictionary", """
SELECT merchant, leaf, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY source_rank, leaf) AS rn
FROM (SELECT merchant, leaf, 0 AS source_rank FROM dictionary UNION ALL SELECT merchant, correct_leaf, 1 FROM verdicts WHERE verdict = 'other'
UNION ALL SELECT merchant, gold_leaf, 2 FROM gold) u) x WHERE rn = 1
""")
def u5(fx):
    return Q.build_dictionary([fx.dictionary, fx.verdicts.where("verdict = 'other'").withColumnRenamed("correct_leaf", "leaf"), fx.gold.withColumnRenamed("gold_leaf", "leaf")])


@query("u6_merge_verdicts", """
SELECT merchant, verdict, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY source_rank DESC, verdict) AS rn
FROM (SELECT merchant, verdict, 0 AS source_rank FROM verdicts UNION ALL SELECT merchant, 'first', 1 FROM gold WHERE gold_source = 'human') u) x
WHERE rn = 1
""")
def u6(fx):
    return Q.merge_verdicts([fx.verdicts.select("merchant", "verdict"), fx.gold.where("gold_source = 'human'").select("merchant", F.lit("first").alias("verdict"))])


@query("f9_promotable", """
SELECT merchant, leaf, notes FROM (SELECT merchant, min(gold_leaf) AS leaf, arg_min(notes, row_no) FILTER (trim(coalesce(notes, '')) <> '') AS notes
FROM gold_rows GROUP BY 1 HAVING count(DISTINCT gold_leaf) = 1) x WHERE notes IS NOT NULL AND NOT regexp_matches(merchant,
'gear|bolt') AND leaf NOT IN ('salary', 'refund_received') AND merchant NOT IN (SELECT merchant FROM dictionary)
""")
def f9(fx):
    return Q.promotable(fx.gold_rows, fx.dictionary, "gear|bolt", ["salary", "refund_received"])


@query("f8_f10_accepted_valid", """
SELECT b.merchant, b.final_leaf AS leaf FROM broken b WHERE tier IN ('auto_accept', 'accepted', 'accepted_tiebreak') AND final_leaf IN (SELECT leaf
FROM taxonomy)
""", **_G)
def f8(fx):
    rows = broken(fx).where(F.col("tier").isin("auto_accept", "accepted", "accepted_tiebreak")).select("merchant", F.col("final_leaf").alias("leaf"))
    return rows.join(fx.taxonomy.select("leaf"), "leaf", "left_semi").select("merchant", "leaf")


@query("a8_label_conflicts", "SELECT merchant, count(DISTINCT gold_leaf) AS leaves, count(DISTINCT gold_leaf) > 1 AS conflicting FROM gold_rows GROUP BY 1")
def a8(fx):
    return fx.gold_rows.groupBy("merchant").agg(F.countDistinct("gold_leaf").alias("leaves")).withColumn("conflicting", F.col("leaves") > 1)


@query("a9_established", "SELECT merchant, min(gold_leaf) AS leaf FROM gold_rows GROUP BY 1 HAVING count(DISTINCT gold_leaf) = 1")
def a9(fx):
    return fx.gold_rows.groupBy("merchant").agg(F.countDistinct("gold_leaf").alias("n"), F.min("gold_leaf").alias("leaf")).where("n = 1").drop("n")
