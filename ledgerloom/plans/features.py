"""Queries of report blocks, chat rows, risk features, normalisation, text models and windows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import binning as BN
from ledgerloom.operators import boosting as B
from ledgerloom.operators import normalise as N
from ledgerloom.operators import risk as R
from ledgerloom.operators import sgd as G
from ledgerloom.operators import softmax as L
from ledgerloom.operators import text_trees as T
from ledgerloom.operators import textml as M
from ledgerloom.operators import waterfall as W
from ledgerloom.operators import words as X
from ledgerloom.plans.feeds import CAT_A, CAT_B, FEED_A, MAPS, _MA, a, b
from ledgerloom.plans.registry import query
from ledgerloom.sources import blocks, tables
from ledgerloom.streaming.feeds import event_windows

_BLOCK = "SELECT id, searched, unnest(regexp_extract_all(response_xml, '(?s)<transactions>(.*?)</transactions>', 1)) AS block FROM blocks"
_FIELDS = "SELECT id, searched, " + ", ".join(f"nullif(regexp_extract(block, '(?s)<{t}>(.*?)</{t}>', 1), '') AS {t}" for t in ("merchant", "amount")) + ", nullif(regexp_extract(block, '(?s)<at>(.*?)</at>', 1), '') AS booked_at" + " FROM bl"
_X = {"bl": _BLOCK, "fields": _FIELDS}


def fields(fx):
    return blocks.extract_fields(blocks.explode_blocks(fx.blocks, "response_xml", "transactions"), {"merchant": "merchant", "amount": "amount", "booked_at": "at"})


@query("s5_s6_blocks", "SELECT id, merchant, amount, booked_at FROM fields", **_X)
def s5(fx):
    return fields(fx).drop("searched")


@query("p8_p10_typed_blocks", """
SELECT id, merchant, TRY_CAST(amount AS DOUBLE) AS amount, TRY_CAST(CASE WHEN booked_at LIKE '%+00:00' THEN replace(substr(booked_at, 1, 23), 'T',
' ') END AS TIMESTAMP) AS booked_at, sha256(CAST(id AS VARCHAR) || '|' || coalesce(merchant, '') || '|' || coalesce(amount,
'') || '|' || coalesce(booked_at, '')) AS key FROM fields
""", **_X)
def p8(fx):
    return blocks.typed_transactions(fields(fx))


@query("w2_latest_row", """
SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
FROM orders) x WHERE rn = 1
""")
def w2(fx):
    return blocks.latest_row(fx.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


def chat(fx):
    rows = a(fx).select(F.col("vendor").alias("merchant"), F.col("description_raw").alias("description"), S.abs_amount(F.col("amount")).alias("amount"), "direction", F.coalesce("sub", F.lit("none")).alias("leaf"))
    return tables.chat_rows(rows, "Label the transaction.")


@query("s8_s9_chat_round_trip", """
SELECT coalesce(vendor, 'n/a') AS merchant, description_raw AS description, round(abs(amount), 2) AS amount, CASE WHEN direction = 'credit' THEN 1
ELSE 0 END AS is_credit, coalesce(sub, 'none') AS leaf FROM feed_a
""", feed_a=FEED_A)
def s9(fx):
    return tables.parse_chat(chat(fx))


def applicants(fx):
    rows = W.attach_metadata(W.categorise_a(a(fx), fx.seeds()), fx.taxonomy)
    return rows.select("applicant", S.norm_merchant(F.col("vendor")).alias("merchant"), "leaf", "general", "necessity", "direction", "amount", "ts")


_APP = f"SELECT applicant, {_MA} AS merchant, c.leaf, t.general, t.necessity, direction, amount, ts FROM cat_a c LEFT JOIN taxonomy t ON c.leaf = t.leaf"
_R = {**MAPS, "cat_a": CAT_A, "app": _APP}


@query(
    "r1_applicant_aggs",
    """
SELECT applicant, count(*) AS n, round(sum(amount), 2) AS total, round(avg(amount), 8) AS mean, round(stddev_pop(amount), 4) AS deviation,
  round(CASE WHEN count(*) > 2 AND avg((amount - m) * (amount - m)) > 0 THEN avg(power(amount - m, 3)) / power(avg((amount - m) * (amount - m)), 1.5) END, 4) AS skew,
  round(regr_slope(amount, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS DOUBLE)), 4) AS trend
FROM (SELECT *, avg(amount) OVER (PARTITION BY applicant) AS m FROM raw_a) x GROUP BY 1
""",
)
def r1(fx):
    return R.applicant_aggs(a(fx))


@query("r1_modal_category", """
SELECT applicant, mode, n FROM (SELECT applicant, leaf AS mode, count(*) AS n, row_number() OVER (PARTITION BY applicant
ORDER BY count(*) DESC, leaf ASC NULLS LAST) AS rn FROM app GROUP BY 1, 2) x WHERE rn = 1
""", **_R)
def r1m(fx):
    return R.modal_category(applicants(fx), "applicant", "leaf")


@query("r2_deep_features", """
SELECT applicant, round(avg(gap), 4) AS mean_gap, round(avg(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1.0
ELSE 0.0 END), 4) AS weekend_share, count(DISTINCT date_trunc('month', ts)) AS months, round(sum(CASE WHEN leaf = 'salary' THEN amount
ELSE 0 END), 2) AS sum_salary, round(sum(CASE WHEN leaf = 'groceries' THEN amount ELSE 0 END), 2) AS sum_groceries
FROM (SELECT *, date_diff('day', CAST(lag(ts) OVER (PARTITION BY applicant ORDER BY ts, amount) AS DATE), CAST(ts AS DATE)) AS gap FROM app) x
GROUP BY 1
""", **_R)
def r2(fx):
    return R.deep_features(applicants(fx), ["salary", "groceries"])


def evals(fx):
    return fx.orders.groupBy(F.col("o_custkey").alias("applicant")).agg(F.max("o_orderdate").alias("eval_ts"))


@query("r3_as_of_eval", """
SELECT applicant, count(*) AS n, round(sum(amount), 2) AS total FROM raw_a JOIN (SELECT o_custkey AS applicant, max(o_orderdate) AS eval_ts
FROM orders GROUP BY 1) e USING (applicant) WHERE ts < eval_ts AND ts >= eval_ts - INTERVAL 365 DAY GROUP BY 1
""")
def r3(fx):
    return R.as_of_eval(a(fx), evals(fx), 365).groupBy("applicant").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


def outcome(fx):
    """Amount and count features of each customer, null for those without transactions, with a negative balance as the outcome."""
    base = a(fx).groupBy("applicant").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.sum(F.when(F.col("direction") == "credit", F.col("amount")).otherwise(0)), 2).alias("credits"))
    bad = (F.col("c_acctbal") < 0).cast("int").alias("bad")
    return fx.customer.select(F.col("c_custkey").alias("applicant"), bad).join(base, "applicant", "left")


_OUT = """
SELECT c_custkey AS applicant, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS bad, n, total, credits FROM customer LEFT
JOIN (SELECT applicant, count(*) AS n, round(sum(Amount), 2) AS total, round(sum(CASE WHEN TransactionTypeId = 1 THEN Amount
ELSE 0 END), 2) AS credits FROM raw_a GROUP BY 1) f ON c_custkey = applicant
"""


@query(
    "r4_woe_iv",
    """
SELECT bin, n, CAST(bad AS BIGINT) AS bad, round(ln(g / b), 6) AS woe, round((g - b) * ln(g / b), 6) AS iv
FROM (SELECT bin, n, bad, (bad + 0.5) / sum(bad + 0.5) OVER () AS b, (n - bad + 0.5) / sum(n - bad + 0.5) OVER () AS g
FROM (SELECT bin, count(*) AS n, sum(bad) AS bad FROM (SELECT bad, CASE WHEN total IS NULL THEN -1
ELSE CAST(total > c1 AS INTEGER) + CAST(total > c2 AS INTEGER) + CAST(total > c3 AS INTEGER) END AS bin
FROM outcome, (SELECT quantile_cont(total, 0.25) AS c1, quantile_cont(total, 0.5) AS c2, quantile_cont(total, 0.75) AS c3 FROM outcome) q) x
GROUP BY 1) y) z
""",
    outcome=_OUT,
)
def r4(fx):
    return R.woe_iv(outcome(fx), "total", "bad", 4)


#: Every way to merge ten quantile bins, as a mask of the edges that stay.
_FINE = """
SELECT dense_rank() OVER (ORDER BY bin) - 1 AS i, bin, n, bad FROM (
  SELECT bin, count(*) AS n, sum(bad) AS bad FROM (
    SELECT bad, len(list_filter(cuts, lambda c: c < total)) AS bin FROM outcome,
      (SELECT quantile_cont(total, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM outcome) q WHERE total IS NOT NULL
  ) x GROUP BY 1
) y
"""
_WAYS = """
SELECT mask, seg, min(bin) AS first_bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM (
  SELECT mask, bin, n, bad, bit_count(CAST(mask & ((1 << CAST(i AS INTEGER)) - 1) AS INTEGER)) AS seg
  FROM fine, (SELECT unnest(range(0, 512)) AS mask) m WHERE mask < (SELECT 1 << CAST(max(i) AS INTEGER) FROM fine)
) x GROUP BY 1, 2
"""
_SEGMENTS = """
SELECT *, (bad + 0.5) / (tb + 0.5) AS b, (n - bad + 0.5) / (tn - tb + 0.5) AS g, bad / n AS rate,
  bad / n - lag(bad / n) OVER (PARTITION BY mask ORDER BY seg) AS step FROM ways, (SELECT sum(n) AS tn, sum(bad) AS tb FROM (SELECT 1 AS n, bad FROM outcome) o) t
"""
_BEST = """
SELECT mask FROM segments GROUP BY mask HAVING min(n) >= 0.05 * (SELECT sum(n) FROM fine) AND (coalesce(min(step), 1) > 0 OR coalesce(max(step), -1) < 0)
ORDER BY round(sum((g - b) * ln(g / b)), 9) DESC, count(*), mask LIMIT 1
"""


@query("r4_optimal_bins", """
SELECT seg AS bin, n, bad, round(ln(g / b), 6) AS woe, round((g - b) * ln(g / b), 6) AS iv FROM segments JOIN best USING (mask)
UNION ALL SELECT -1, n, bad, round(ln(g / b), 6), round((g - b) * ln(g / b), 6)
FROM (SELECT n, bad, (bad + 0.5) / (tb + 0.5) AS b, (n - bad + 0.5) / (tn - tb + 0.5) AS g
  FROM (SELECT count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM outcome WHERE total IS NULL) z, (SELECT count(*) AS tn, sum(bad) AS tb FROM outcome) t WHERE n > 0) w
""", outcome=_OUT, fine=_FINE, ways=_WAYS, segments=_SEGMENTS, best=_BEST)
def r4o(fx):
    """Monotone bins of greatest information value, each of a twentieth of the rows or more, out of ten quantile bins."""
    return BN.optimal_bins(outcome(fx), "total", "bad", fine=10).drop("low", "high")


_FEATURES = ("n", "total", "credits", "mean", "share")
_MORE = "SELECT *, total / n AS mean, credits / nullif(total, 0) AS share FROM outcome"
_IVS = {f"iv_{f}": f"""
SELECT '{f}' AS feature, round(sum(round((g - b) * ln(g / b), 6)), 6) AS iv FROM (
  SELECT (bad + 0.5) / sum(bad + 0.5) OVER () AS b, (n - bad + 0.5) / sum(n - bad + 0.5) OVER () AS g FROM (
    SELECT count(*) AS n, sum(bad) AS bad, CASE WHEN {f} IS NULL THEN -1 ELSE CAST({f} > c1 AS INTEGER) + CAST({f} > c2 AS INTEGER) + CAST({f} > c3 AS INTEGER) END AS bin
    FROM more, (SELECT quantile_cont({f}, 0.25) AS c1, quantile_cont({f}, 0.5) AS c2, quantile_cont({f}, 0.75) AS c3 FROM more) q GROUP BY 3
  ) x
) y
""" for f in _FEATURES}
_CORR = " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS r FROM more" for x in _FEATURES for y in _FEATURES if x != y)
_RANKED = "SELECT feature, iv, row_number() OVER (ORDER BY iv DESC, feature) AS rn, list(b) FILTER (abs(r) >= 0.6) AS near FROM (" + " UNION ALL ".join(f"SELECT * FROM iv_{f}" for f in _FEATURES) + ") v JOIN corrs ON a = feature GROUP BY 1, 2"
_GREEDY = """
SELECT rn, feature, iv, near, CASE WHEN false THEN near ELSE [feature] END AS kept FROM ranked WHERE rn = 1
UNION ALL SELECT k.rn, k.feature, k.iv, k.near, CASE WHEN list_has_any(coalesce(k.near, []), g.kept) THEN g.kept ELSE list_append(g.kept, k.feature) END
FROM greedy g JOIN ranked k ON k.rn = g.rn + 1
"""


@query("r7_choice", f"""
SELECT feature, iv, list_contains(kept, feature) AS kept, CASE WHEN NOT list_contains(kept, feature) THEN (SELECT feature FROM ranked r
WHERE list_contains(near, g.feature) AND list_contains(g.kept, r.feature) ORDER BY rn LIMIT 1) END AS because FROM (WITH RECURSIVE greedy AS ({_GREEDY}) SELECT * FROM greedy) g
""", outcome=_OUT, more=_MORE, **_IVS, corrs=_CORR, ranked=_RANKED)
def r7c(fx):
    """Features by falling information value; one that is close to a kept one goes, with the reason."""
    more = outcome(fx).withColumns({"mean": F.col("total") / F.col("n"), "share": F.col("credits") / F.nullif(F.col("total"), F.lit(0.0))})
    return BN.choose_features(more, list(_FEATURES), "bad", 0.6).drop("r")



_END, _HORIZONS = "2001-06-01", [12, 36]


def _iv_sql(form: str, horizon: int) -> str:
    """Information value of one form and horizon over the quartiles of its values."""
    value = f"nullif(count(*) FILTER (ago <= {horizon}), 0)" if form == "persistence" else f"nullif(CAST(coalesce(sum(k) FILTER (ago <= {horizon}), 0) AS BIGINT), 0)"
    return f"""
SELECT '{form}' AS form, {horizon} AS horizon, round(sum(iv), 4) AS iv
FROM (
  SELECT round((g - b) * ln(g / b), 6) AS iv
  FROM (
    SELECT (bad + 0.5) / sum(bad + 0.5) OVER () AS b, (n - bad + 0.5) / sum(n - bad + 0.5) OVER () AS g
    FROM (
      SELECT count(*) AS n, sum(bad) AS bad,
        CASE WHEN v IS NULL THEN -1 ELSE CAST(v > c1 AS INTEGER) + CAST(v > c2 AS INTEGER) + CAST(v > c3 AS INTEGER) END AS bin
      FROM {form}_{horizon}, (
        SELECT quantile_cont(v, 0.25) AS c1, quantile_cont(v, 0.5) AS c2, quantile_cont(v, 0.75) AS c3 FROM {form}_{horizon}
      ) q GROUP BY 3
    ) x
  ) y
) z
""", f"SELECT o.applicant, o.bad, f.v FROM outcome o LEFT JOIN (SELECT applicant, {value} AS v FROM monthly GROUP BY 1) f USING (applicant)"


_FORMS = {f"{form}_{h}": _iv_sql(form, h) for h in _HORIZONS for form in ("persistence", "frequency")}
_MONTHLY = f"""
SELECT applicant, date_diff('month', date_trunc('month', ts), DATE '{_END}') AS ago, count(*) AS k FROM app
WHERE leaf = 'groceries' AND ts < TIMESTAMP '{_END}' GROUP BY 1, 2
"""


@query("r10_iv_by_form", " UNION ALL ".join(sql for sql, _ in _FORMS.values()), **_R, outcome=_OUT, monthly=_MONTHLY, **{name: table for name, (_, table) in _FORMS.items()})
def r10(fx):
    return R.iv_by_form(applicants(fx), outcome(fx), "groceries", _END, _HORIZONS, "bad")


@query("r6_live_rate", """
SELECT 'n' AS feature, round(avg(CASE WHEN coalesce(n, 0) <> 0 THEN 1.0 ELSE 0.0 END), 6) AS live, min(n) IS NOT DISTINCT FROM max(n) AS constant
FROM outcome UNION ALL SELECT 'credits', round(avg(CASE WHEN coalesce(credits, 0) <> 0 THEN 1.0 ELSE 0.0 END), 6), min(credits) IS NOT DISTINCT
FROM max(credits) FROM outcome
""", outcome=_OUT)
def r6(fx):
    return R.live_rate(outcome(fx), ["n", "credits"])


@query("r7_redundant_pairs", """
SELECT a, b, r FROM (SELECT 'n' AS a, 'total' AS b, round(corr(n, total), 4) AS r FROM outcome
UNION ALL SELECT 'n', 'credits', round(corr(n, credits), 4) FROM outcome UNION ALL SELECT 'total', 'credits', round(corr(total, credits), 4)
FROM outcome) x WHERE abs(r) >= 0.3
""", outcome=_OUT)
def r7(fx):
    return R.redundant_pairs(outcome(fx), ["n", "total", "credits"], 0.3)


@query(
    "r8_named_features",
    """
SELECT s.applicant, s.categories, b.merchants, b.months_salary, b.months_groceries,
  round(s.q / nullif(s.t * s.t, 0), 4) AS hhi, round(b.essential / nullif(s.t, 0), 4) AS essential_ratio, round(b.essential, 2) AS essential_amount,
  round(b.p2p / nullif(b.salary, 0), 4) AS p2p_to_salary, round(b.credit, 6) AS mean_credit, b.history_months, round(v.cv, 3) AS monthly_cv,
  b.recent_salary, b.returned, round(b.d30 / nullif(b.d90, 0), 4) AS ratio_30_90
FROM (
  SELECT applicant, sum(spent) AS t, sum(spent * spent) AS q, count(DISTINCT leaf) AS categories
  FROM (SELECT applicant, leaf, sum(CASE WHEN direction = 'debit' THEN abs(amount) ELSE 0 END) AS spent FROM app GROUP BY 1, 2) l GROUP BY 1
) s
JOIN (
  SELECT applicant, count(DISTINCT merchant) AS merchants,
    count(DISTINCT CASE WHEN leaf = 'salary' THEN date_trunc('month', ts) END) AS months_salary,
    count(DISTINCT CASE WHEN leaf = 'groceries' THEN date_trunc('month', ts) END) AS months_groceries,
    sum(CASE WHEN direction = 'debit' AND necessity = 'essential' THEN abs(amount) ELSE 0 END) AS essential,
    sum(CASE WHEN leaf = 'transfer_p2p' AND direction <> 'debit' THEN abs(amount) ELSE 0 END) AS p2p,
    sum(CASE WHEN leaf = 'salary' THEN abs(amount) ELSE 0 END) AS salary, avg(CASE WHEN direction <> 'debit' THEN abs(amount) END) AS credit,
    date_diff('month', min(ts), max(ts)) AS history_months,
    count(*) FILTER (leaf = 'salary' AND ago < 35) > 0 AS recent_salary, count(*) FILTER (leaf = 'refund_received') AS returned,
    sum(CASE WHEN direction = 'debit' AND ago < 30 THEN abs(amount) ELSE 0 END) AS d30,
    sum(CASE WHEN direction = 'debit' AND ago < 90 THEN abs(amount) ELSE 0 END) AS d90
  FROM (SELECT *, date_diff('day', CAST(ts AS DATE), CAST(max(ts) OVER (PARTITION BY applicant) AS DATE)) AS ago FROM app) w GROUP BY 1
) b USING (applicant)
LEFT JOIN (
  SELECT applicant, stddev_pop(x) / avg(x) AS cv
  FROM (SELECT applicant, date_trunc('month', ts) AS mth, sum(abs(amount)) AS x FROM app WHERE direction = 'debit' GROUP BY 1, 2) m GROUP BY 1
) v USING (applicant)
""",
    **_R,
)
def r8(fx):
    return R.named_features(applicants(fx), rows=fx.lineitem.count())  # a transaction is a line at most


@query("r9_auc_ks", """
SELECT round(sum(bad * (g - good / 2.0)) / (max(tb) * max(tg)), 6) AS auc, round(max(abs(b / tb - g / tg)), 6) AS ks
FROM (SELECT bad, n - bad AS good, sum(bad) OVER (ORDER BY n_tx ROWS UNBOUNDED PRECEDING) AS b,
sum(n - bad) OVER (ORDER BY n_tx ROWS UNBOUNDED PRECEDING) AS g, sum(bad) OVER () AS tb, sum(n - bad) OVER () AS tg
FROM (SELECT coalesce(n, 0) AS n_tx, sum(bad) AS bad, count(*) AS n FROM outcome GROUP BY 1) y) x
""", outcome=_OUT)
def r9(fx):
    return R.auc_ks(outcome(fx).withColumn("n_tx", F.coalesce("n", F.lit(0))), "n_tx", "bad")


@query("n1_clean_merchant", """
SELECT DISTINCT transaction_name, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(trim(transaction_name)),
'\\b(pos|card|ref|txn)\\b[ :#]*[0-9a-z]*$', '')), '[ ]+[0-9]+$', ''), '\\s+', ' ', 'g')) AS cleaned FROM raw_b
""")
def n1(fx):
    cleaned = S.clean_merchant(F.regexp_replace(S.clean_merchant(F.col("transaction_name")), r"[ ]+[0-9]+$", ""))
    return fx.raw_b.select("transaction_name", cleaned.alias("cleaned")).distinct()


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({})), '\b(pos|card|ref|txn)\b[ :#]*[0-9a-z]*$', ''), '[ ]+[0-9]+$', ''), '\s+', ' ', 'g'))"
_STAGE = """
SELECT '{s}' AS stage, (SELECT count(DISTINCT {a}) FROM raw_a WHERE VendorDescription IS NOT NULL) AS left_keys, (SELECT count(DISTINCT {b})
FROM raw_b WHERE merchant_name IS NOT NULL) AS right_keys, (SELECT count(*) FROM (SELECT {a} FROM raw_a WHERE VendorDescription IS NOT NULL
INTERSECT SELECT {b} FROM raw_b WHERE merchant_name IS NOT NULL) x) AS common
"""


@query("n3_overlap", _STAGE.format(s="before", a="VendorDescription", b="merchant_name") + " UNION ALL " + _STAGE.format(s="after", a=_CLEAN.format("VendorDescription"), b=_CLEAN.format("merchant_name")))
def n3(fx):
    """Merchants of both feeds and those they share, as they come and after cleaning."""
    left, right = fx.raw_a.where("VendorDescription is not null").select(F.col("VendorDescription").alias("m")), fx.raw_b.where("merchant_name is not null").select(F.col("merchant_name").alias("m"))
    cleaned = lambda df: df.select(S.clean_merchant(F.col("m")).alias("m"))
    out = N.overlap(left, right).withColumn("stage", F.lit("before"))
    return out.unionByName(N.overlap(cleaned(left), cleaned(right)).withColumn("stage", F.lit("after")))


@query("n4_drift", """
SELECT date_trunc('month', ts) AS period, count(*) AS n, round(avg(CASE WHEN resolution_tier = 'T7_unclassified' THEN 1.0
ELSE 0.0 END), 6) AS fall_through, round(avg(CASE WHEN resolution_tier = 'T4_merchant_dictionary' THEN 1.0 ELSE 0.0 END), 6) AS dictionary FROM cat_b
GROUP BY 1
""", **MAPS, cat_b=CAT_B)
def n4(fx):
    return N.drift(W.categorise_b(b(fx), fx.seeds()), "month")


@query("n4_new_values", """
SELECT DISTINCT merchant_name FROM raw_b
WHERE ts >= TIMESTAMP '1995-03-15' AND merchant_name IS NOT NULL AND merchant_name NOT IN (SELECT merchant_name FROM raw_b
WHERE ts < TIMESTAMP '1995-03-15' AND merchant_name IS NOT NULL)
""")
def n4n(fx):
    return N.new_values(fx.raw_b.where("merchant_name is not null"), "merchant_name", "ts", "1995-03-15")


@query("n2_fuzzy_match", """
SELECT raw, canonical, edits FROM (SELECT raw, canonical, edits, row_number() OVER (PARTITION BY raw ORDER BY edits, canonical) AS rn
FROM (SELECT s.merchant AS raw, p.p_name AS canonical, CAST(levenshtein(s.merchant, p.p_name) AS INTEGER) AS edits
FROM strings s, (SELECT DISTINCT p_name FROM part) p) x WHERE edits <= least(4, length(canonical) // 3)) y WHERE rn = 1
""")
def n2(fx):
    return N.fuzzy_match(fx.strings.select("merchant"), fx.part.select("p_name").distinct())


_TRI = "SELECT {c} AS name, substr(' ' || {c} || ' ', i, 3) AS g, count(*) AS k FROM (SELECT {c}, unnest(range(1, greatest(1, length({c}) + 2 - 3 + 1) + 1)) AS i FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL) d) x GROUP BY 1, 2"
_IDF = "SELECT g, ln(1 + sum(count(*)) OVER () / count(*)) AS idf FROM (SELECT g FROM tri_a UNION ALL SELECT g FROM tri_b) x GROUP BY 1"
_UNIT = "SELECT name, g, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS w FROM (SELECT name, g, k * idf AS w FROM {t} JOIN idfs USING (g)) x"


@query("n2_similar_names", """
SELECT raw, canonical, similarity FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY similarity DESC, canonical) AS rn
FROM (SELECT x.name AS raw, y.name AS canonical, round(sum(x.w * y.w), 6) AS similarity FROM unit_a x JOIN unit_b y USING (g) GROUP BY 1, 2) p
WHERE similarity >= 0.6) q WHERE rn = 1
""", tri_a=_TRI.format(c="merchant", t="strings"), tri_b=_TRI.format(c="p_name", t="part"), idfs=_IDF, unit_a=_UNIT.format(t="tri_a"), unit_b=_UNIT.format(t="tri_b"))
def n2s(fx):
    return N.similar_names(fx.strings.select("merchant"), fx.part.select("p_name"))


_GRAMS = " UNION ALL ".join(f"SELECT unnest(list_transform(range(1, length(p) - {n} + 2), lambda i: substr(p, i, {n}))) AS g FROM words" for n in range(2, 6))


@query("m1_char_wb_ngrams", f"SELECT g, count(*) AS n FROM ({_GRAMS}) x GROUP BY 1", words="SELECT ' ' || unnest(string_split(p_name, ' ')) || ' ' AS p FROM part")
def m1(fx):
    grams = fx.part.select(F.explode(M.char_wb_ngrams(F.col("p_name"), 2, 5)).alias("g"))
    return grams.groupBy("g").agg(F.count("*").alias("n"))


@query("m5_class_weights", """
SELECT lang, n, round(least(100.0, sqrt(CAST(max(n) OVER () AS DOUBLE) / n)), 6) AS weight FROM (SELECT lang, count(*) AS n FROM documents
GROUP BY 1) x
""")
def m5(fx):
    return M.class_weights(fx.documents, "lang")


#: Rows of a part of the texts at most, on average.
PART_ROWS = 50_000
NUMERICS = ("log_amount", "is_credit")


def stored_texts(fx):
    """Transactions with their text and numbers, split by a hash of the text, stored once without n-grams."""
    t = S.model_text(F.col("vendor"), F.col("description_raw"))
    rows = a(fx).select(t.alias("t"), F.col("pri").alias("leaf"), S.log_amount(F.col("amount")).alias("log_amount"), S.is_credit(F.col("direction")).alias("is_credit"))
    return tables.materialised(rows.withColumn("fold", F.pmod(F.xxhash64("t"), F.lit(10))), "texts")


def texts(fx):
    """The transactions with their n-grams of 2 to 5 characters, which each pass makes anew from the words, over parts of
    rows: few bytes of text are many n-grams.
    """
    rows = stored_texts(fx)
    parts = max(int(fx.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    return M.with_grams(rows.repartition(parts), "t", 2, 5)


def _scored(out):
    return out.groupBy("leaf").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("leaf")).cast("int")), 4).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("confidence"))


def _leaves(rows):
    return [r[0] for r in rows.where("leaf is not null").select("leaf").distinct().orderBy("leaf").collect()]


@query("m2_m4_hashed_linear")
def m2(fx):
    """One class against the rest over 2^20 hashed places, by gradient descent in partitions."""
    rows, sgd = stored_texts(fx).withColumn("_t", F.lower("t")), G.Sgd()
    train = rows.where("fold > 1")
    numerics, grams, leaves = G.root_mean_squares(train, list(NUMERICS)), G.Hashed(2, 5, sgd.places), _leaves(train)
    weights = G.fit_texts(train, "leaf", leaves, numerics, grams, sgd)
    return _scored(G.predict_texts(rows.where("fold <= 1"), weights, leaves, ["leaf"], numerics, grams))


def tfidf_linear(fx):
    """The transactions by text, and a linear model of those that train."""
    rows = X.by_text(stored_texts(fx), "t")
    train = rows.where("fold > 1")
    return rows, L.fit(train, X.vocabulary(train, 2, 5), list(NUMERICS), "leaf", _leaves(train))


@query("m3_m7_tfidf_linear")
def m3(fx):
    rows, model = tfidf_linear(fx)
    return _scored(L.predict(rows.where((F.col("fold") <= 1) & F.col("leaf").isin(model.classes)), model, ["leaf"]))


@query("m9_top_terms")
def m9(fx):
    """The five n-grams that speak most for each class."""
    return fx.spark.createDataFrame(L.top_terms(tfidf_linear(fx)[1], 5), "leaf string, gram string, weight double")


@query("m5_trees")
def m5t(fx):
    """Weighted boosted trees that a tenth of the training rows stop; scored on rows they have not seen."""
    rows = X.by_text(stored_texts(fx), "t")
    train = rows.where("fold > 1")
    weight = {r.leaf: r.weight for r in M.class_weights(train.where("leaf is not null"), "leaf").orderBy("leaf").collect()}
    held = F.pmod(F.xxhash64("t", F.lit(1)), F.lit(10)) == 0
    trees = T.fit(train, list(NUMERICS), "leaf", weight, held, X.vocabulary(train, 2, 5), B.Boost(rounds=25, step=0.4))
    return _scored(T.predict(rows.where(F.col("fold") <= 1), trees, ["leaf"]))


@query("m6_embeddings")
def m6(fx):
    """The vectors with their length beside them."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = M.with_vector(fx.embeddings.withColumn("norm", norm), "embedding").select("vec_id", "vector", "norm", F.col("label").cast("string").alias("leaf"))
    model = M.fit_linear(rows.where("vec_id % 4 <> 0"), M.embedding_features(["norm"]), "leaf")
    return _scored(M.predict_top1(model, rows.where("vec_id % 4 = 0")))


@query("t2_event_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def t2(fx):
    return event_windows(fx.events)
