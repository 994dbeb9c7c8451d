"""Features of applicants' transactions and what they tell about a binary outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.tables import materialised, quantiles, running_sums


def _round(c: Column, n: int = 4) -> Column:
    return F.round(c, n)


def applicant_aggs(df: DataFrame) -> DataFrame:
    """Count, sum, mean, deviation, skew (population) and trend (slope per day) of each applicant's amounts."""
    days = F.unix_date(F.to_date("ts")).cast("double")
    m = df.groupBy("applicant").agg(F.count("*").alias("n"), F.sum("amount").alias("s"), F.avg("amount").alias("m"), F.stddev_pop("amount").alias("d"), F.skewness("amount").alias("k"), F.regr_slope("amount", days).alias("t"))
    return m.select("applicant", "n", _round(F.col("s"), 2).alias("total"), _round(F.col("m"), 8).alias("mean"), _round(F.col("d")).alias("deviation"), _round(F.when(F.col("n") > 2, F.col("k"))).alias("skew"), _round(F.col("t")).alias("trend"))


def modal_category(df: DataFrame, key: str, col: str) -> DataFrame:
    counts = df.groupBy(key, col).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col(col).asc_nulls_last())
    return counts.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select(key, F.col(col).alias("mode"), "n")


def deep_features(df: DataFrame, leaves: list[str]) -> DataFrame:
    """Mean days since the transaction before, weekend share, months seen, and the amount of each wanted leaf."""
    order = Window.partitionBy("applicant").orderBy("ts", "amount")
    gap = F.date_diff(F.to_date("ts"), F.to_date(F.lag("ts").over(order)))
    rows = df.withColumn("gap", gap)
    return rows.groupBy("applicant").agg(
        _round(F.avg("gap")).alias("mean_gap"),
        _round(F.avg((F.weekday("ts") >= 5).cast("int"))).alias("weekend_share"),
        F.countDistinct(F.trunc("ts", "month")).alias("months"),
        *[_round(F.sum(F.when(F.col("leaf") == leaf, F.col("amount")).otherwise(0.0)), 2).alias(f"sum_{leaf}") for leaf in leaves],
    )


def as_of_eval(df: DataFrame, evals: DataFrame, lookback_days: int | None = None) -> DataFrame:
    """Transactions before each applicant's evaluation time, at most ``lookback_days`` before it."""
    rows = df.join(evals, "applicant").where(F.col("ts") < F.col("eval_ts"))
    if lookback_days is not None:
        rows = rows.where(F.col("ts") >= F.col("eval_ts") - F.make_dt_interval(days=F.lit(lookback_days)))
    return rows


def woe_iv(df: DataFrame, feature: str, target: str, bins: int, smooth: float = 0.5) -> DataFrame:
    """Weight of evidence and information value by quantile bin; nulls have a bin (-1) of their own.

    The cut points are exact percentiles from counts of values in order; rows are binned by comparison with them.
    """
    cuts = [c for c in quantiles(df, feature, [k / bins for k in range(1, bins)]) if c is not None]
    above = sum((F.when(F.col(feature) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    each = df.withColumn("bin", F.when(F.col(feature).isNull(), -1).otherwise(above)).groupBy("bin").agg(F.count("*").alias("n"), F.sum(target).alias("bad"))
    whole = Window.partitionBy()
    bad, good = F.col("bad") + smooth, F.col("n") - F.col("bad") + smooth
    each = each.withColumns({"_b": bad / F.sum(bad).over(whole), "_g": good / F.sum(good).over(whole)})
    woe = F.log(F.col("_g") / F.col("_b"))
    return each.select("bin", "n", "bad", _round(woe, 6).alias("woe"), _round((F.col("_g") - F.col("_b")) * woe, 6).alias("iv"))


def iv_by_form(df: DataFrame, outcomes: DataFrame, leaf: str, as_of: str, horizons: list[int], target: str, bins: int = 4) -> DataFrame:
    """``form, horizon, iv``: information value of one category's signal forms over the months before a date.

    Persistence is the number of months in which the category stands, frequency the number of its transactions; an
    applicant without any in the horizon has no value, which is a bin of its own.
    """
    month = F.months_between(F.trunc(F.lit(as_of).cast("date"), "month"), F.trunc("ts", "month")).cast("int")
    rows = df.where((F.col("leaf") == leaf) & (F.col("ts") < F.lit(as_of).cast("timestamp"))).withColumn("ago", month)
    monthly = rows.groupBy("applicant", "ago").agg(F.count("*").alias("k"))
    within = lambda h: F.col("ago") <= h
    forms = [(form, h) for h in horizons for form in ("persistence", "frequency")]
    aggs = [F.nullif(F.count_if(within(h)) if form == "persistence" else F.coalesce(F.sum(F.when(within(h), F.col("k"))), F.lit(0)), F.lit(0)).alias(f"{form}_{h}") for form, h in forms]
    table = materialised(outcomes.select("applicant", target).join(monthly.groupBy("applicant").agg(*aggs), "applicant", "left"), "forms")
    out = None
    for form, h in forms:
        one = woe_iv(table, f"{form}_{h}", target, bins).agg(_round(F.sum("iv"), 4).alias("iv")).select(F.lit(form).alias("form"), F.lit(h).alias("horizon"), "iv")
        out = one if out is None else out.unionByName(one)
    return out


def live_rate(df: DataFrame, features: list[str]) -> DataFrame:
    """Share of rows that are neither null nor zero, and whether the column is constant, in one pass."""
    aggs = []
    for f in features:
        aggs += [F.avg((F.coalesce(F.col(f), F.lit(0)) != 0).cast("int")).alias(f"{f}_r"), (F.min(f).eqNullSafe(F.max(f))).alias(f"{f}_c")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), _round(F.col(f"{f}_r"), 6).alias("live"), F.col(f"{f}_c").alias("constant")) for f in features])
    return one.select(F.inline(rows))


def redundant_pairs(df: DataFrame, features: list[str], least: float) -> DataFrame:
    """Pairs of features whose correlation is at least ``least`` in size, in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _round(F.col(f"{a}__{b}")).alias("r")) for a, b in pairs])
    return one.select(F.inline(rows)).where(F.abs("r") >= least)


#: Transactions of a part of the applicants at most, on average.
PART_ROWS = 100_000


def named_features(df: DataFrame, recent_days: int = 35, rows: int | None = None) -> DataFrame:
    """Named features of each applicant from rows with merchant, leaf, general, necessity, direction, amount, ts.

    One exchange by applicant for the sums: transactions are summed by applicant, leaf, month and merchant, and all else follows from
    those sums.  Recent is counted back from an applicant's last transaction.  The windows and sums of a task hold its
    part of the applicants, so the number of parts follows the number of ``rows`` (counted if it is not known); the distinct
    counts after them take two exchanges of the usual width.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(df.count() if rows is None else rows) // PART_ROWS))
    df = df.select("applicant", "merchant", "leaf", "necessity", "direction", "amount", "ts").repartition(parts, "applicant")
    debit, amount = F.col("direction") == "debit", F.abs("amount")
    last = F.max("ts").over(Window.partitionBy("applicant"))
    ago = F.date_diff(F.to_date(F.col("_last")), F.to_date("ts"))
    spent_within = lambda days: F.sum(F.when(debit & (ago < days), amount).otherwise(0.0))
    fine = df.withColumn("_last", last).groupBy("applicant", "leaf", F.trunc("ts", "month").alias("mth"), "merchant").agg(
        F.sum(F.when(debit, amount).otherwise(0.0)).alias("spent"),
        F.count_if(debit).alias("debits"),
        F.sum(F.when(debit & (F.col("necessity") == "essential"), amount).otherwise(0.0)).alias("essential"),
        F.sum(F.when((F.col("leaf") == "transfer_p2p") & ~debit, amount).otherwise(0.0)).alias("p2p"),
        F.sum(F.when(F.col("leaf") == "salary", amount).otherwise(0.0)).alias("salary"),
        F.sum(F.when(~debit, amount)).alias("credit"),
        F.count_if(~debit & F.col("amount").isNotNull()).alias("credits"),
        F.count_if((F.col("leaf") == "refund_received")).alias("returned"),
        F.count_if((F.col("leaf") == "salary") & (ago < recent_days)).alias("salary_recent"),
        spent_within(30).alias("spent_30"),
        spent_within(90).alias("spent_90"),
    )
    # Sums over leaves and months beside each row: squares of these follow without grouping once more.
    of_leaf, of_month = (F.sum("spent").over(Window.partitionBy("applicant", c)) for c in ("leaf", "mth"))
    fine = fine.withColumns({"of_leaf": of_leaf, "of_month": of_month})
    base = fine.groupBy("applicant").agg(
        *[F.sum(c).alias(c) for c in ("spent", "essential", "p2p", "salary", "credit", "credits", "returned", "salary_recent", "spent_30", "spent_90")],
        F.sum(F.col("spent") * F.col("of_leaf")).alias("by_leaf"),
        F.sum(F.col("spent") * F.col("of_month")).alias("by_month"),
        F.countDistinct("leaf").alias("categories"),
        F.countDistinct("merchant").alias("merchants"),
        F.countDistinct(F.when(F.col("debits") > 0, F.col("mth"))).alias("debit_months"),
        F.countDistinct(F.when(F.col("leaf") == "salary", F.col("mth"))).alias("months_salary"),
        F.countDistinct(F.when(F.col("leaf") == "groceries", F.col("mth"))).alias("months_groceries"),
        F.min("mth").alias("first"),
        F.max("mth").alias("latest"),
    )
    none = F.lit(0.0)
    mean = F.col("spent") / F.nullif(F.col("debit_months"), F.lit(0))
    deviation = F.sqrt(F.greatest(none, F.col("by_month") / F.nullif(F.col("debit_months"), F.lit(0)) - mean * mean))
    return base.select(
        "applicant",
        "categories",
        "merchants",
        "months_salary",
        "months_groceries",
        _round(F.col("by_leaf") / F.nullif(F.col("spent") * F.col("spent"), none)).alias("hhi"),
        _round(F.col("essential") / F.nullif(F.col("spent"), none)).alias("essential_ratio"),
        _round(F.col("essential"), 2).alias("essential_amount"),
        _round(F.col("p2p") / F.nullif(F.col("salary"), none)).alias("p2p_to_salary"),
        _round(F.col("credit") / F.nullif(F.col("credits"), F.lit(0)), 6).alias("mean_credit"),
        F.months_between("latest", "first").cast("int").alias("history_months"),
        _round(deviation / F.nullif(mean, none), 3).alias("monthly_cv"),
        (F.col("salary_recent") > 0).alias("recent_salary"),
        "returned",
        _round(F.col("spent_30") / F.nullif(F.col("spent_90"), none)).alias("ratio_30_90"),
    )


def auc_ks(df: DataFrame, score: str, target: str) -> DataFrame:
    """Area under the curve and Kolmogorov-Smirnov distance; rows of one score are counted before the running sums."""
    each = df.groupBy(score).agg(F.sum(target).alias("bad"), F.count("*").alias("n")).withColumn("good", F.col("n") - F.col("bad"))
    run = running_sums(each, [score], _b="bad", _g="good")
    whole = each.agg(F.sum("bad").alias("_tb"), F.sum("good").alias("_tg"))
    run = run.crossJoin(F.broadcast(whole))  # one row
    area = F.sum(F.col("bad") * (F.col("_g") - F.col("good") / 2)) / F.nullif(F.max("_tb") * F.max("_tg"), F.lit(0))
    return run.agg(_round(area, 6).alias("auc"), _round(F.max(F.abs(F.col("_b") / F.nullif(F.col("_tb"), F.lit(0)) - F.col("_g") / F.nullif(F.col("_tg"), F.lit(0)))), 6).alias("ks"))
