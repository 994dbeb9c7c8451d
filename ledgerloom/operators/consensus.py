"""Labels of several labellers: alignment, gating, tie-breaks, human verdicts and what is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESIDUAL = "unclassified_other"


def _said(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def align_labellers(base: DataFrame, preds: dict[str, DataFrame], key: str = "merchant") -> DataFrame:
    """Each labeller's leaf and confidence beside the base rows; a labeller without an answer gives nulls."""
    for name, df in preds.items():
        base = base.join(df.select(key, F.col("llm_leaf").alias(f"leaf_{name}"), F.col("llm_confidence").alias(f"conf_{name}")), key, "left")
    return base


def draft_label(df: DataFrame) -> DataFrame:
    """``draft``: agreed leaf, blank where the two differ, ``missing`` where one is absent."""
    both = _said("leaf_a") & _said("leaf_b")
    return df.withColumn("draft", F.when(~both, "missing").when(F.col("leaf_a") == F.col("leaf_b"), F.col("leaf_a")).otherwise(""))


def consensus_class(df: DataFrame, truth: str) -> DataFrame:
    """Rows that both attempted and did not abstain from: agree_right, agree_wrong or disagree."""
    rows = df.where(_said("leaf_a") & _said("leaf_b") & (F.col("leaf_a") != RESIDUAL) & (F.col("leaf_b") != RESIDUAL))
    same, right = F.col("leaf_a") == F.col("leaf_b"), F.col("leaf_a") == F.col(truth)
    return rows.withColumn("consensus", F.when(same & right, "agree_right").when(same, "agree_wrong").otherwise("disagree"))


def dispute_queue(df: DataFrame, truth: str, volume: str = "volume") -> DataFrame:
    """Rows whose labellers agree with each other but not with the provider, largest volume first."""
    return consensus_class(df, truth).where("consensus = 'agree_wrong'").orderBy(F.col(volume).desc(), "merchant")


def gate(df: DataFrame) -> DataFrame:
    """``tier`` and ``final_leaf`` from the first two labellers; the second one's confidence decides, missing is 0."""
    sure = F.coalesce("conf_b", F.lit(0.0))
    agree = _said("leaf_a") & F.coalesce(F.col("leaf_a") == F.col("leaf_b"), F.lit(False))
    tier = F.when(agree & (F.col("leaf_a") == RESIDUAL), "abstain_confirmed").when(agree & (sure >= 0.9), "auto_accept").when(agree & (sure >= 0.7), "accepted").otherwise("needs_review")
    leaf = F.when(_said("leaf_b"), F.col("leaf_b")).otherwise(F.coalesce("leaf_a", F.lit("")))
    return df.withColumns({"tier": tier, "confidence": sure}).withColumn("final_leaf", F.when(F.col("tier") == "abstain_confirmed", RESIDUAL).otherwise(leaf))


def tiebreak(gated: DataFrame, taxonomy: DataFrame, risky_generals: list[str]) -> DataFrame:
    """Third labeller over rows under review: it accepts a leaf only if one of the two gave it.

    With three different leaves: one shared general category accepts the second leaf, mixed risk stays under review
    (with the second leaf, which may be blank), anything else abstains.
    """
    meta = taxonomy.select(F.col("leaf").alias("_l"), "general", ((F.col("general").isin(risky_generals)) | (F.col("is_priority") == "true") | (F.col("is_age") == "true") | (F.col("is_debt") == "true")).alias("risk_flag"))
    for n in "abc":
        gated = gated.join(meta.withColumnsRenamed({"general": f"g_{n}", "risk_flag": f"r_{n}"}), F.col(f"leaf_{n}") == F.col("_l"), "left").drop("_l")
    third = (F.col("tier") == "needs_review") & _said("leaf_c")
    match = third & (F.coalesce(F.col("leaf_c") == F.col("leaf_a"), F.lit(False)) | F.coalesce(F.col("leaf_c") == F.col("leaf_b"), F.lit(False)))
    one_general = F.coalesce((F.col("g_a") == F.col("g_b")) & (F.col("g_b") == F.col("g_c")), F.lit(False))
    risks = F.array_distinct(F.array(*[F.coalesce(f"r_{n}", F.lit(False)) for n in "abc"]))
    kind = (
        F.when(match & (F.col("leaf_c") == RESIDUAL), "abstain_confirmed")
        .when(match, "accepted_tiebreak")
        .when(third & one_general, "accepted_general")
        .when(third & (F.size(risks) > 1), "needs_review")
        .when(third, "abstain_residual")
        .otherwise(F.col("tier"))
    )
    leaf = F.when(match, F.col("leaf_c")).when(third & (F.col("_tier") == "abstain_residual"), RESIDUAL).when(third, F.coalesce("leaf_b", F.lit(""))).otherwise(F.col("final_leaf"))
    out = gated.withColumn("_tier", kind).withColumn("final_leaf", leaf)
    return out.withColumn("tier", F.col("_tier")).drop("_tier", *[f"{x}_{n}" for x in "gr" for n in "abc"])


def fold_verdicts(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Human verdicts over rows still under review; a second run changes nothing."""
    v = verdicts.where("verdict <> ''").select("merchant", "verdict", "correct_leaf")
    df = labels.join(v, "merchant", "left")
    turn = (F.col("tier") == "needs_review") & F.col("verdict").isNotNull()
    leaf = F.when(F.col("verdict").isin("agreed", "first"), F.col("leaf_a")).when(F.col("verdict") == "second", F.col("leaf_b")).when(F.col("verdict") == "other", F.col("correct_leaf"))
    tier = F.when(F.col("verdict") == "context_dependent", "context_dependent").when(F.col("verdict") == "unsure", "abstain_human").otherwise("human_reviewed")
    return df.withColumns({"final_leaf": F.when(turn & F.col("verdict").isin("agreed", "first", "second", "other"), F.coalesce(leaf, F.lit(""))).when(turn, RESIDUAL).otherwise(F.col("final_leaf")), "tier": F.when(turn, tier).otherwise(F.col("tier"))}).drop("verdict", "correct_leaf")


#: Verdicts that give a gold leaf.
SCORING = ("agreed", "first", "second", "other", "unclassifiable")


def verdict_to_gold(aligned: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A gold leaf of every scoring verdict; where nothing can be known, abstaining is the right answer."""
    df = aligned.join(verdicts, "merchant")
    said = F.col("verdict")
    leaf = F.when(said.isin("agreed", "first"), F.col("leaf_a")).when(said == "second", F.col("leaf_b")).when(said == "other", F.col("correct_leaf")).when(said == "unclassifiable", RESIDUAL)
    return df.withColumn("gold_leaf", leaf).where("gold_leaf <> ''").select("merchant", "gold_leaf", F.col("verdict").alias("gold_source"))


def excluded_verdicts(verdicts: DataFrame) -> DataFrame:
    """How many verdicts give no gold leaf, by verdict; a missing one counts as blank."""
    said = F.when(F.coalesce("verdict", F.lit("")) == "", "blank").otherwise(F.col("verdict"))
    return verdicts.withColumn("verdict", said).where(~F.col("verdict").isin(*SCORING)).groupBy("verdict").agg(F.count("*").alias("n"))


def corrected_accuracy(classed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of agreed rows that are right once humans have judged the wrong ones, with bounds for those unjudged.

    ``agreed``, ``first`` and ``second`` verdicts confirm the agreed leaf; context-dependent rows leave the denominator.
    """
    df = classed.where("consensus <> 'disagree'").join(verdicts.select("merchant", "verdict"), "merchant", "left")
    wrong = F.col("consensus") == "agree_wrong"
    out = df.agg(
        F.count_if(~wrong).alias("right"),
        F.count_if(wrong & F.col("verdict").isin("agreed", "first", "second")).alias("confirmed"),
        F.count_if(wrong & (F.col("verdict") == "context_dependent")).alias("excluded"),
        F.count_if(wrong & F.coalesce(F.col("verdict").isin("", "unsure"), F.lit(True))).alias("open"),
        F.count("*").alias("rows"),
    )
    base = F.nullif(F.col("rows") - F.col("excluded"), F.lit(0))
    low = (F.col("right") + F.col("confirmed")) / base
    out = out.withColumns({"pessimistic": F.round(low, 6), "optimistic": F.round((F.col("right") + F.col("confirmed") + F.col("open")) / base, 6)})
    return go_no_go(out)


def go_no_go(bounds: DataFrame, go: float = 0.95, stop: float = 0.80) -> DataFrame:
    """go if both bounds reach ``go``, stop if both are under ``stop``, else undecided."""
    decision = F.when(F.col("pessimistic") >= go, "go").when(F.col("optimistic") < stop, "stop").otherwise("undecided")
    return bounds.withColumn("decision", decision)


def new_entries(verdicts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary additions: judged leaves of merchants that the dictionary lacks."""
    rows = verdicts.where("verdict = 'other' and correct_leaf <> ''").select("merchant", F.col("correct_leaf").alias("leaf"))
    return rows.join(dictionary.select("merchant"), "merchant", "left_anti")


def pairwise_agreement(a: DataFrame, b: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Keys both labelled, and the shares of equal leaves and equal general categories."""
    general = taxonomy.select("leaf", "general")
    one = a.where("llm_leaf <> ''").select("merchant", F.col("llm_leaf").alias("leaf")).join(general, "leaf", "left").withColumnsRenamed({"leaf": "l1", "general": "g1"})
    two = b.where("llm_leaf <> ''").select("merchant", F.col("llm_leaf").alias("leaf")).join(general, "leaf", "left").withColumnsRenamed({"leaf": "l2", "general": "g2"})
    same = lambda x, y: F.round(F.avg(F.expr(f"{x} <=> {y}").cast("int")), 6)
    return one.join(two, "merchant").agg(F.count("*").alias("n"), same("l1", "l2").alias("leaf"), same("g1", "g2").alias("general"))


def accept_agreed(aligned: DataFrame, target: str) -> DataFrame:
    """Counts of rows where both labellers agree, that are dropped, and that agree off the wanted leaf."""
    agree = _said("leaf_a") & F.coalesce(F.col("leaf_a") == F.col("leaf_b"), F.lit(False))
    return aligned.agg(F.count_if(agree).alias("accepted"), F.count_if(~agree).alias("dropped"), F.count_if(agree & (F.col("leaf_a") != F.col(target))).alias("off_target"))


def apply_review(rows: DataFrame, verdicts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Reviewed rows as gold, blank or invalid, counted."""
    df = rows.join(verdicts, "merchant", "left").join(taxonomy.select(F.col("leaf").alias("correct_leaf"), F.lit(1).alias("_k")), "correct_leaf", "left")
    kind = F.when(F.coalesce("correct_leaf", F.lit("")) == "", "blank").when(F.col("_k").isNull(), "invalid").otherwise("gold")
    return df.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def consensus_or_confident(aligned: DataFrame, least: float = 0.7) -> DataFrame:
    """Agreed leaf, else the second labeller's if it is confident, else none."""
    agree = _said("leaf_a") & F.coalesce(F.col("leaf_a") == F.col("leaf_b"), F.lit(False))
    return aligned.withColumn("chosen", F.when(agree, F.col("leaf_a")).when(_said("leaf_b") & (F.col("conf_b") >= least), F.col("leaf_b")))


def tier_stats(labels: DataFrame) -> DataFrame:
    """Strings and volume of each tier with their shares."""
    total = labels.agg(F.count("*").alias("_n"), F.sum("volume").alias("_v"))
    each = labels.groupBy("tier").agg(F.count("*").alias("n"), F.sum("volume").alias("volume")).crossJoin(F.broadcast(total))
    return each.select("tier", "n", "volume", F.round(100 * F.col("n") / F.col("_n"), 2).alias("pct"), F.round(100 * F.col("volume") / F.col("_v"), 2).alias("pct_volume"))


def reconcile(batch: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers given back by echoed index if the echoed text agrees or is unknown, else by echoed text."""
    known = batch.select(F.col("merchant").alias("_known")).distinct()
    said = answers.join(known, F.col("echo") == F.col("_known"), "left")
    by_index = batch.join(said, "idx").where((F.col("echo") == F.col("merchant")) | F.col("_known").isNull()).select("merchant", "answer", F.lit(0).alias("rank"))
    by_text = said.where(F.col("_known").isNotNull()).select(F.col("echo").alias("merchant"), "answer", F.lit(1).alias("rank"))
    every = by_index.unionByName(by_text).groupBy("merchant").agg(F.min(F.struct("rank", "answer")).alias("m"))
    return every.select("merchant", "m.answer")


def leaf_from_index(answers: DataFrame, leaf_numbers: DataFrame) -> DataFrame:
    """Leaves of 1-based places in the sorted list of leaves; places out of range drop out."""
    return answers.join(leaf_numbers.withColumn("place", F.col("leaf_no") + 1), "place").select("merchant", "leaf")
