"""Queries that write tables to the shared folder and read them back: seeds, evidence, reports, partitions, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import evidence as E
from ledgerloom.plans.feeds import _BY, CAT_B, MAPS, by
from ledgerloom.plans.labels import _K, keyed_b
from ledgerloom.operators.sampling import block_sample
from ledgerloom.plans.registry import query
from ledgerloom.sources import tables
from ledgerloom.sources.buckets import BucketTable
from ledgerloom.streaming.feeds import categorise_stream, run_to_end

#: Seeds whose fields hold commas, quotes, patterns, blanks and nulls.
SEED = """
SELECT p_partkey AS id, p_name || ', "' || p_brand || '" \\b(a|b, c)\\b' AS pattern, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS leaf FROM {part}
"""


@query("s3_seed_round_trip", SEED.replace("{part}", "part"))
def s3(fx):
    path = tables.work_path(fx.spark, "seed")
    fx.spark.sql(SEED.replace("\\", "\\\\"), part=fx.part).write.csv(path, header=True, quote='"', escape='"')
    return tables.read_seed(fx.spark, path, "id bigint, pattern string, leaf string")


@query(
    "s4_evidence_round_trip",
    """
SELECT k.m, round(avg(CASE WHEN direction = 'credit' THEN 1.0 ELSE 0.0 END), 2) AS pct_credit, round(quantile_cont(abs(amount), 0.5), 4) AS median_amount,
  min(t.cat) AS top_category, min(t.n) AS top_count
FROM keyed k JOIN (
  SELECT m, cat, n FROM (SELECT m, cat, count(*) AS n, row_number() OVER (PARTITION BY m ORDER BY count(*) DESC, cat ASC NULLS LAST) AS rn FROM keyed GROUP BY 1, 2) x WHERE rn = 1
) t ON k.m = t.m GROUP BY 1
""",
    **_K,
)
def s4(fx):
    path = tables.work_path(fx.spark, "evidence")
    E.evidence(keyed_b(fx)).write.json(path)
    top = F.col("cats")[0]
    return tables.read_evidence(fx.spark, path).select("m", "pct_credit", "median_amount", top["value"].alias("top_category"), top["count"].alias("top_count"))


@query("s7_parquet_round_trip", "SELECT merchant, gold_leaf, row_no, notes FROM gold_rows")
def s7(fx):
    path = tables.work_path(fx.spark, "training")
    tables.save(fx.gold_rows, path)
    return fx.spark.read.parquet(path)


@query("s10_ranked_csv", "SELECT merchant, volume FROM strings")
def s10(fx):
    path = tables.work_path(fx.spark, "ranked")
    tables.write_ranked_csv(fx.strings.select("merchant", "volume"), path, "volume", "merchant")
    return fx.spark.read.csv(path, header=True, schema="merchant string, volume bigint")


_MONTHS = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1"


@query("s11_incremental_overwrite", "SELECT CAST(day AS VARCHAR) AS day, n, CASE WHEN day >= (SELECT max(day) FROM months WHERE day < DATE '1998-01-01') - 7 THEN 2 ELSE 1 END AS version FROM months", months=_MONTHS)
def s11(fx):
    """A first run up to a day, then a second one of all: partitions from a week before the last stored one on are replaced."""
    path = tables.work_path(fx.spark, "months")
    months = fx.orders.groupBy(F.to_date(F.trunc("o_orderdate", "month")).alias("day")).agg(F.count("*").alias("n"))
    tables.incremental_overwrite(months.where("day < date '1998-01-01'").withColumn("version", F.lit(1)), path, "day")
    tables.incremental_overwrite(months.withColumn("version", F.lit(2)), path, "day")
    return fx.spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), "n", "version")


@query("s12_bucketed_upsert", """
SELECT merchant, llm_leaf, 2 AS run FROM labels_b WHERE llm_confidence >= 0.9 UNION ALL SELECT merchant, llm_leaf, 1 FROM labels_a
WHERE merchant NOT IN (SELECT merchant FROM labels_b WHERE llm_confidence >= 0.9)
""")
def s12b(fx):
    """A first run of predictions and a second one of some, which rewrites only the buckets of its keys."""
    cols = ["merchant", "llm_leaf"]
    first = fx.labels_a.select(*cols, F.lit(1).alias("run"))
    table = BucketTable(fx.spark, tables.work_path(fx.spark, "predictions"), first.schema, "merchant", 64)
    table.upsert(first)
    table.upsert(fx.labels_b.where("llm_confidence >= 0.9").select(*cols, F.lit(2).alias("run")))
    return table.read()


@query("g1_block_sample")
def g1b(fx):
    """A fifth of the blocks of a table of many files, and the rows that they hold."""
    path = tables.work_path(fx.spark, "blocks")
    fx.lineitem.repartition(50).write.parquet(path)
    some = block_sample(fx.spark.read.parquet(path), 20, 42)
    return some.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("_metadata.file_path").alias("blocks"))


@query("t1_waterfall_stream", f"SELECT leaf, resolution_tier, {_BY} FROM cat_b GROUP BY 1, 2", **MAPS, cat_b=CAT_B)
def t1(fx):
    """The raw feed as files of a directory, categorised as a stream and read from the stream's own table."""
    source, out = tables.work_path(fx.spark, "incoming"), tables.work_path(fx.spark, "categorised")
    fx.raw_b.hint("rebalance").write.parquet(source)  # files of the size that the session advises, so more for a larger feed
    run_to_end(categorise_stream(fx.spark, source, fx.raw_b.schema, fx.seeds()), out, tables.work_path(fx.spark, "stream"))
    return by(fx.spark.read.parquet(out), "leaf", "resolution_tier")
