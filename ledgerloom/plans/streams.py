"""Queries that read both feeds as streams of files, in micro-batches, with batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.operators.seeds import parse_sources
from ledgerloom.plans.feeds import CAT_A, CAT_B, MAPS
from ledgerloom.plans.registry import query
from ledgerloom.sources import tables
from ledgerloom.streaming import drift as D

LENGTH, LATE = 28, 56
#: First days of the slices in which rows arrive; a row of every twentieth applicant arrives after all others.
SLICES = ("1970-01-01", "1996-01-01", "1997-07-01", "1999-01-01", "2000-07-01")
LAST = len(SLICES)
FILES = 2
#: Rows of a feed's file at most, on average over the slices; larger feeds come in more files a slice.
FILE_ROWS = 1_000_000


def arrival(ts: str, applicant: str) -> str:
    """Number of the slice of a row, in the dialect of both engines."""
    passed = " + ".join(f"CASE WHEN {ts} >= TIMESTAMP '{d}' THEN 1 ELSE 0 END" for d in SLICES[1:])
    return f"CASE WHEN {applicant} % 20 = 7 THEN {LAST} ELSE {passed} END"


def sliced(df: DataFrame, name: str) -> str:
    """Folder of the feed with a folder for each slice: the feed is made once, however many slices it has."""
    path = tables.work_path(df.sparkSession, name)
    df.withColumn("_slice", F.expr(arrival("ts", "applicant"))).write.partitionBy("_slice").parquet(path)
    return path


def arrive(feeds: list[DataFrame], paths: list[str]) -> int:
    """The feeds as files that come slice after slice; how many files a slice of each has, ``FILES`` or more."""
    spark, kept = feeds[0].sparkSession, [sliced(df, "slices") for df in feeds]
    columns = [StructType([*df.schema, StructField("_slice", IntegerType())]) for df in feeds]
    rows = [spark.read.schema(c).parquet(k) for c, k in zip(columns, kept)]
    files = max([FILES, *(-(-r.count() // (FILE_ROWS * (LAST + 1))) for r in rows)])
    for df, path in zip(rows, paths):
        for k in range(LAST + 1):
            df.where(F.col("_slice") == k).drop("_slice").repartition(files).write.mode("append").parquet(path)
    return files


def streams(fx):
    """Both feeds as streams over folders in which they have arrived, and as the rows of those folders."""
    paths = [tables.work_path(fx.spark, name) for name in ("incoming-a", "incoming-b")]
    schemas = [fx.raw_a.schema, fx.raw_b.schema]
    files = arrive([fx.raw_a, fx.raw_b], paths)
    return D.both_feeds(fx.spark, *paths, *schemas, files), [fx.spark.read.schema(s).parquet(p) for s, p in zip(schemas, paths)]


def windows(fx) -> tuple[DataFrame, list[DataFrame]]:
    """The windows when all has come, and the rows of both feeds that came."""
    out = tables.work_path(fx.spark, "windows")
    feeds, came = streams(fx)
    rows = D.resolved(*feeds, fx.seeds())
    D.run_batches(D.drift_windows(rows, f"{LENGTH} days", f"{LATE} days"), out, tables.work_path(fx.spark, "stream"), "update")
    return D.latest(fx.spark, out, ["provider", "start"]), came


#: Rows that count: those of the last slice do where their window is open when it comes; a batch's late rows are told by the
#: watermark that the batch before it began with, so the newest row is that of all slices but the last two.
_ROWS = "SELECT 'A' AS provider, applicant, ts, amount, resolution_tier FROM cat_a UNION ALL SELECT 'B', applicant, ts, amount, resolution_tier FROM cat_b"
_PLACED = f"SELECT *, {arrival('ts', 'applicant')} AS slice, time_bucket(INTERVAL {LENGTH} DAY, ts, TIMESTAMP '1970-01-01') AS start FROM both_rows WHERE ts IS NOT NULL"
_MARK = f"SELECT max(ts) - INTERVAL {LATE} DAY AS mark FROM placed WHERE slice < {LAST - 1}"
_COUNTED = f"SELECT * FROM placed, mark WHERE slice < {LAST} OR start + INTERVAL {LENGTH} DAY > mark"
_S = {**MAPS, "cat_a": CAT_A, "cat_b": CAT_B, "both_rows": _ROWS, "placed": _PLACED, "mark": _MARK, "counted": _COUNTED}


@query("t2_drift_stream", """
SELECT provider, start, count(*) AS n, count(*) FILTER (resolution_tier <> 'T4_merchant_dictionary') AS unmatched,
  count(*) FILTER (resolution_tier = 'T7_unclassified') AS fell_through,
  CAST(coalesce(sum(CAST(round(abs(amount) * 100) AS BIGINT)), 0) AS BIGINT) AS volume,
  CAST(coalesce(sum(CAST(round(abs(amount) * 100) AS BIGINT)) FILTER (resolution_tier = 'T7_unclassified'), 0) AS BIGINT) AS volume_fell_through
FROM counted GROUP BY 1, 2
""", **_S)
def t2d(fx):
    """Unmatched and fall-through rows of both feeds by window, from six micro-batches of which the last is late."""
    return windows(fx)[0]


@query("t2_late_rows", """
SELECT provider, count(*) AS arrived, count(*) FILTER (NOT (slice < 5 OR start + INTERVAL 28 DAY > mark)) AS late FROM placed, mark GROUP BY 1
""", **_S)
def t2l(fx):
    """Rows of each feed that came after their window had closed."""
    counted, came = windows(fx)
    rows = [df.where("ts is not null").select(F.lit(name).alias("provider")) for name, df in zip("AB", came)]
    return D.late_rows(rows[0].unionByName(rows[1]), counted)


_VALUES = f"""
SELECT 'A' AS provider, coalesce(sub, pri) AS value, ts, applicant FROM feed_a UNION ALL SELECT 'B', cat, ts, applicant FROM feed_b
"""


@query("n4_first_seen_stream", f"""
SELECT provider, f.value, f.slice AS batch, k.value IS NOT NULL AS mapped
FROM (SELECT provider, value, min({arrival('ts', 'applicant')}) AS slice FROM vals WHERE value IS NOT NULL GROUP BY 1, 2) f
LEFT JOIN (SELECT 'A' AS provider, value FROM sub_map UNION SELECT 'A', value FROM pri_map UNION SELECT 'B', value FROM cat_map) k USING (provider, value)
""", **MAPS, vals=_VALUES)
def n4f(fx):
    """Category values of both feeds with the micro-batch that had them first, and whether the taxonomy knows them."""
    (a, b), _ = streams(fx)
    values = a.select(F.lit("A").alias("provider"), F.coalesce("sub", "pri").alias("value")).unionByName(b.select(F.lit("B").alias("provider"), F.col("cat").alias("value")))
    known = parse_sources(fx.taxonomy, "sources").select(F.lit("A").alias("provider"), "value").unionByName(parse_sources(fx.taxonomy, "sources_b").select(F.lit("B").alias("provider"), "value"))
    out = tables.work_path(fx.spark, "first-values")
    D.run_batches(D.first_values(values, known), out, tables.work_path(fx.spark, "stream"), "append")
    return fx.spark.read.parquet(out).select("provider", "value", F.col("batch").cast("long").alias("batch"), "mapped")
