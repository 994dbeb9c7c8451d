"""Seed readers, ranked reports, chat rows, prediction tables, incremental partitions and global orders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = "struct<messages:array<struct<role:string,content:string>>>"


def read_seed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV seed with a header; quoted fields may hold commas, quotes and patterns."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence documents with nested arrays of value and count."""
    counted = "array<struct<value:string,count:bigint>>"
    return spark.read.schema(f"m string, pct_credit double, median_amount double, cats {counted}, descs {counted}").json(path)


def write_ranked_csv(df: DataFrame, path: str, by: str, *ties: str) -> None:
    """CSV in falling order of ``by``."""
    df.orderBy(F.col(by).desc(), *ties).write.mode("overwrite").csv(path, header=True)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def chat_rows(df: DataFrame, system: str, label: str = "leaf") -> DataFrame:
    """One JSON line a row: instruction, ``field: value`` lines of the user, the label as the answer."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a")))
    user = F.concat_ws("\n", line("merchant", "merchant"), line("description", "description"), line("amount", "amount"), line("direction", "direction"))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return df.select(F.to_json(F.struct(F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", F.col(label))).alias("messages"))).alias("value"))


def write_chat(df: DataFrame, path: str, system: str) -> None:
    chat_rows(df, system).write.mode("overwrite").text(path)


def parse_chat(df: DataFrame) -> DataFrame:
    """The fields of JSON lines: the user turn's lines cut at the first ``: ``; a missing amount is 0."""
    said = F.from_json("value", MESSAGES)["messages"]
    of = lambda role: F.get(F.filter(said, lambda m: m["role"] == role), 0)["content"]
    keyed = F.map_from_entries(F.transform(F.split(of("user"), "\n"), lambda s: F.struct(F.substring_index(s, ": ", 1), F.regexp_replace(s, "^.*?: ", ""))))
    out = df.select(keyed.alias("fields"), of("assistant").alias("leaf"))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    return out.select(field("merchant").alias("merchant"), field("description").alias("description"), F.coalesce(field("amount").try_cast("double"), F.lit(0.0)).alias("amount"), (field("direction") == "credit").cast("int").alias("is_credit"), "leaf")


def incremental_overwrite(new: DataFrame, path: str, part: str, lookback_days: int = 7) -> None:
    """Replace only the days of ``new`` from the last stored day less ``lookback_days`` on; earlier days stay."""
    spark = new.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max(part)).first()[0]
    except Exception as e:  # the first run has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    if last is not None:
        new = new.where(F.col(part) >= F.date_sub(F.lit(last), lookback_days))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def upsert_predictions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win; rows of keys that the new run lacks stay."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def pending(rows: DataFrame, preds: DataFrame, key: str, label: str = "llm_leaf") -> DataFrame:
    """Rows without a prediction yet; a blank one counts as none."""
    return rows.join(preds.where(F.coalesce(label, F.lit("")) != "").select(key), key, "left_anti")


def read_verdicts(df: DataFrame, vocabulary: list[str], leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable verdicts, and those whose verdict or corrected leaf is unknown."""
    known = df.join(leaves.select(F.col("leaf").alias("correct_leaf"), F.lit(True).alias("known")), "correct_leaf", "left")
    good = F.col("verdict").isin(vocabulary) & (F.col("known") | (F.coalesce("correct_leaf", F.lit("")) == ""))
    flagged = known.withColumn("ok", F.coalesce(good, F.lit(False))).drop("known")
    return flagged.where("ok").drop("ok"), flagged.where("not ok").drop("ok")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else the context's own.

    Where neither is set, a session of one machine (master ``local``) gets a folder of that machine; others must set one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` cut into ranges of an order, numbered by ``_range``, and stored."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialised(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def sums_over_ranges(cut: DataFrame, order: list[str | Column], **sums: str | Column) -> DataFrame:
    """Running totals over rows in ranges: each range begins at the total of those before it, one row a range."""
    values = {name: F.col(c) if isinstance(c, str) else c for name, c in sums.items()}
    each = cut.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in values.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("_range", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_s_{name}") for name in values])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(starts), "_range")  # at most as many rows as there are ranges
    return out.withColumns({name: F.col(f"_s_{name}") + F.sum(c).over(within) for name, c in values.items()}).drop("_range", *[f"_s_{name}" for name in values])


def running_sums(df: DataFrame, order: list[str | Column], **sums: str | Column) -> DataFrame:
    """Running totals over a global order, the row's own value included, as columns of the given names.

    The rows are cut into ranges of the order and stored; each range sums its own rows and begins at the total of the
    ranges before it, a table of one row a range.  No task sees more than its range.
    """
    return sums_over_ranges(in_ranges(df, order), order, **sums)


def column_quantiles(df: DataFrame, cols: list[str], at: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles (interpolated) of many columns at once; nulls and NaN do not count.

    Values are counted by column, and the counts run over one order of (column, value), whatever the number of columns.
    """
    each = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("c", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    cut = in_ranges(each.groupBy("c", "v").agg(F.count("*").alias("n")), ["c", "v"])
    totals = {r.c: r.t for r in cut.groupBy("c").agg(F.sum("n").alias("t")).collect()}  # a row a column
    wanted, start = [], 0
    for c in range(len(cols)):
        n = totals.get(c, 0)
        wanted.append(sorted({start + p for q in at for x in [q * (n - 1)] for p in (int(x), min(int(x) + 1, n - 1))}) if n else [])
        start += n
    places = F.array(*[F.array(*[F.lit(p) for p in ps]).cast("array<bigint>") for ps in wanted])
    run = sums_over_ranges(cut, ["c", "v"], upto="n")
    # The value at each wanted place, at most two for each column and quantile.
    found = run.select("c", "v", F.explode(F.filter(F.get(places, F.col("c")), lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))).alias("p")).collect()
    value = {r.p: float(r.v) for r in found}
    out, start = {}, 0
    for c, name in enumerate(cols):
        n = totals.get(c, 0)
        cuts = []
        for q in at if n else []:
            x = q * (n - 1)
            low, high = value[start + int(x)], value[start + min(int(x) + 1, n - 1)]
            cuts.append(low + (x - int(x)) * (high - low))
        out[name] = cuts or [None] * len(at)
        start += n
    return out


def quantiles(df: DataFrame, col: str, at: list[float]) -> list[float | None]:
    """Exact quantiles (interpolated) of one column."""
    return column_quantiles(df, [col], at)[col]


def stable_ids(df: DataFrame, order: list[str | Column], offset: int = 0, within: list[str] | None = None) -> DataFrame:
    """Row numbers over a total order, from ``offset`` on; with ``within``, for each group of those columns."""
    if within:
        return df.withColumn("row_id", F.row_number().over(Window.partitionBy(*within).orderBy(*order)) + offset)
    return running_sums(df, order, row_id=F.lit(1)).withColumn("row_id", F.col("row_id") + offset)
