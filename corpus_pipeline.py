"""A training-corpus pipeline over ``documents``: quality, near copies, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder and rereads as
the next stage's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixing, quality, simhash, substring
from ledgerloom.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if label 1 is at least this likely.
KEEP_FROM = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, quality.not_held_out(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("quality_score") >= KEEP_FROM).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents that are similar in five-word shingles."""
    return simhash.keep_one(docs.select(*COLUMNS))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that start in a document of smaller id.

    A text that loses words is its kept words joined by blanks; a text that loses none stays as it is; one that loses
    all is dropped.
    """
    rest = [F.col("lang"), F.col("source"), F.col("n_chars"), F.col("text").isNull().alias("no_text")]
    out = substring.remove_repeats(docs.select(*COLUMNS), rest).where("n_removed = 0 or kept <> ''")
    length = F.when(F.col("n_removed") == 0, F.col("rest.n_chars")).otherwise(F.length("kept").cast("long"))
    return out.select("doc_id", F.when(~F.col("rest.no_text"), F.col("kept")).alias("text"), "rest.lang", "rest.source", length.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows of one id are documents of their own."""
    taken = mixing.mix(docs, carry=[F.col(c) for c in COLUMNS]).where("copies > 0")
    return taken.select("rest", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("rest.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document taken."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", classify), ("near_copies", drop_near_copies), ("passages", drop_passages), ("mix", mix_sources), ("tokens", encode)]

#: A classifier's fit, fingerprints and merges are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
