"""A corpus pipeline: rules, line dedup, near-dedup, decontamination, token ids.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of ``documents``; the last returns the token
digests of each document. ``run`` writes each stage's result as Parquet in the
shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import common, decontaminate, line_dedup, quality, queries, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.apply(docs, counts=False).where("_rejected_by is null").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows lose their lines; a document left without words goes."""
    found = line_dedup.apply(docs).where("_n_removed = 0 or _kept rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = {"text": F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return simhash.keep_one(docs).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.bpe_digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return common.materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])


#: Fingerprints, token merges and a measured rule order aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None
