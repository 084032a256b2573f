"""The queries of the corpus operators: thin digests over the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, line_dedup, pii, quality, simhash, sql, substring_dedup, suffix_dedup, token_files


#: The key of the registered query, so that its results are the same in every run; a real corpus takes a secret one.
DEMO_KEY = b"demonstration key only"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY)
    return found.select("doc_id", F.size("kinds").cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"), "text")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def bpe_digest(docs: DataFrame) -> DataFrame:
    tokenizer = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    done = bpe.recode(docs, tokenizer)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return token_files.read(spark, written)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.apply(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.apply(table(spark, sf_dir, "documents"))
    q = F.col("_q")
    return found.select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        quality.base_failed(q).alias("base_failed"),
        F.col("_rejected_by").isNull().alias("kept"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_substring_dedup,
        op2_pii,
        op3_byte_bpe,
        op4_suffix_dedup,
        op5_decontaminate,
        op6_html_text,
        op7_token_files,
        op8_line_dedup,
        op9_simhash,
        op10_quality,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others need hashes, merges or a suffix order that SQL lacks; tests hold them against brute force."""
    return {
        "op1_substring_dedup": sql.SUBSTRING,
        "op5_decontaminate": sql.DECONTAMINATE,
        "op8_line_dedup": sql.LINES,
        "op10_quality": sql.QUALITY,
    }
