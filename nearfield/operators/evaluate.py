"""Recall against exact results, compression, timing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(truth: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the true k nearest among the hits."""
    best = truth.where(F.col("rank") <= k).select("qid", "id")
    found = hits.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit"))
    joined = best.join(found, ["qid", "id"], "left")
    return joined.groupBy("qid").agg((F.count("hit") / F.lit(float(k))).alias("recall"))


def mean_recall(truth: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    return recall_at_k(truth, hits, k).agg(F.avg("recall").alias("recall"))


def compression(dim: int, code_bytes: int) -> float:
    """Bytes of a float vector over bytes of its codes."""
    return 4.0 * dim / code_bytes


def speedup(df: DataFrame, slow: str, fast: str, out: str = "speedup") -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(slow), F.col(fast)))


def timed(action: Callable[[], object], repeats: int = 1) -> float:
    """Mean milliseconds."""
    begun = time.perf_counter()
    for _ in range(repeats):
        action()
    return 1000 * (time.perf_counter() - begun) / repeats
