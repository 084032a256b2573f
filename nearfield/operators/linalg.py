"""Sums and matrix-vector products, and the generators of their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import scaled


def array_range(spark: SparkSession, n: int) -> DataFrame:
    """(i, v) with v = i."""
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))


def array_ones(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))


def matrix_rows(spark: SparkSession, n: int) -> DataFrame:
    """(j, row) with row[i] = i + j, a row for each j."""
    return spark.range(n).select(
        F.col("id").alias("j"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i + F.col("id")).cast("double")).alias("row")
    )


def sizes(first: int = 128, last: int = 2048, step: int = 128) -> range:
    return range(first, last + 1, step)


def total(df: DataFrame, col: str = "v", out: str = "total") -> DataFrame:
    """The sum, in partial sums of tasks and their sum: any number of rows."""
    return df.agg(F.sum(F.col(col).cast("double")).alias(out))


def matvec(rows: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, s): s[i] = sum over j of row_j[i] * v_j, for rows(j, row) and vector(i, v)."""
    joined = rows.join(vector.select(F.col("i").alias("j"), F.col("v").alias("a")), "j")
    cells = joined.select(F.posexplode(scaled(F.col("row"), F.col("a"))).alias("i", "x"))
    return cells.groupBy("i").agg(F.sum("x").alias("s"))
