"""CSV files of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the search result files.
SEARCH = "algorithm string, parallel_mode string, parameter1 string, parameter2 string, threads int, latency_us bigint, `recall@10` double"


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """'-' is null; nlist-M packed in parameter1 also as two numbers."""
    raw = spark.read.csv(path, header=True, schema=SEARCH, nullValue="-", enforceSchema=False)
    return _parsed(raw.withColumnRenamed("recall@10", "recall"))


def _parsed(df: DataFrame) -> DataFrame:
    parts = F.split("parameter1", "-")
    packed = F.col("parameter1").rlike(r"^\d+-\d+$")
    return df.withColumn("nlist", F.when(packed, F.get(parts, F.lit(0)).cast("int"))).withColumn("m", F.when(packed, F.get(parts, F.lit(1)).cast("int")))


def read_concatenated(spark: SparkSession, path: str) -> DataFrame:
    """Several result files behind one another, with '==> name <==' markers, headers and blank lines between."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("==>") & ~F.col("value").startswith("algorithm,"))
    schema = SEARCH.replace("`recall@10`", "recall")
    return _parsed(lines.select(F.from_csv("value", schema, {"nullValue": "-"}).alias("r")).select("r.*"))


def write_benchmark(df: DataFrame, path: str, decimals: dict[str, int]) -> None:
    """CSV with a header and fixed decimals."""
    fixed = [F.format_string(f"%.{decimals[c]}f", F.col(c)).alias(c) if c in decimals else F.col(c) for c in df.columns]
    df.select(*fixed).write.mode("overwrite").option("header", True).csv(path)


def console(df: DataFrame, rows: int = 20) -> None:
    """Prints the first rows of a result; a top-k report, not a sink of data."""
    df.show(rows, truncate=False)
