"""Result files: deterministic writes and checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """JSON lines in key order across files (range-partitioned sort)."""
    df.orderBy(*keys).write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    df.orderBy(*keys).write.mode("errorifexists").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """sha256 of each result file. For report-sized files: a file is hashed as one value."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256")
    )


def verify_manifest(saved: DataFrame, current: DataFrame) -> DataFrame:
    """State of every file: same, changed, missing or unexpected."""
    a = saved.select("file", F.col("sha256").alias("saved"))
    b = current.select("file", F.col("sha256").alias("found"))
    state = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("saved").isNull(), "unexpected")
        .when(F.col("saved") == F.col("found"), "same")
        .otherwise("changed")
    )
    return a.join(b, "file", "full_outer").select("file", state.alias("state"))
