"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table; naming the columns keeps the scan narrow."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(scan: DataFrame) -> DataFrame:
    """For heavy work per row on a scan with fewer splits than cores, such as one file with one row group.

    A large table has many more splits than cores and passes through unchanged, so nothing is shuffled at scale.
    Call it on a bare scan: asking for its partitions runs no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
