"""Size checks that decide a physical route before data moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group; one small aggregate job."""
    top = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("top")).first().top
    return top or 0


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast narrow lookup rows only after counting them; otherwise leave the join to shuffle,
    where adaptive execution splits skewed partitions."""
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df
