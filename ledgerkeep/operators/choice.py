"""Choosing a threshold, model or protocol from development results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 9


def choose_threshold(trials: DataFrame, metric: str) -> DataFrame:
    """Mean of the metric over budgets per threshold; the best is chosen, ties go to the larger threshold."""
    means = trials.groupBy("threshold").agg(F.round(F.avg(metric), SCORE_DIGITS).alias("score"))
    best = F.max(F.struct("score", "threshold")).over(Window.partitionBy(F.lit(1)))  # one row per threshold
    return means.withColumn("chosen", F.col("threshold") == best["threshold"])


def choose_per_group(rows: DataFrame, groups: Sequence[str], name: str, order: Sequence[Column]) -> DataFrame:
    """The name with the smallest order tuple in each group."""
    return rows.groupBy(*groups).agg(F.min_by(name, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("chosen"))
