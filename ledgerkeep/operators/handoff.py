"""Joining features with labels for the next stage, without handing test labels along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def handoff(features: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """train and validation rows with targets; test features and test labels apart."""
    joined = features.join(labels, ["snapshot_id", "memory_id"])
    target = [c for c in labels.columns if c not in ("snapshot_id", "memory_id")]
    test = joined.where(F.col("split") == "test")
    return {
        "train": joined.where(F.col("split") == "train"),
        "validation": joined.where(F.col("split") == "validation"),
        "test_features": test.drop(*target),
        "test_labels": test.select("snapshot_id", "memory_id", *target),
    }


def oldest_is_support(memories: DataFrame, support: Column) -> DataFrame:
    """The oldest memory of each snapshot and whether it supports an answer."""
    first = F.min_by(F.struct("memory_id", support.alias("s")), F.struct("event_order", "memory_id"))
    return memories.groupBy("snapshot_id").agg(first.alias("o")).select(
        "snapshot_id", F.col("o.memory_id").alias("oldest_id"), F.col("o.s").alias("oldest_is_support")
    )


def frequency_mismatches(features: DataFrame, expected: DataFrame) -> DataFrame:
    """Memories whose retrieval frequency differs from the scenario's design."""
    return features.join(expected, ["snapshot_id", "memory_id"]).where(
        F.col("retrieval_frequency") != F.col("expected_frequency")
    )
