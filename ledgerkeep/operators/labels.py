"""Value labels from paired interventions: utilities, repeated labels, leave-one-out, reliability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletion_utilities(deleted: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Utility of a memory for a query: score with everything minus score without it.

    ``deleted``: snapshot_id, query_id, seed, deleted_memory_id, exact_match, context_ids, and of the full answer beside it
    full_match, full_ids and full_support (whether it read a support set). Row by row: nothing is joined. ``keep`` names
    columns that stay.
    """
    return deleted.select(
        "snapshot_id",
        "query_id",
        "seed",
        F.col("deleted_memory_id").alias("memory_id"),
        (F.col("full_match") - F.col("exact_match")).alias("value"),
        F.array_contains("full_ids", F.col("deleted_memory_id")).alias("retrieved"),
        F.array_except("context_ids", "full_ids").alias("replacement_ids"),
        (F.col("full_support") & (F.col("full_match") == 0)).alias("hit_but_wrong"),
        *keep,
    )


def by_condition(**utilities: DataFrame) -> DataFrame:
    """Utilities of several interventions in one table, told apart by ``condition``."""
    tagged = [u.withColumn("condition", F.lit(name)) for name, u in utilities.items()]
    return reduce(DataFrame.unionByName, tagged)


def repeated_labels(
    utilities: DataFrame, minimum_effect: float, max_std: float, min_stability: float, by: Sequence[str] = ()
) -> DataFrame:
    """Mean over seeds of the window mean, its spread, the share of the commonest sign, and the class, per snapshot,
    memory and the columns ``by`` (such as the intervention)."""
    keys = ["snapshot_id", "memory_id", *by]
    windows = utilities.groupBy(*keys, "seed").agg(F.avg("value").alias("v"))
    v = F.col("v")
    up, down = F.count_if(v > minimum_effect), F.count_if(v < -minimum_effect)
    flat = F.count_if((v <= minimum_effect) & (v >= -minimum_effect))
    labels = windows.groupBy(*keys).agg(
        F.avg("v").alias("value"),
        F.stddev_pop("v").alias("standard_deviation"),
        (F.greatest(up, down, flat) / F.count("*")).alias("sign_stability"),
    )
    uncertain = (F.col("standard_deviation") > max_std) | (F.col("sign_stability") < min_stability)
    return labels.withColumn("uncertain", uncertain).withColumn(
        "label",
        F.when(F.col("uncertain"), "uncertain")
        .when(F.col("value") > minimum_effect, "positive")
        .when(F.col("value") < -minimum_effect, "negative")
        .otherwise("zero"),
    )


def loo_labels(utilities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Leave-one-out value: the mean utility over queries (and seeds, if several); ``by`` names columns of the memory that stay."""
    return utilities.groupBy("snapshot_id", "memory_id", *by).agg(F.avg("value").alias("loo_value"))


def reliability_gate(
    gaps: DataFrame, labels: DataFrame, minimum_dependency: float, development: Column
) -> DataFrame:
    """One row: does the development data depend on memory, and are all its labels certain over several seeds?

    ``gaps``: trajectory_id, split, seed, value (full minus empty). ``labels``: split, uncertain.
    """
    inside = gaps.where(development).groupBy("trajectory_id").agg(F.avg("value").alias("v"))
    dependency = inside.agg(F.avg("v").alias("memory_dependency"))
    certain = labels.where(development).agg(
        F.coalesce(F.bool_and(~F.col("uncertain")), F.lit(False)).alias("labels_certain"),
        F.count("*").alias("labels"),
    )
    seeds = gaps.agg(F.count_distinct("seed").alias("seeds"))
    ready = F.col("labels_certain") & (F.col("seeds") >= 2) & (F.col("memory_dependency") >= minimum_dependency)
    one = F.lit(1).alias("one")  # three one-row tables side by side
    row = dependency.select("*", one).join(certain.select("*", one), "one").join(seeds.select("*", one), "one").drop("one")
    return row.withColumn("ready", F.coalesce(ready, F.lit(False)))


def zero_cases(utilities: DataFrame) -> DataFrame:
    """Interventions that changed no score."""
    return utilities.where("value = 0").select("snapshot_id", "memory_id", "query_id", "seed")


def label_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(
        F.count("*").alias("labels"), F.count_if(F.col("value") != 0).alias("nonzero")
    )
