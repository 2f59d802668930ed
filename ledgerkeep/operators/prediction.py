"""A signed ridge model of future value: one aggregate pass on Spark, a tiny solve on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkeep.operators.ordered import MIN_HOT_ROWS
from ledgerkeep.operators.stats import exact_percentiles
from ledgerkeep.session import cut

# The feature whitelist and the ablation groups.
FEATURES = (
    "recency_rank", "age", "retrieval_frequency", "history_observed", "historical_similarity", "memory_tokens",
)
GROUPS = {
    "full": FEATURES,
    "no_frequency": tuple(f for f in FEATURES if f != "retrieval_frequency"),
    "no_recency": tuple(f for f in FEATURES if f not in ("recency_rank", "age")),
    "recency_frequency": ("recency_rank", "age", "retrieval_frequency"),
}
NULLABLE = "historical_similarity"


def feature_violations(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Feature rows that break a rule: only similarity may be missing, only observed rows may have one, no infinity."""
    missing = [f for f in features if f not in rows.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    number = {f: F.col(f).cast("double") for f in features}
    reasons = [
        *[F.when(number[f].isNull(), f"null_{f}") for f in features if f != NULLABLE],
        *[F.when(F.isnan(number[f]) | (F.abs(number[f]) == float("inf")), f"not_finite_{f}") for f in features],
    ]
    if NULLABLE in features and "history_observed" in features:
        reasons.append(F.when(~F.col("history_observed") & F.col(NULLABLE).isNotNull(), "unobserved_similarity"))
    return rows.select("snapshot_id", "memory_id", F.concat_ws(",", *reasons).alias("reasons")).where(F.col("reasons") != "")


def medians(rows: DataFrame, features: Sequence[str], min_rows: int = MIN_HOT_ROWS) -> dict[str, float]:
    """Median of each feature that has missing values; 0 if a feature is never present."""
    holes = rows.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    out = dict.fromkeys(features, 0.0)
    for f in [f for f in features if holes[f]]:
        one = rows.select(F.lit(0).alias("scope"), F.col(f).cast("double").alias("x"))
        found = exact_percentiles(one, ["scope"], "x", [0.5], min_rows).first()
        out[f] = float(found.percentile) if found else 0.0
    return out


def imputed(features: Sequence[str], fills: Mapping[str, float]) -> dict[str, Column]:
    return {f: F.coalesce(F.col(f).cast("double"), F.lit(fills[f])) for f in features}


@dataclass(frozen=True)
class Statistics:
    """Everything any feature group's fit needs: means, population covariances, and the targets' moments."""

    features: tuple[str, ...]
    rows: int
    medians: Mapping[str, float]
    means: np.ndarray
    covariances: np.ndarray
    target_covariances: np.ndarray
    target_mean: float


def sufficient_statistics(
    rows: DataFrame, features: Sequence[str] = FEATURES, min_rows: int = MIN_HOT_ROWS
) -> Statistics:
    """One pass over the labelled rows (features, target, uncertain). Uncertain labels are refused."""
    features = tuple(features)
    # two readers: the medians and the statistics; what was computed to get here is not computed twice
    rows = cut(rows.select(*features, "target", *(["uncertain"] if "uncertain" in rows.columns else [])))
    fills = medians(rows, features, min_rows)
    x = imputed(features, fills)
    pairs = list(combinations_with_replacement(range(len(features)), 2))
    y = F.col("target").cast("double")
    uncertain = F.count_if("uncertain") if "uncertain" in rows.columns else F.lit(0)
    row = rows.agg(
        F.count("*").alias("n"),
        uncertain.alias("uncertain"),
        F.avg(y).alias("my"),
        *[F.avg(x[f]).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.covar_pop(x[features[i]], x[features[j]]).alias(f"c{i}_{j}") for i, j in pairs],
        *[F.covar_pop(x[f], y).alias(f"t{i}") for i, f in enumerate(features)],
    ).first()
    if row.uncertain:
        raise ValueError("uncertain labels need their own training protocol")
    if not row.n or row.my is None or not np.isfinite(row.my):
        raise ValueError("labels must be finite and not empty")
    p = len(features)
    cov = np.zeros((p, p))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return Statistics(
        features, row.n, fills, np.array([row[f"m{i}"] for i in range(p)]), cov, np.array([row[f"t{i}"] for i in range(p)]), row.my
    )


@dataclass(frozen=True)
class Model:
    name: str
    features: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float


ZERO = Model("zero", (), (), (), (), (), 0.0)


def solve_ridge(stats: Statistics, features: Sequence[str], alpha: float, name: str = "ridge") -> Model:
    """(XᵀX + αI) w = Xᵀ(y − ȳ) on standardised features, from the statistics alone."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    at = [stats.features.index(f) for f in features]
    spread = np.sqrt(np.diag(stats.covariances)[at])
    scales = np.where(spread == 0, 1.0, spread)
    gram = stats.rows * stats.covariances[np.ix_(at, at)] / np.outer(scales, scales)
    weights = np.linalg.solve(gram + alpha * np.eye(len(at)), stats.rows * stats.target_covariances[at] / scales)
    return Model(
        name,
        tuple(features),
        tuple(stats.medians[f] for f in features),
        tuple(stats.means[at].tolist()),
        tuple(scales.tolist()),
        tuple(weights.tolist()),
        stats.target_mean,
    )


def ablation_models(stats: Statistics, alphas: Sequence[float]) -> list[Model]:
    """The constant model and every group × alpha, all from the same statistics."""
    fitted = [solve_ridge(stats, names, a, f"{group}-a{a:g}") for group, names in GROUPS.items() for a in alphas]
    return [ZERO, *fitted]


def prediction(model: Model) -> Column:
    """The model as one linear Column expression."""
    value = F.lit(float(model.intercept))
    for f, fill, mean, scale, weight in zip(
        model.features, model.medians, model.means, model.scales, model.weights, strict=True
    ):
        value = value + (F.coalesce(F.col(f).cast("double"), F.lit(fill)) - mean) / scale * weight
    return value


def model_table(spark: SparkSession, models: Sequence[Model]) -> DataFrame:
    """Models as rows (model, feature, median, mean, scale, weight, intercept)."""
    rows = [
        (m.name, f, *values, float(m.intercept))
        for m in models
        for f, *values in (zip(m.features, m.medians, m.means, m.scales, m.weights, strict=True) if m.features else [("", 0.0, 0.0, 1.0, 0.0)])
    ]
    return spark.createDataFrame(
        rows, "model string, feature string, median double, mean double, scale double, weight double, intercept double"
    )
