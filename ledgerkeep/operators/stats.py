"""Prediction errors, rank correlation and the paired bootstrap."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkeep.operators.ordered import MIN_HOT_ROWS, rank_in_group, running_sum
from ledgerkeep.operators.sizing import broadcast_if_small
from ledgerkeep.session import cut

#: Places of a leaf of the bootstrap's tree (part of the scheme), and places that a task resamples at once.
BOOTSTRAP_LEAF, BOOTSTRAP_BUCKET = 32, 4096


def prediction_errors(rows: DataFrame) -> DataFrame:
    """MAE and MSE, averaged inside each snapshot first."""
    e = F.col("target") - F.col("predicted")
    inside = rows.groupBy("snapshot_id").agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    return inside.agg(F.avg("mae").alias("mae"), F.avg("mse").alias("mse"), F.count("*").alias("snapshots"))


def average_ranks(rows: DataFrame, value: str, name: str, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Rank of each value in its snapshot; ties share the mean of their ranks.

    Values are counted first, so a hot group shrinks to its distinct values before it is ordered.
    """
    counts = cut(rows.groupBy("snapshot_id", value).agg(F.count("*").alias("_ties")))
    summed = running_sum(counts, ["snapshot_id"], [F.col(value)], F.col("_ties"), "_upto", min_rows)
    ranks = summed.select("snapshot_id", value, (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(name))
    return rows.join(ranks, ["snapshot_id", value])


def spearman(rows: DataFrame, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Per snapshot rank correlation; NULL if a side is constant."""
    ranked = average_ranks(average_ranks(rows, "target", "rt", min_rows), "predicted", "rp", min_rows)
    varied = (F.min("rt") < F.max("rt")) & (F.min("rp") < F.max("rp"))
    corr = F.try_divide(F.covar_pop("rt", "rp"), F.stddev_pop("rt") * F.stddev_pop("rp"))
    return ranked.groupBy("snapshot_id").agg(F.when(varied, corr).alias("spearman"))


def spearman_summary(per_snapshot: DataFrame) -> DataFrame:
    return per_snapshot.agg(
        F.avg("spearman").alias("spearman"),
        F.count("spearman").alias("defined"),
        F.count_if(F.col("spearman").isNull()).alias("undefined"),
    )


def negative_detection(rows: DataFrame) -> DataFrame:
    """Precision and recall of negative values; NULL where the denominator is zero."""
    both = F.count_if((F.col("target") < 0) & (F.col("predicted") < 0))
    actual, guessed = F.count_if(F.col("target") < 0), F.count_if(F.col("predicted") < 0)
    return rows.agg(
        both.alias("true_positive"),
        actual.alias("actual"),
        guessed.alias("predicted_negative"),
        F.try_divide(both, guessed).alias("negative_precision"),
        F.try_divide(both, actual).alias("negative_recall"),
    )


@lru_cache(maxsize=1 << 14)
def _cumulative(m: int, left: int, size: int) -> tuple[int, np.ndarray]:
    """P(at most k of m draws fall into the first ``left`` of ``size`` places) for k from the returned one, ten deviations
    and ten more to either side of the mean."""
    p = left / size
    q, mode = 1 - p, min(m, int((m + 1) * p))
    reach = 10 * (m * p * q) ** 0.5 + 10
    low, high = max(0, int(mode - reach)), min(m, int(mode + reach))
    up, down = np.arange(mode, high, dtype=np.float64), np.arange(mode, low, -1, dtype=np.float64)
    rising = np.cumprod((m - up) / (up + 1) * (p / q))
    falling = np.cumprod(down / (m - down + 1) * (q / p))
    weights = np.concatenate([falling[::-1], [1.0], rising])
    return low, np.cumsum(weights) / weights.sum()


def _word(*parts: int) -> bytes:
    return hashlib.md5(":".join(map(str, parts)).encode()).digest()


def _resampled(values: np.ndarray, start: int, n: int, repeats: int, seed: int) -> np.ndarray:
    """For each repeat, the sum of drawn values at the places [start, start + len(values)) of n."""
    end, sums = start + len(values), np.zeros(repeats)

    def down(lo: int, hi: int, drawn: list[int]) -> None:
        if hi <= start or lo >= end:
            return
        size = hi - lo
        if size > BOOTSTRAP_LEAF:
            mid, left = (lo + hi) // 2, []
            for r, m in enumerate(drawn):
                least, upto = _cumulative(m, mid - lo, size)
                u = (int.from_bytes(_word(seed, r, lo, hi)[:4], "big") + 0.5) / 4294967296
                left.append(min(m, least + int(np.searchsorted(upto, u))))
            down(lo, mid, left)
            down(mid, hi, [m - k for m, k in zip(drawn, left)])
            return
        inside = np.zeros(size)
        a, b = max(lo, start), min(hi, end)
        inside[a - lo : b - lo] = values[a - start : b - start]
        for r, m in enumerate(drawn):
            words = b"".join(_word(seed, r, lo, hi, j) for j in range(-(-m // 4)))
            sums[r] += inside[np.frombuffer(words, dtype=">u4")[:m] % size].sum()

    down(0, n, [n] * repeats)
    return sums


def paired_bootstrap(
    differences: DataFrame, keys: Sequence[str], repeats: int, seed: int, bucket: int = BOOTSTRAP_BUCKET, min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """Mean difference per key with a percentile 95% interval over resampled trajectories.

    ``differences``: keys, trajectory_id, difference. The n trajectories of a key stand in the order of their ids; a repeat
    draws n of them with replacement. The draws are split down a binary tree over the places: of the m draws of a node
    [lo, hi) its left half gets the u-quantile of the binomial distribution, u from md5(seed:repeat:lo:hi). A leaf of at most
    BOOTSTRAP_LEAF places takes draw j from word j mod 4 of md5(seed:repeat:lo:hi:j div 4), modulo its places. The tree depends
    on n alone, so any task can walk to the places it holds: trajectories are cut into buckets of ``bucket`` places, and
    a bucket hands on one sum per repeat. How they are cut does not change the draws.
    """
    keys = list(keys)
    numbered = cut(rank_in_group(differences, keys, [F.col("trajectory_id")], "number", min_rows))
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("difference").alias("mean_difference"))
    placed = numbered.join(broadcast_if_small(sizes.select(*keys, "n")), keys).withColumn("bucket", F.floor((F.col("number") - 1) / bucket))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in differences.schema.fields if f.name in keys]

    def resample(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        sums = _resampled(rows["difference"].to_numpy(np.float64), int(rows["number"].iloc[0]) - 1, int(rows["n"].iloc[0]), repeats, seed)
        return pd.DataFrame({**dict(zip(named, group)), "repeat": np.arange(repeats, dtype=np.int32), "s": sums, "n": int(rows["n"].iloc[0])})

    named = [f.name for f in differences.schema.fields if f.name in keys]
    sums = (
        placed.select(*named, "bucket", "number", "difference", "n")
        .groupBy(*named, "bucket")
        .applyInPandas(resample, ", ".join([*kinds, "repeat int", "s double", "n long"]))
    )
    means = sums.groupBy(*keys, "repeat").agg((F.sum("s") / F.first("n")).alias("m"))
    ends = means.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return ends.join(sizes, keys).select(
        *keys,
        F.col("n").alias("trajectory_count"),
        "mean_difference",
        F.col("q")[0].alias("ci_low"),
        F.col("q")[1].alias("ci_high"),
    ).withColumn(
        "verdict",
        F.when(F.col("ci_low") > 0, "positive").when(F.col("ci_high") < 0, "negative").otherwise("inconclusive"),
    )


def paired_differences(trajectories: DataFrame, contrasts: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """Differences of candidate pairs on the same trajectories; unequal sets raise when computed."""
    keys = list(keys)
    names = F.explode(
        F.array(*[F.struct(F.lit(a).alias("candidate_a"), F.lit(b).alias("candidate_b")) for a, b in contrasts])
    )
    wide = trajectories.groupBy(*keys, "trajectory_id").agg(
        F.map_from_entries(F.collect_list(F.struct("candidate", "exact_match"))).alias("by_candidate")
    )
    rows = wide.select(*keys, "trajectory_id", "by_candidate", names.alias("c")).select(
        *keys,
        "trajectory_id",
        "c.*",
        F.try_element_at("by_candidate", F.col("c.candidate_a")).alias("a"),
        F.try_element_at("by_candidate", F.col("c.candidate_b")).alias("b"),
    )
    unpaired = F.col("a").isNull() != F.col("b").isNull()
    return rows.where(F.col("a").isNotNull() | F.col("b").isNotNull()).select(
        *keys,
        "trajectory_id",
        "candidate_a",
        "candidate_b",
        F.when(unpaired, F.raise_error(F.lit("unpaired trajectories")).cast("double"))
        .otherwise(F.col("a") - F.col("b"))
        .alias("difference"),
    )


def exact_percentiles(
    rows: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """Percentiles with linear interpolation: keys, fraction, percentile.

    Values are counted before they are ordered, and the running count is cut into bands for hot groups, so no task
    holds all values of a group.
    """
    keys = list(keys)
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")))
    summed = running_sum(counts, keys, [F.col(value)], F.col("_c"), "_upto", min_rows)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    spots = totals.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn(
        "_at", (F.col("_n") - 1) * F.col("fraction")
    )
    joined = summed.join(broadcast_if_small(spots), keys)
    low, high = F.floor("_at"), F.ceil("_at")
    picked = joined.groupBy(*keys, "fraction").agg(
        F.first("_at").alias("_at"),
        F.min(F.when(F.col("_upto") > low, F.col(value))).alias("_lo"),
        F.min(F.when(F.col("_upto") > high, F.col(value))).alias("_hi"),
    )
    weight = F.col("_at") - F.floor("_at")
    return picked.select(*keys, "fraction", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * weight).alias("percentile"))
