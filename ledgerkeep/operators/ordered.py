"""Rank, running sum and previous value inside groups of any size.

A plain window sends a whole group to one task. That is fine for most groups, but one key may hold a large
share of all rows. Groups above a bound are therefore cut into value bands along the sort order: a local window
runs inside (group, band), and a small table of band totals supplies the offsets. The result is exact.

At most ``BANDS`` groups can exceed 1/BANDS of all rows, and their split points number a few times ``BANDS``,
so the tables broadcast below have a fixed upper size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = 4096
MIN_HOT_ROWS = 2_000_000
SPLITS_PER_BOUND = 4


def _count_below(splits: Column, value: Column) -> Column:
    """How many entries of the sorted array are smaller than ``value`` (binary search)."""
    start = F.struct(F.lit(0).alias("lo"), F.size(splits).alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state.lo + state.hi) / 2).cast("int")
        right = F.get(splits, mid) < value
        open_ = state.lo < state.hi
        return F.struct(
            F.when(open_ & right, mid + 1).otherwise(state.lo).alias("lo"),
            F.when(open_ & ~right, mid).otherwise(state.hi).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve, lambda s: s.lo)


def _place(df: DataFrame, keys: list[str], order: list[Column], min_rows: int) -> tuple[DataFrame, bool]:
    """Add ``_ord`` (the sort key) and ``_band``; tell whether any group was cut."""
    df = df.withColumn("_ord", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    seen = sizes.agg(F.sum("_n").alias("total"), F.max("_n").alias("top")).first()
    bound = max(min_rows, (seen.total or 0) // BANDS)
    if (seen.top or 0) <= bound:
        return df, False
    hot = F.broadcast(sizes.where(F.col("_n") > bound))
    step = F.greatest(F.lit(1), F.floor(F.lit(bound) / SPLITS_PER_BOUND)).cast("long")
    splits = (
        df.join(hot, keys)
        .where(F.pmod(F.xxhash64("_ord"), step) == 0)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("_ord")).alias("_splits"))
    )
    placed = df.join(F.broadcast(splits), keys, "left").withColumn(
        "_band", F.when(F.col("_splits").isNull(), 0).otherwise(_count_below(F.col("_splits"), F.col("_ord")))
    )
    return placed.drop("_splits"), True


def _offsets(placed: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return placed.groupBy(*keys, "_band").agg(*aggs)


def rank_in_group(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """1-based row number of each row in its group. ``order`` must end in a unique column."""
    placed, cut = _place(df, keys, order, min_rows)
    if not cut:
        w = Window.partitionBy(*keys).orderBy("_ord")
        return placed.withColumn(name, F.row_number().over(w).cast("long")).drop("_ord")
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    shift = _hot_only(
        _offsets(placed, keys, F.count("*").alias("_m")).withColumn(
            "_shift", F.coalesce(F.sum("_m").over(before), F.lit(0))
        )
    )
    w = Window.partitionBy(*keys, "_band").orderBy("_ord")
    return (
        placed.withColumn(name, F.row_number().over(w).cast("long"))
        .join(shift.drop("_m"), [*keys, "_band"], "left")
        .withColumn(name, F.col(name) + F.coalesce("_shift", F.lit(0)))
        .drop("_ord", "_band", "_shift")
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: Column,
    name: str = "running",
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and including this one."""
    placed, cut = _place(df.withColumn("_v", value), keys, order, min_rows)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not cut:
        w = Window.partitionBy(*keys).orderBy("_ord").rowsBetween(*upto)
        return placed.withColumn(name, F.sum("_v").over(w)).drop("_ord", "_v")
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    shift = _hot_only(
        _offsets(placed, keys, F.sum("_v").alias("_m")).withColumn("_shift", F.sum("_m").over(before))
    )
    w = Window.partitionBy(*keys, "_band").orderBy("_ord").rowsBetween(*upto)
    return (
        placed.withColumn(name, F.sum("_v").over(w))
        .join(shift.drop("_m"), [*keys, "_band"], "left")
        .withColumn(name, F.when(F.col("_shift").isNull(), F.col(name)).otherwise(F.col(name) + F.col("_shift")))
        .drop("_ord", "_band", "_shift", "_v")
    )


def previous_in_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: Column,
    name: str = "previous",
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """``value`` of the row just before this one in its group; NULL for the first row."""
    placed, cut = _place(df.withColumn("_v", F.struct(value.alias("v"))), keys, order, min_rows)
    if not cut:
        w = Window.partitionBy(*keys).orderBy("_ord")
        return placed.withColumn(name, F.lag("_v").over(w)["v"]).drop("_ord", "_v")
    last = _hot_only(
        _offsets(placed, keys, F.max_by("_v", "_ord").alias("_m")).withColumn(
            "_shift", F.lag("_m").over(Window.partitionBy(*keys).orderBy("_band"))
        )
    )
    w = Window.partitionBy(*keys, "_band").orderBy("_ord")
    return (
        placed.withColumn("_l", F.lag("_v").over(w))
        .join(last.drop("_m"), [*keys, "_band"], "left")
        .withColumn(name, F.coalesce("_l", "_shift")["v"])
        .drop("_ord", "_band", "_shift", "_v", "_l")
    )


def _hot_only(bands: DataFrame) -> DataFrame:
    """Band 0 never has an offset; what is left belongs to cut groups only and is bounded, so broadcast it."""
    return F.broadcast(bands.where(F.col("_band") > 0))
