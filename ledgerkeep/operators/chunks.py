"""Overlapping token ranges of long texts and the page scores built from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_ranges(length: Column, size: int, overlap: int) -> Column:
    """Array of struct(start, end): each range holds at most ``size`` tokens and repeats ``overlap`` of the last one;
    the last ends exactly at the length."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("need size ≥ 1 and 0 ≤ overlap < size")
    step = size - overlap
    last = F.greatest(F.ceil((length - size) / step), F.lit(0))
    return F.transform(
        F.sequence(F.lit(0).cast("long"), last.cast("long")),
        lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, length.cast("long")).alias("end")),
    )


def chunks(pages: DataFrame, size: int, overlap: int, token_column: str = "token_ids") -> DataFrame:
    """page_id, start, end and the tokens of each chunk; empty pages give none."""

    def cut(tokens: Column) -> Column:
        piece = lambda r: F.struct(r.start.alias("start"), r.end.alias("end"), F.slice(tokens, (r.start + 1).cast("int"), (r.end - r.start).cast("int")).alias("chunk_tokens"))
        return F.when(F.size(tokens) > 0, F.transform(chunk_ranges(F.size(tokens), size, overlap), piece))

    # a page's tokens are made once and stay in its row; outer, because Spark would put a filter below an inner one and make them twice
    return pages.select("page_id", F.inline_outer(bound(F.col(token_column), cut))).where(F.col("start").isNotNull())


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), made), 0)


def page_scores(scores: DataFrame) -> DataFrame:
    """A page scores as its best chunk: query_id, page_id, score, best_start."""
    return scores.groupBy("query_id", "page_id").agg(
        F.max("score").alias("score"), F.max_by("start", F.struct("score", -F.col("start"))).alias("best_start")
    )


def coverage_violations(chunk_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose chunks leave a gap, start late, end early or leave the text. pages: page_id, length.

    A page's chunks are few, so ordering them inside the page is a small window.
    """
    before = F.lag("end").over(Window.partitionBy("page_id").orderBy("start"))
    gaps = chunk_rows.select("page_id", "start", "end", (F.col("start") > before).alias("gap"))
    seen = gaps.groupBy("page_id").agg(
        F.min("start").alias("first"), F.max("end").alias("last"), F.coalesce(F.bool_or("gap"), F.lit(False)).alias("gap")
    )
    joined = pages.join(seen, "page_id", "full_outer")
    reason = (
        F.when(F.col("length").isNull(), "unknown_page")
        .when(F.col("first").isNull(), "no_chunks")
        .when(F.col("gap"), "gap")
        .when(F.col("first") != 0, "start")
        .when(F.col("last") != F.col("length"), "end")
    )
    return joined.select("page_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def top_pages(scores: DataFrame, k: int = 3) -> DataFrame:
    """The best k pages of each query and modality; ties go to the smaller page id."""
    w = Window.partitionBy("modality", "query_id").orderBy(F.desc("score"), "page_id")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def pages_by_modality(top: DataFrame, modalities: list[str]) -> DataFrame:
    """One row per query and rank with the page of each modality."""
    return top.groupBy("query_id", "rank").pivot("modality", modalities).agg(F.first("page_id"))
