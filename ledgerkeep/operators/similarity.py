"""Exact cosine work in blocks: top-k search, full scores, similar pairs, greedy representatives.

Vectors meet in block × block products inside tasks. What leaves a task is already reduced (a partial top-k, the
pairs above a threshold, one match per row), so output never grows with the number of compared pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkeep.operators.cells import CELL_ROWS, meetings, unit
from ledgerkeep.operators.ordered import MIN_HOT_ROWS, rank_in_group
from ledgerkeep.operators.sizing import broadcast_if_small, largest_group
from ledgerkeep.session import cut

BROADCAST_QUERIES = 4096
BLOCK_ROWS = 2048
BATCH_ROWS = 4096
PAIRS_PER_ROW = 64
SCORE_DIGITS = 12


# --- search -----------------------------------------------------------------------------------------------


def _partial(scores: np.ndarray, memory: np.ndarray, names: np.ndarray, keep: int | None) -> pd.DataFrame:
    """Scores of records (rows) by queries (columns) as rows; at most ``keep`` per query, ties by id."""
    if keep is None or len(memory) <= keep:
        return pd.DataFrame(
            {"query_id": np.tile(names, len(memory)), "memory_id": np.repeat(memory, len(names)), "score": scores.ravel()}
        )

    def best(s: np.ndarray) -> np.ndarray:
        # rows that reach the keep-th score, ties included; only those are sorted
        near = np.flatnonzero(s >= np.partition(s, len(s) - keep)[len(s) - keep])
        return near[np.lexsort((memory[near], -s[near]))[:keep]]

    rows = np.concatenate([best(scores[:, j]) for j in range(len(names))])
    columns = np.repeat(np.arange(len(names)), keep)
    return pd.DataFrame({"query_id": names[columns], "memory_id": memory[rows], "score": scores[rows, columns]})


def _best_parts(scores: np.ndarray, memory: np.ndarray, part: np.ndarray, names: np.ndarray, label: str) -> pd.DataFrame:
    """``_partial`` of records that are parts of memories: for each memory and query its best part, ties by the smaller part."""
    order = np.lexsort((part, memory))
    memory, part, scores = memory[order], part[order], scores[order]
    begin = np.flatnonzero(np.concatenate([[True], memory[1:] != memory[:-1]]))
    best = np.maximum.reduceat(scores, begin, axis=0)
    reached = ~(scores < np.repeat(best, np.diff(np.append(begin, len(memory))), axis=0))
    first = np.minimum.reduceat(np.where(reached, np.arange(len(memory))[:, None], len(memory)), begin, axis=0)
    return pd.DataFrame(
        {"query_id": np.tile(names, len(begin)), "memory_id": np.repeat(memory[begin], len(names)), "score": best.ravel(), label: part[first.ravel()]}
    )


def _scan(records: DataFrame, queries: DataFrame, keep: int | None, part: str | None = None) -> DataFrame:
    """Up to ``BROADCAST_QUERIES`` queries go to every task at once; more meet the records block by block."""
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    return (_scan_broadcast if few else _scan_blocks)(records, queries, keep, part=part)


def _scan_schema(records: DataFrame, queries: DataFrame, part: str | None = None) -> str:
    kinds = dict(records.dtypes)
    return f"query_id {dict(queries.dtypes)['query_id']}, memory_id {kinds['memory_id']}, score double" + (f", `{part}` {kinds[part]}" if part else "")


def _scan_broadcast(records: DataFrame, queries: DataFrame, keep: int | None, part: str | None = None) -> DataFrame:
    rows = queries.orderBy("query_id").toPandas()  # bounded by the caller's check
    shared = records.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), unit(rows["vector"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        running: pd.DataFrame | None = None
        for batch in batches:
            if len(batch) and len(names):
                scores = np.round(unit(batch["vector"]) @ q.T, SCORE_DIGITS)
                if part:
                    yield _best_parts(scores, batch["memory_id"].to_numpy(), batch[part].to_numpy(), names, part)
                    continue
                found = _partial(scores, batch["memory_id"].to_numpy(), names, keep)
                if keep is None:
                    yield found
                    continue
                both = found if running is None else pd.concat([running, found])
                running = both.sort_values(["query_id", "score", "memory_id"], ascending=[True, False, True]).groupby("query_id").head(keep)
        if running is not None:
            yield running

    return records.select("memory_id", "vector", *filter(None, [part])).mapInPandas(scan, _scan_schema(records, queries, part))


def _scan_blocks(records: DataFrame, queries: DataFrame, keep: int | None, block_rows: int | None = None, part: str | None = None) -> DataFrame:
    """Record block × query block products in tasks, for query sets too large to broadcast."""
    size = block_rows or BLOCK_ROWS
    scope = F.lit(0).alias("scope")
    own = [part] if part else []
    r = _blocked(records.select(scope, "memory_id", "vector", *own), ["scope"], size)
    q = _blocked(queries.select(scope, F.col("query_id").alias("memory_id"), "vector"), ["scope"], size)
    rb = r.groupBy("scope").agg(F.first("_blocks").alias("_other"))
    qb = q.groupBy("scope").agg(F.first("_blocks").alias("_other"))
    every = F.explode(F.sequence(F.lit(0), F.col("_other") - 1))
    # the unused id is filled, not NULL: a NULL would turn large integer ids into floats inside pandas
    types = dict(records.dtypes)["memory_id"], dict(queries.dtypes)["query_id"]
    left = r.join(F.broadcast(qb), "scope").select(
        "memory_id", F.lit(0).cast(types[1]).alias("query_id"), F.lit(False).alias("asks"), "vector", F.col("_b").alias("_i"), every.alias("_j"), *own
    )
    right = q.join(F.broadcast(rb), "scope").select(
        F.lit(0).cast(types[0]).alias("memory_id"), F.col("memory_id").alias("query_id"), F.lit(True).alias("asks"), "vector", every.alias("_i"), F.col("_b").alias("_j"),
        *[F.lit(0).cast(dict(records.dtypes)[c]).alias(c) for c in own],
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, known = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(asks) or not len(known):
            return pd.DataFrame({c: [] for c in ["query_id", "memory_id", "score", *own]})
        scores = np.round(unit(known["vector"]) @ unit(asks["vector"]).T, SCORE_DIGITS)
        if part:
            return _best_parts(scores, known["memory_id"].to_numpy(), known[part].to_numpy(), asks["query_id"].to_numpy(), part)
        return _partial(scores, known["memory_id"].to_numpy(), asks["query_id"].to_numpy(), keep)

    return left.unionByName(right).groupBy("_i", "_j").applyInPandas(meet, _scan_schema(records, queries, part))


def score_all(records: DataFrame, queries: DataFrame, part: str | None = None) -> DataFrame:
    """Cosine of every record with every query: (query_id, memory_id, score).

    With ``part`` records are parts of memories, numbered by that column: of the parts that a task meets together, each
    memory's best one for each query moves on, with its number; ties go to the smaller number. A memory can have several rows."""
    return _scan(records, queries, None, part)


def top_k(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k records of each query by (score desc, id), with ``rank``.

    records: memory_id, vector. queries: query_id, vector. Each task keeps one running top k over all its batches, so
    the shuffle carries at most k rows per task and query.
    """
    if not 1 <= k <= 100:
        raise ValueError("k must be between 1 and 100")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    return _scan(records, queries, k).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def full_ranking(scored: DataFrame, keys: list[str], min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Rank every scored record of each group; groups of any size."""
    return rank_in_group(scored, keys, [-F.col("score"), F.col("memory_id")], "rank", min_rows)


def vector_violations(vectors: DataFrame, dimension: int, tolerance: float = 1e-3) -> DataFrame:
    """Vectors of the wrong size, with non-finite values, or away from unit length."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = (
        F.when(F.size("vector") != dimension, "size")
        .when(bad, "not_finite")
        .when(F.abs(F.sqrt(square) - 1) > tolerance, "norm")
    )
    return vectors.select("memory_id", reason.alias("reason")).where(F.col("reason").isNotNull())


# --- pairs ------------------------------------------------------------------------------------------------


def _blocked(df: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Add the number of blocks of the row's group and the row's block."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    return df.join(broadcast_if_small(sizes), keys).withColumn("_b", F.pmod(F.xxhash64("memory_id"), F.col("_blocks")).cast("int"))


def similar_pairs(df: DataFrame, keys: list[str], threshold: float, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs (memory_a < memory_b) of a group with cosine ≥ threshold.

    Rows of large groups meet only in cells that they can reach (``cells``); only pairs above the threshold leave a unit.
    """
    return _pair_blocks(df, keys, threshold, block_rows, count_only=False, cell_rows=cell_rows)


def _pair_blocks(df: DataFrame, keys: list[str], threshold: float, block_rows: int, count_only: bool, cell_rows: int = CELL_ROWS) -> DataFrame:
    types = dict(df.dtypes)
    placed = meetings(df.select(*keys, "memory_id", "vector"), keys, threshold, None, block_rows, cell_rows)
    key_schema = "".join(f"{k} {types[k]}, " for k in keys)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        inner, i, j = pdf["_inner"].iloc[0], pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        left = pdf[~pdf["_guest"] & (pdf["_b"] == i)]
        right = pdf[pdf["_guest"]] if not inner else left if i == j else pdf[pdf["_b"] == j]
        group = {k: pdf[k].iloc[0] for k in keys}
        if not len(left) or not len(right):
            hits = np.zeros((0, 2), dtype=int)
            sims = np.zeros((len(left), len(right)))
        else:
            sims = np.clip(np.round(unit(left["vector"]) @ unit(right["vector"]).T, SCORE_DIGITS), -1, 1)
            near = sims >= threshold
            if inner and i == j:
                near &= np.triu(np.ones_like(near), 1)
            hits = np.argwhere(near)
        if count_only:
            return pd.DataFrame({**{k: [v] for k, v in group.items()}, "pairs": [len(hits)]})
        a, b = left["memory_id"].to_numpy()[hits[:, 0]], right["memory_id"].to_numpy()[hits[:, 1]]
        return pd.DataFrame(
            {**group, "memory_a": np.minimum(a, b), "memory_b": np.maximum(a, b), "similarity": sims[hits[:, 0], hits[:, 1]]}
        )

    out = (
        key_schema + "pairs long"
        if count_only
        else f"{key_schema}memory_a {types['memory_id']}, memory_b {types['memory_id']}, similarity double"
    )
    return placed.groupBy(*keys, "_cell", "_inner", "_i", "_j").applyInPandas(product, out)


def first_match(
    rows: DataFrame, reps: DataFrame, keys: list[str], threshold: float, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """For each row the representative of smallest priority with cosine ≥ threshold: keys, memory_id, rep_priority.

    Rows visit the cells of representatives that they can reach. One candidate per row and block of representatives
    leaves a task.
    """
    types = dict(rows.dtypes)
    placed = meetings(reps.select(*keys, "memory_id", "vector", "priority"), keys, threshold, rows, block_rows, cell_rows)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_guest"]], pdf[~pdf["_guest"]].sort_values("priority")
        group = {k: pdf[k].iloc[0] for k in keys}
        if not len(a) or not len(b):
            return pd.DataFrame({**{k: [] for k in keys}, "memory_id": [], "rep_priority": []})
        near = np.round(unit(a["vector"]) @ unit(b["vector"]).T, SCORE_DIGITS) >= threshold
        found = near.any(axis=1)
        first = near.argmax(axis=1)[found]
        return pd.DataFrame(
            {**group, "memory_id": a["memory_id"].to_numpy()[found], "rep_priority": b["priority"].to_numpy()[first].astype("int64")}
        )

    schema = "".join(f"{k} {types[k]}, " for k in keys) + f"memory_id {types['memory_id']}, rep_priority long"
    partial = placed.groupBy(*keys, "_cell", "_i", "_j").applyInPandas(match, schema)
    return partial.groupBy(*keys, "memory_id").agg(F.min("rep_priority").alias("rep_priority"))


# --- representatives --------------------------------------------------------------------------------------


def greedy_representatives(
    df: DataFrame,
    keys: list[str],
    threshold: float,
    batch_rows: int = BATCH_ROWS,
    block_rows: int = BLOCK_ROWS,
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Newest-first greedy deduplication, exact: keys, memory_id, representative_id (itself if kept).

    ``df``: keys, memory_id, event_order, vector. A row is kept unless an already kept, newer row has cosine ≥
    threshold; it is then assigned to the first such row.

    Equal vectors share one fate and are collapsed first. The rest is worked through in priority windows that double:
    rows near a kept one drop out with one match each, and only the survivors of a window are compared with each
    other. A window whose survivors are too dense is halved, so a large cluster costs a match per row, not its
    square. Zero vectors are similar to nothing: under a positive threshold each stands for itself.
    """
    keys = list(keys)
    rows = df.select(*keys, "memory_id", "event_order", "vector")
    if threshold > 0:
        zero = F.forall("vector", lambda v: v == 0)
        alone = rows.where(zero).select(*keys, "memory_id", F.col("memory_id").alias("representative_id"))
        return _greedy_nonzero(rows.where(~zero), keys, threshold, batch_rows, block_rows, min_hot_rows).unionByName(alone)
    return _greedy_nonzero(rows, keys, threshold, batch_rows, block_rows, min_hot_rows)


def _greedy_nonzero(rows: DataFrame, keys: list[str], threshold: float, batch_rows: int, block_rows: int, min_hot_rows: int) -> DataFrame:
    newest = F.struct((-F.col("event_order")).alias("neg"), F.col("memory_id").alias("memory_id"))
    proxies = rows.groupBy(*keys, "vector").agg(F.min(newest).alias("p")).select(
        *keys, "vector", F.col("p.memory_id").alias("memory_id"), (-F.col("p.neg")).alias("event_order")
    )
    ranked = cut(rank_in_group(proxies, keys, [-F.col("event_order"), F.col("memory_id")], "priority", min_hot_rows))
    last = ranked.agg(F.max("priority").alias("m")).first().m or 0
    reps = assigned = None
    low, size = 0, batch_rows
    while low < last:
        window = ranked.where((F.col("priority") > low) & (F.col("priority") <= low + size))
        matched = None
        if reps is not None:
            matched = cut(first_match(window, reps, keys, threshold, block_rows))
            window = cut(window.join(matched, [*keys, "memory_id"], "left_anti"))
        top = largest_group(window, keys)
        if top <= batch_rows:
            decided = cut(_greedy_in_task(window, keys, threshold))
        else:
            pairs = _pair_blocks(window, keys, threshold, block_rows, count_only=True)
            crowded = pairs.agg(F.sum("pairs").alias("p")).first().p > PAIRS_PER_ROW * window.count()
            if crowded and size > batch_rows:
                size = max(batch_rows, size // 2)
                continue
            decided = _greedy_by_rounds(window, keys, threshold, block_rows)
        new_reps = ranked.join(decided.where("rep_priority = priority").select(*keys, "memory_id"), [*keys, "memory_id"], "left_semi")
        reps = new_reps if reps is None else reps.unionByName(new_reps)
        reps = cut(reps)
        step = decided.select(*keys, "memory_id", "rep_priority")
        if matched is not None:
            step = step.unionByName(matched)
        assigned = step if assigned is None else assigned.unionByName(step)
        low, size = low + size, size * 2
    if assigned is None:
        return rows.select(*keys, "memory_id", F.col("memory_id").alias("representative_id")).limit(0)
    names = reps.select(*keys, F.col("priority").alias("rep_priority"), F.col("memory_id").alias("representative_id"))
    fates = assigned.join(names, [*keys, "rep_priority"]).join(ranked.select(*keys, "memory_id", "vector"), [*keys, "memory_id"])
    return rows.join(fates.select(*keys, "vector", "representative_id"), [*keys, "vector"]).select(
        *keys, "memory_id", "representative_id"
    )


def _greedy_in_task(window: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Sequential greedy on at most one batch of rows per group."""
    types = dict(window.dtypes)
    schema = "".join(f"{k} {types[k]}, " for k in keys) + f"memory_id {types['memory_id']}, priority long, rep_priority long"

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("priority")
        x = unit(pdf["vector"])
        near = np.round(x @ x.T, SCORE_DIGITS) >= threshold
        owner = np.full(len(pdf), -1)
        for i in range(len(pdf)):
            if owner[i] < 0:
                free = (owner < 0) & near[i]
                free[:i] = False
                owner[free] = i
                owner[i] = i
        priority = pdf["priority"].to_numpy()
        group = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**group, "memory_id": pdf["memory_id"].to_numpy(), "priority": priority, "rep_priority": priority[owner]})

    return window.groupBy(*keys).applyInPandas(greedy, schema)


def _greedy_by_rounds(window: DataFrame, keys: list[str], threshold: float, block_rows: int) -> DataFrame:
    """The same result from the pairs above the threshold, in parallel rounds: keep every undecided row without an
    undecided newer neighbour, drop the neighbours of what was kept, repeat."""
    ids = window.select(*keys, "memory_id", "priority")
    pairs = similar_pairs(window, keys, threshold, block_rows)
    pa = ids.select(*keys, F.col("memory_id").alias("memory_a"), F.col("priority").alias("pa"))
    pb = ids.select(*keys, F.col("memory_id").alias("memory_b"), F.col("priority").alias("pb"))
    edges = cut(
        pairs.join(pa, [*keys, "memory_a"]).join(pb, [*keys, "memory_b"]).select(
            *keys, F.least("pa", "pb").alias("hi"), F.greatest("pa", "pb").alias("lo")
        )
    )
    every_edge = edges
    undecided = ids.select(*keys, F.col("priority").alias("p"))
    kept = []
    while not edges.isEmpty():
        blocked = edges.select(*keys, F.col("lo").alias("p")).distinct()
        keep = cut(undecided.join(blocked, [*keys, "p"], "left_anti"))
        kept.append(keep)
        drop = edges.join(keep.withColumnRenamed("p", "hi"), [*keys, "hi"], "left_semi").select(*keys, F.col("lo").alias("p")).distinct()
        undecided = cut(undecided.join(keep, [*keys, "p"], "left_anti").join(drop, [*keys, "p"], "left_anti"))
        alive_hi, alive_lo = undecided.withColumnRenamed("p", "hi"), undecided.withColumnRenamed("p", "lo")
        edges = cut(edges.join(alive_hi, [*keys, "hi"], "left_semi").join(alive_lo, [*keys, "lo"], "left_semi"))
    kept.append(undecided)
    chosen = kept[0]
    for k in kept[1:]:
        chosen = chosen.unionByName(k)
    chosen = cut(chosen)
    owner = every_edge.join(chosen.withColumnRenamed("p", "hi"), [*keys, "hi"], "left_semi").groupBy(*keys, F.col("lo").alias("priority")).agg(
        F.min("hi").alias("owner")
    )
    own = chosen.select(*keys, F.col("p").alias("priority"), F.col("p").alias("self"))
    return cut(
        ids.join(own, [*keys, "priority"], "left").join(owner, [*keys, "priority"], "left").select(
            *keys, "memory_id", "priority", F.coalesce("self", "owner").alias("rep_priority")
        )
    )


def semantic_order(df: DataFrame, fates: DataFrame, keys: list[str], min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Representatives newest first, then the suppressed rows newest first as backfill: adds ``position``."""
    joined = df.join(fates, [*keys, "memory_id"]).withColumn(
        "suppressed", (F.col("memory_id") != F.col("representative_id")).cast("int")
    )
    return rank_in_group(joined, keys, [F.col("suppressed"), -F.col("event_order"), F.col("memory_id")], "position", min_rows)


def dedup_select(df: DataFrame, fates: DataFrame, keys: list[str], budget: str, cost: str) -> DataFrame:
    """Keep representatives only, newest first, while they fit the token budget."""
    from ledgerkeep.operators.selection import greedy_select

    reps = df.join(fates.where(F.col("memory_id") == F.col("representative_id")), [*keys, "memory_id"])
    return greedy_select(reps, keys, cost=cost, score="event_order", budget=budget)
