"""Reading from ranked records: budgeted contexts, history features, target ranks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkeep.operators.ordered import MIN_HOT_ROWS, rank_in_group, running_sum
from ledgerkeep.operators.similarity import SCORE_DIGITS, _blocked, unit
from ledgerkeep.operators.sizing import broadcast_if_small, largest_group

PAIR_LIMIT = 256
#: Keys over which the empty groups of a ranking are spread.
EMPTY_SALTS = 64


def budgeted_context(hits: DataFrame, keys: list[str], read_budget: int, separator: int = 1) -> DataFrame:
    """The hits of each query that fit the read budget, in rank order (skip, do not stop).

    ``hits``: keys, memory_id, rank, cost; limited by the caller to the k rows per query it wants, and all of them count.
    """
    from ledgerkeep.operators.evaluation import read_context

    entry = F.struct("rank", F.col("memory_id").alias("id"), F.col("cost").cast("long").alias("cost"))
    grouped = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("ranking"))
    read = read_context(F.col("ranking"), None, read_budget, separator)
    return grouped.select(*keys, read.alias("r")).select(*keys, F.col("r.ids").alias("context_ids"), F.col("r.tokens").alias("memory_tokens"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def available_counts(events: DataFrame, keys: list[str], order: list[Column], is_memory: Column, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """How many memories precede each row of a stream: a running count, no pairing."""
    return running_sum(events, keys, order, is_memory.cast("long"), "available", min_rows)


def future_history(history: DataFrame, decisions: DataFrame) -> DataFrame:
    """History queries at or after the decision: future information, which must not exist."""
    return history.join(decisions.select("snapshot_id", "decision"), "snapshot_id").where(F.col("event_order") >= F.col("decision"))


def history_reads(
    memories: DataFrame, history: DataFrame, top_k: int, pair_limit: int = PAIR_LIMIT, block_rows: int = 1024
) -> tuple[DataFrame, DataFrame]:
    """Past-only similarity: (hits, best).

    memories: snapshot_id, memory_id, event_order, vector. history: snapshot_id, query_id, event_order, vector.
    A query sees memories with a smaller event order. hits: the top k memories per query. best: per memory the
    largest score over all queries that saw it.

    Snapshots of few memories are joined in the JVM. Larger ones meet block by block in tasks, which emit a partial
    top k per query and a partial maximum per memory instead of every pair.
    """
    w = Window.partitionBy("snapshot_id", "query_id").orderBy(F.desc("score"), "memory_id")

    def ranked(scores: DataFrame) -> DataFrame:
        return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)

    def best(scores: DataFrame) -> DataFrame:
        return scores.groupBy("snapshot_id", "memory_id").agg(F.max("score").alias("historical_similarity"))

    def pairs(m: DataFrame, h: DataFrame) -> DataFrame:
        q = h.select("snapshot_id", "query_id", F.col("event_order").alias("_q"), F.col("vector").alias("_qv"))
        joined = m.join(q, "snapshot_id").where(F.col("event_order") < F.col("_q"))
        return joined.select("snapshot_id", "query_id", "memory_id", F.round(dot(F.col("vector"), F.col("_qv")), SCORE_DIGITS).alias("score"))

    if largest_group(memories, ["snapshot_id"]) <= pair_limit:
        scores = pairs(memories, history)
        return ranked(scores), best(scores)
    sizes = memories.groupBy("snapshot_id").agg(F.count("*").alias("_n"))
    large = broadcast_if_small(sizes.where(F.col("_n") > pair_limit).select("snapshot_id"))
    small = pairs(memories.join(large, "snapshot_id", "left_anti"), history)
    blocks = _history_blocks(
        memories.join(large, "snapshot_id", "left_semi"), history.join(large, "snapshot_id", "left_semi"), top_k, block_rows
    )
    hits = blocks.where(F.col("query_id").isNotNull()).unionByName(small)
    maxima = blocks.where(F.col("query_id").isNull()).unionByName(small)
    return ranked(hits), best(maxima)


def _history_blocks(memories: DataFrame, history: DataFrame, top_k: int, block_rows: int) -> DataFrame:
    """Partial results of memory block × query block; result rows without a query carry a memory's maximum.

    Input rows fill the id they do not have: a NULL would turn large integer ids into floats inside pandas.
    """
    key = ["snapshot_id"]
    m = _blocked(memories.select("snapshot_id", "memory_id", "event_order", "vector"), key, block_rows)
    q = _blocked(
        history.select("snapshot_id", F.col("query_id").alias("memory_id"), "event_order", "vector"), key, block_rows
    )
    mb = m.groupBy("snapshot_id").agg(F.first("_blocks").alias("_mb"))
    qb = q.groupBy("snapshot_id").agg(F.first("_blocks").alias("_qb"))
    ids = dict(memories.dtypes), dict(history.dtypes)
    m2 = m.join(broadcast_if_small(qb), key).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_qb") - 1))).select(
        "snapshot_id", "memory_id", F.lit(0).cast(ids[1]["query_id"]).alias("query_id"), F.lit(False).alias("asks"), "event_order", "vector", F.col("_b").alias("_i"), "_j"
    )
    q2 = q.join(broadcast_if_small(mb), key).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_mb") - 1))).select(
        "snapshot_id",
        F.lit(0).cast(ids[0]["memory_id"]).alias("memory_id"),
        F.col("memory_id").alias("query_id"),
        F.lit(True).alias("asks"),
        "event_order",
        "vector",
        "_i",
        F.col("_b").alias("_j"),
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        qs, ms = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("memory_id")
        out = {"snapshot_id": [], "query_id": [], "memory_id": [], "score": []}
        if not len(qs) or not len(ms):
            return pd.DataFrame(out)
        seen = ms["event_order"].to_numpy()[None, :] < qs["event_order"].to_numpy()[:, None]
        raw = np.stack(list(qs["vector"])) @ np.stack(list(ms["vector"])).T
        scores = np.where(seen, np.round(raw, SCORE_DIGITS), -np.inf)
        names, mids, sid = qs["query_id"].to_numpy(), ms["memory_id"].to_numpy(), pdf["snapshot_id"].iloc[0]
        order = np.argsort(-scores, axis=1, kind="stable")[:, :top_k]
        rows = np.repeat(np.arange(len(names)), order.shape[1])
        hit = pd.DataFrame({"snapshot_id": sid, "query_id": names[rows], "memory_id": mids[order.ravel()], "score": scores[rows, order.ravel()]})
        peak = pd.DataFrame({"snapshot_id": sid, "query_id": None, "memory_id": mids, "score": scores.max(axis=0)})
        # as objects, so that the missing query of a peak does not turn integer ids into floats
        both = pd.concat([hit.astype({"query_id": object}), peak.astype({"query_id": object})])
        return both[np.isfinite(both["score"])]

    schema = f"snapshot_id {ids[0]['snapshot_id']}, query_id {ids[1]['query_id']}, memory_id {ids[0]['memory_id']}, score double"
    return m2.unionByName(q2).groupBy("snapshot_id", "_i", "_j").applyInPandas(meet, schema)


def history_features(
    memories: DataFrame,
    history: DataFrame,
    decisions: DataFrame,
    top_k: int,
    read_budget: int,
    min_hot_rows: int = MIN_HOT_ROWS,
    **block_options: int,
) -> DataFrame:
    """The past-only feature row of every memory.

    memories: snapshot_id, memory_id, event_order, vector, cost. history: snapshot_id, query_id, event_order, vector.
    decisions: snapshot_id, decision.
    """
    hits, best = history_reads(memories, history, top_k, **block_options)
    costs = memories.select("snapshot_id", "memory_id", "cost")
    contexts = budgeted_context(hits.join(costs, ["snapshot_id", "memory_id"]), ["snapshot_id", "query_id"], read_budget)
    frequency = contexts.select("snapshot_id", F.explode("context_ids").alias("memory_id")).groupBy("snapshot_id", "memory_id").agg(
        F.count("*").alias("retrieval_frequency")
    )
    ranked = rank_in_group(
        memories.drop("vector"), ["snapshot_id"], [-F.col("event_order"), F.col("memory_id")], "_rank", min_hot_rows
    )
    key = ["snapshot_id", "memory_id"]
    return (
        ranked.join(frequency, key, "left")
        .join(best, key, "left")
        .join(broadcast_if_small(decisions.select("snapshot_id", "decision")), "snapshot_id")
        .select(
            *key,
            (F.col("_rank") - 1).alias("recency_rank"),
            (F.col("decision") - F.col("event_order")).alias("age"),
            F.coalesce("retrieval_frequency", F.lit(0)).alias("retrieval_frequency"),
            F.col("historical_similarity").isNotNull().alias("history_observed"),
            "historical_similarity",
            F.col("cost").alias("memory_tokens"),
        )
    )


def stratified_sample(rows: DataFrame, keys: list[str], stratum: Column, n: int, draw: Column, tie: str) -> DataFrame:
    """n rows per group and stratum by smallest seeded draw; a small limit per group, reduced before the shuffle."""
    w = Window.partitionBy(*keys, "stratum").orderBy(draw, tie)
    return rows.withColumn("stratum", stratum).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def target_ranks(scored: DataFrame, queries: DataFrame, keys: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """Rank of the target record and of its fact per query, without sorting anything.

    The rank of a row is one plus the rows that beat it. Two aggregate passes find the best target rows and count
    what beats them, so a group of any size is spread over all tasks.
    scored: keys, query_id, memory_id, canonical_id, score. queries: query_id, target_memory_id,
    target_canonical_id, superseded_memory_id. NULL ranks mark missing targets. ``groups`` lists the keys that must
    appear: one that kept nothing still has a row for every query, so its missing targets stay in the denominator.
    """
    keys = list(keys)
    place = F.struct((-F.col("score")).alias("neg"), F.col("memory_id").alias("memory_id"))
    facts = broadcast_if_small(queries)
    rows = scored.join(facts, "query_id").withColumn("place", place)
    # what an aggregate keeps are numbers, which need no sort; a target's id is known, so its place follows from its score
    is_target = F.col("memory_id") == F.col("target_memory_id")
    marks = rows.groupBy(*keys, "query_id").agg(
        F.count_if(is_target).alias("targets"),
        F.count_if(is_target & F.col("score").isNull()).alias("unscored"),
        F.min(F.when(is_target, F.col("place.neg"))).alias("exact_neg"),
        F.min(F.when(F.col("canonical_id") == F.col("target_canonical_id"), F.col("place"))).alias("fact_place"),
        F.min_by("canonical_id", "place").alias("first_fact"),
    )
    marks = broadcast_if_small(marks.withColumn("exact_neg", F.when(F.col("unscored") == 0, F.col("exact_neg"))).drop("unscored"))
    exact_place = F.struct(F.col("exact_neg").alias("neg"), F.col("target_memory_id").alias("memory_id"))
    counted = rows.join(marks, [*keys, "query_id"]).groupBy(*keys, "query_id").agg(
        F.count_if(F.col("place") < exact_place).alias("before_exact"), F.count_if(F.col("place") < F.col("fact_place")).alias("before_fact")
    )
    counted = counted.join(marks, [*keys, "query_id"]).select(
        *keys, "query_id",
        F.when(F.col("targets") > 0, F.col("before_exact") + 1).alias("exact_rank"),
        F.when(F.col("fact_place").isNotNull(), F.col("before_fact") + 1).alias("fact_rank"),
        "first_fact",
    )
    # with keys, every query met every kept record, so all (keys, query) pairs of non-empty groups are already there
    whole = counted.join(facts, "query_id") if keys else queries.join(counted, "query_id", "left")
    if keys and groups is not None:
        empty = groups.select(*keys).distinct().join(scored.select(*keys).distinct(), keys, "left_anti")
        # every query meets every empty group, as the result asks; the groups are spread over EMPTY_SALTS keys
        spread = empty.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(EMPTY_SALTS)))
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(EMPTY_SALTS - 1).cast("long")))
        every = queries.withColumn("_salt", salts).join(spread, "_salt").drop("_salt")
        whole = whole.unionByName(every, allowMissingColumns=True)
    return whole.withColumn(
        "old_first", F.coalesce(F.col("first_fact") == F.col("superseded_memory_id"), F.lit(False))
    )
