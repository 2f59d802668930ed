"""Reading from kept sets: one similarity pass, ranked once, filtered per kept set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkeep.operators.reading import read_flags, read_means, read_sets


def ranked(memories: Column, score: Callable[[Column], Column]) -> Column:
    """Memories of a snapshot in retrieval order (score desc, id), as structs id and cost.

    The score of a memory does not depend on what else is kept, so this is computed once and every kept set filters it.
    """
    entry = F.transform(memories, lambda m: F.struct((-score(m)).alias("neg"), m.memory_id.alias("id"), m.cost.cast("long").alias("cost")))
    return F.transform(F.array_sort(entry), lambda e: F.struct(e.id.alias("id"), e.cost.alias("cost")))


def read_context(ranking: Column, top_k: int | None, read_budget: int, separator: int = 1) -> Column:
    """struct(ids, tokens): the first ``top_k`` entries (None: all), each added if the joined text still fits (skip, not stop)."""
    start = F.struct(
        F.transform(F.filter(ranking, lambda e: F.lit(False)), lambda e: e.id).alias("ids"),
        F.lit(0).cast("long").alias("tokens"),
    )

    def step(acc: Column, e: Column) -> Column:
        joined = acc.tokens + e.cost + F.when(F.size(acc.ids) > 0, F.lit(separator)).otherwise(F.lit(0))
        return F.when(
            joined <= read_budget,
            F.struct(F.concat(acc.ids, F.array(e.id)).alias("ids"), joined.cast("long").alias("tokens")),
        ).otherwise(acc)

    return F.aggregate(ranking if top_k is None else F.slice(ranking, 1, top_k), start, step)


def answers_of_sets(cases: DataFrame, top_k: int, read_budget: int) -> DataFrame:
    """``cases`` with ``answers``: for each entry of ``sets`` an array of what was read for each of the ``questions``.

    ``cases``: one row per snapshot with memory_ids, sets (structs with storage_ids) and questions (structs with query_id,
    ranking, supports and ids). Nothing is shuffled or repeated: what follows can go on inside the row.
    """
    kind = dict(cases.dtypes)["memory_ids"][len("array<") : -1]
    kept = F.transform("sets", lambda s: s.storage_ids)
    return cases.withColumn("answers", read_sets(kind, F.col("memory_ids"), kept, F.col("questions"), top_k, read_budget))


def scores_of_sets(cases: DataFrame, top_k: int, read_budget: int) -> DataFrame:
    """``cases`` as for ``answers_of_sets`` with ``scores``: for each entry of ``sets`` the means over the questions."""
    kept = F.transform("sets", lambda s: s.storage_ids)
    return cases.withColumn("scores", read_means(F.col("memory_ids"), kept, F.col("questions"), top_k, read_budget))


def flags_of_sets(cases: DataFrame, top_k: int, read_budget: int) -> DataFrame:
    """``answers_of_sets`` with support_read and support_kept only."""
    kept = F.transform("sets", lambda s: s.storage_ids)
    return cases.withColumn("answers", read_flags(F.col("memory_ids"), kept, F.col("questions"), top_k, read_budget))


def answer_rows(cases: DataFrame) -> DataFrame:
    """One row per set and question of ``answers_of_sets``, with the other columns of the snapshot."""
    others = [c for c in cases.columns if c not in ("memory_ids", "sets", "questions", "answers")]
    others += [c for c in cases.columns if c == "memory_ids"]
    by_set = cases.select(*others, "questions", F.inline(F.arrays_zip("sets", "answers")))
    by_ask = by_set.select(*others, "sets", F.inline(F.arrays_zip("questions", "answers")))
    return by_ask.select(*others, "sets.*", "questions.*", "answers.*")


def retrieve_from_sets(
    conditions: DataFrame, rankings: DataFrame, top_k: int, read_budget: int
) -> DataFrame:
    """Context of every (kept set, query): snapshot_id, storage_ids, query_id, context_ids, memory_tokens.

    Both sides are gathered to one row per snapshot, and meet there. ``rankings``: snapshot_id, query_id, ranking, supports, ids.
    """
    sets = conditions.groupBy("snapshot_id").agg(F.collect_list(F.struct(*[c for c in conditions.columns if c != "snapshot_id"])).alias("sets"))
    asked = rankings.groupBy("snapshot_id").agg(F.collect_list(F.struct("query_id", "ranking", "supports", "ids")).alias("questions"))
    ids = F.transform(F.get("questions", F.lit(0)).ranking, lambda e: e.id)
    cases = sets.join(asked, "snapshot_id").withColumn("memory_ids", ids)
    rows = answer_rows(answers_of_sets(cases, top_k, read_budget))
    stored = F.filter("ranking", lambda e: F.array_contains("storage_ids", e.id))
    return rows.select(
        *conditions.columns, "query_id", "supports", "ids", F.transform(stored, lambda e: e.id).alias("ranking_ids"), "context_ids", "memory_tokens"
    )


def covers(groups: Column, ids: Column) -> Column:
    """Some alternative support set lies completely inside ``ids``."""
    return F.exists(groups, lambda g: F.forall(g, lambda m: F.array_contains(ids, m)))


def cheapest_support(groups: Column, costs: Column) -> Column:
    """Cost of the cheapest alternative; ``costs`` maps ids to costs, each id counts once."""
    return F.array_min(
        F.transform(
            groups,
            lambda g: F.aggregate(F.array_distinct(g), F.lit(0).cast("long"), lambda s, m: s + F.element_at(costs, m)),
        )
    )


def without(context: Column, deleted: Column) -> Column:
    """The context minus one memory; order kept, nothing moves up from storage."""
    return F.filter(context, lambda m: m != deleted)


def context_deletions(full: DataFrame) -> DataFrame:
    """The answers of ``full`` with one memory taken out of what was read: a row for every answer and every memory that its
    ``planned_ids`` name. Order is kept and nothing moves up from storage; a memory that was not read leaves the context
    as it is."""
    both = full.withColumn("deleted_memory_id", F.explode(F.array_distinct("planned_ids"))).drop("planned_ids")
    return both.withColumn("context_ids", without(F.col("context_ids"), F.col("deleted_memory_id")))


def read_memories(answers: Column) -> Column:
    """Every memory that some of a snapshot's answers read."""
    return F.array_distinct(F.flatten(F.transform(answers, lambda a: a.context_ids)))


def context_controls(full: DataFrame, scenario: str) -> DataFrame:
    """Ordered contexts for one scenario: the first support set forward and reversed, and the full context
    minus each support member. ``full`` has scenario, context_ids and supports per (snapshot, query)."""
    base = full.where(F.col("scenario") == scenario).withColumn("support", F.array_sort(F.get("supports", F.lit(0))))
    none = F.lit(None).cast(dict(base.dtypes)["context_ids"][len("array<"):-1])
    fixed = F.array(
        F.struct(F.lit("context_support_forward").alias("condition"), none.alias("deleted"), F.col("support").alias("ids")),
        F.struct(
            F.lit("context_support_reversed").alias("condition"), none.alias("deleted"), F.reverse("support").alias("ids")
        ),
    )
    deletions = F.transform(
        "support",
        lambda m: F.struct(
            F.lit("context_deletion").alias("condition"), m.alias("deleted"), without(F.col("context_ids"), m).alias("ids")
        ),
    )
    return base.select("snapshot_id", "query_id", F.inline(F.concat(fixed, deletions)))
