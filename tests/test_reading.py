import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerkeep.operators import evaluation as ev
from ledgerkeep.operators import reading

CASE = """snapshot_id long, memory_ids array<string>, sets array<struct<storage_ids: array<string>>>,
questions array<struct<query_id: string, ranking: array<struct<id: string, cost: long>>, supports: array<array<string>>, ids: array<string>>>"""


def read(ranking, kept, top_k, budget):
    spent, out = 0, []
    for m, cost in [e for e in ranking if e[0] in kept][:top_k]:
        joined = spent + cost + bool(out)
        if joined <= budget:
            out, spent = [*out, m], joined
    return out, spent


@pytest.mark.parametrize(("top_k", "cells"), [(3, reading.CELLS), (None, 50)])
def test_sets_against_plain_loops(spark, monkeypatch, top_k, cells):
    monkeypatch.setattr(reading, "CELLS", cells)
    rng = random.Random(8)
    some = lambda ids, most: rng.sample(ids, rng.randint(0, min(most, len(ids))))
    rows = []
    for s, n in enumerate([*[rng.randint(1, 7) for _ in range(40)], 90, 0]):
        ids = [f"m{i}" for i in rng.sample(range(200), n)]
        asked = []
        for q in range(rng.randint(0, 3)):
            ranking = [(m, rng.randint(1, 40)) for m in rng.sample(ids, n)]
            supports = [[*some(ids, 3), *rng.choice([[], [], ["elsewhere"]])] for _ in range(rng.randint(0, 3))]
            asked.append((f"q{q}", ranking, supports, some(ids, 5)))
        rows.append((s, ids, [(some(ids, 90),) for _ in range(rng.randint(0, 5))], asked))
    cases = spark.createDataFrame(rows, CASE).coalesce(1)
    means = {r.snapshot_id: r.scores for r in ev.scores_of_sets(cases, top_k, 60).collect()}
    found = {r.snapshot_id: r.answers for r in ev.answers_of_sets(cases, top_k, 60).collect()}
    for s, _, sets, asked in rows:
        assert len(found[s]) == len(sets)
        for (kept,), by_ask in zip(sets, found[s]):
            assert len(by_ask) == len(asked)
            for (_, ranking, supports, gold), a in zip(asked, by_ask):
                context, spent = read(ranking, kept, top_k, 60)
                assert (a.context_ids, a.memory_tokens, a.gold_read) == (context, spent, len(set(gold) & set(context)))
                assert a.support_read == any(set(g) <= set(context) for g in supports)
                assert a.support_kept == any(set(g) <= set(kept) for g in supports)
        for by_ask, mean in zip(found[s], means[s]):
            f1 = [2 * a.gold_read / (len(q[3]) + len(a.context_ids)) if a.gold_read else 0.0 for a, q in zip(by_ask, asked)]
            for values, m in (([a.support_read for a in by_ask], mean.support_read), (f1, mean.token_f1), ([a.memory_tokens for a in by_ask], mean.read_tokens)):
                assert m == (pytest.approx(sum(values) / len(values)) if asked else None)


def shuffles(spark, name):
    """Exchanges of rows that have been dealt once; broadcasts do not count."""
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(" Exchange " in line for line in plan.splitlines())


@pytest.mark.parametrize(("name", "most"), [
    ("b10_intervention_rules", 3),
    ("h7_condition_labels", 6),
    ("h9_reliability_gate", 14),
    ("h7_repeated_labels", 3),
    ("g7_hindsight_plans", 3),
    ("h25_subset_scores", 1),
    ("h27_pairwise_interaction", 2),
    ("h17_primary_average", 5),
    ("h21_failure_taxonomy", 5),
    ("h29_cohort_summary", 5),
])
def test_answers_of_sets_are_not_shuffled(spark, name, most):
    assert shuffles(spark, name) <= most


def test_slim_answers_give_the_same_failures(spark):
    from ledgerkeep.operators import metrics as met
    from ledgerkeep.operators.evaluation import answer_rows, answers_of_sets
    from ledgerkeep.plans import baskets as bk
    from ledgerkeep.plans import retention

    folder = "/root/testdata/sf0.001"
    read = answers_of_sets(retention.planned_cases(spark, folder), bk.TOP_K, bk.READ_BUDGET)
    costs = F.map_from_entries(F.transform("memories", lambda m: F.struct(m.memory_id, m.cost)))
    whole = met.failure_table(bk.scored(answer_rows(read.withColumns({"costs": costs, "seed": F.lit(0).cast("long")}))))
    slim = retention.failures(spark, folder, by_trajectory=True)
    columns = sorted(c for c in slim.columns if c in whole.columns)
    assert {"category", "minimum_support_tokens", "nothing_fits", "record_count", "query_id", "hit_but_wrong"} <= set(columns)
    one = lambda df: sorted(map(repr, df.select(columns).collect()))
    assert one(slim) == one(whole)
    plan = slim._jdf.queryExecution().optimizedPlan().toString()
    moved = plan.index("RepartitionByExpression [trajectory_id")
    assert plan.rindex("Generate inline(arrays_zip") < moved  # what moves is one row a snapshot
