import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerkeep.operators import cells
from ledgerkeep.operators import chunks as ch
from ledgerkeep.operators import retrieval as ret
from ledgerkeep.operators import similarity as sim


def vectors(n=260, dim=6, seed=1, copies=60):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[:copies] = v[0]  # a large group of exact copies
    v[copies : 2 * copies] = v[copies] + 0.05 * rng.normal(size=(copies, dim))  # and one of near copies
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    v = vectors()
    order = np.random.default_rng(2).permutation(len(v))
    rows = [("g", i, int(order[i]), v[i].tolist()) for i in range(len(v))]
    return v, order, spark.createDataFrame(rows, "g string, memory_id long, event_order long, vector array<double>").cache()


def brute(v, order, threshold):
    sims = np.round(v @ v.T, 12)
    reps, owner = [], {}
    for i in sorted(range(len(v)), key=lambda i: (-order[i], i)):
        hit = next((r for r in reps if sims[i, r] >= threshold), None)
        if hit is None:
            reps.append(i)
        owner[i] = i if hit is None else hit
    return owner


@pytest.mark.parametrize(("batch", "block"), [(4096, 2048), (16, 16), (64, 32)])
@pytest.mark.parametrize("threshold", [0.7, 0.95])
def test_representatives_equal_the_sequential_rule(data, batch, block, threshold):
    v, order, df = data
    got = {r.memory_id: r.representative_id for r in sim.greedy_representatives(df, ["g"], threshold, batch, block).collect()}
    assert got == brute(v, order, threshold)


def test_parallel_rounds_equal_the_sequential_rule(data, monkeypatch):
    v, order, df = data
    ranked = sim.rank_in_group(df, ["g"], [-F.col("event_order"), F.col("memory_id")], "priority")
    expected = brute(v, order, 0.8)
    names = {r.priority: r.memory_id for r in ranked.collect()}
    got = {r.memory_id: names[r.rep_priority] for r in sim._greedy_by_rounds(ranked, ["g"], 0.8, 50).collect()}
    assert got == expected


@pytest.mark.parametrize("threshold", [-0.5, 0.6, 0.97])
def test_cells_lose_no_pair_and_compare_few(spark, threshold):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    v = centres[rng.integers(40, size=900)] + 0.04 * rng.normal(size=(900, 8))
    v[:3] = 0
    v[3:90] = v[3]  # copies
    rows = [("h" if i % 3 else "g", int(i), [float(a) for a in x]) for i, x in enumerate(v)] + [("s", 5000, [1.0] * 8), ("s", 5001, [1.0] * 8)]
    df = spark.createDataFrame(rows, "g string, memory_id long, vector array<double>").repartition(3)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    near = np.round(u @ u.T, 12) >= threshold
    expected = {(i, j) for i in range(900) for j in np.flatnonzero(near[i]).tolist() if i < j and (i % 3 == 0) == (j % 3 == 0)} | {(5000, 5001)}
    found = [(r.memory_a, r.memory_b) for r in sim.similar_pairs(df, ["g"], threshold, 64, 20).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    units = cells.meetings(df, ["g"], threshold, None, 64, 20)
    if threshold > 0.9:
        assert cells.compared(units, ["g"]) < 0.25 * (300 * 299 + 600 * 599) / 2
    reps = df.where("memory_id % 7 = 0").withColumn("priority", F.col("memory_id") * -1)
    firsts = {r.memory_id: r.rep_priority for r in sim.first_match(df, reps, ["g"], threshold, 64, 20).collect()}
    for i in range(900):
        hits = [-int(j) for j in np.flatnonzero(near[i]) if j % 7 == 0 and (i % 3 == 0) == (j % 3 == 0)]
        assert firsts.get(i) == (min(hits) if hits else None)


def test_similar_pairs_do_not_depend_on_blocks(data):
    v, _, df = data
    sims = np.round(v @ v.T, 12)
    expected = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if sims[i, j] >= 0.6}
    for block in (10**6, 40):
        assert {(r.memory_a, r.memory_b) for r in sim.similar_pairs(df, ["g"], 0.6, block).collect()} == expected


def test_top_k_with_ties(data, spark, monkeypatch):
    v, _, df = data
    queries = spark.createDataFrame([(j, v[j].tolist()) for j in (0, 70, 200)], "query_id long, vector array<double>")
    sims = np.round(v @ v.T, 12)
    expected = {(q, rank + 1): int(i) for q in (0, 70, 200) for rank, i in enumerate(np.lexsort((np.arange(len(v)), -sims[:, q]))[:7])}
    for most in (4096, 2):  # broadcast, then blocks
        monkeypatch.setattr(sim, "BROADCAST_QUERIES", most)
        monkeypatch.setattr(sim, "BLOCK_ROWS", 2048 if most == 4096 else 100)
        got = {(r.query_id, r.rank): r.memory_id for r in sim.top_k(df.repartition(5), queries, 7).collect()}
        assert got == expected


def test_dedup_example(spark):
    rows = [("g", "m1", 1, [1.0, 0.0]), ("g", "m2", 2, [0.95, 0.3122]), ("g", "m3", 3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, memory_id string, event_order long, vector array<double>")
    fates = sim.greedy_representatives(df, ["g"], 0.9)
    assert {r.memory_id: r.representative_id for r in fates.collect()} == {"m1": "m2", "m2": "m2", "m3": "m3"}
    kept = sim.dedup_select(df.drop("vector").selectExpr("*", "5 as cost", "10 as budget"), fates, ["g"], "budget", "cost")
    assert {r.memory_id for r in kept.collect()} == {"m2", "m3"}


def test_semantic_order_example(spark):
    rows = [("g", "old", 0, [0.0, 1.0]), ("g", "new", 1, [1.0, 0.0]), ("g", "copy", 2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, memory_id string, event_order long, vector array<double>")
    order = sim.semantic_order(df, sim.greedy_representatives(df, ["g"], 0.95), ["g"])
    assert [r.memory_id for r in order.orderBy("position").collect()] == ["copy", "old", "new"]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_history_blocks_equal_the_join(spark, limit):
    rng = np.random.default_rng(4)
    big = 2**60  # ids beyond the exact range of doubles
    m = [("s", big + i, int(rng.integers(100)), rng.normal(size=4).tolist(), 3) for i in range(60)]
    q = [("s", big + i, int(rng.integers(100)), rng.normal(size=4).tolist()) for i in range(40)]
    memories = spark.createDataFrame(m, "snapshot_id string, memory_id long, event_order long, vector array<double>, cost long")
    history = spark.createDataFrame(q, "snapshot_id string, query_id long, event_order long, vector array<double>")
    hits, best = ret.history_reads(memories, history, 3, pair_limit=limit, block_rows=16)
    expected_hits, peak = set(), {}
    for _, qid, qt, qv in q:
        seen = sorted((-round(float(np.dot(x[3], qv)), 12), x[1]) for x in m if x[2] < qt)
        expected_hits |= {(qid, mid, r + 1) for r, (_, mid) in enumerate(seen[:3])}
        for s, mid in seen:
            peak[mid] = max(peak.get(mid, -9.0), -s)
    assert {(r.query_id, r.memory_id, r.rank) for r in hits.collect()} == expected_hits
    got = {r.memory_id: r.historical_similarity for r in best.collect()}
    assert got.keys() == peak.keys() and all(abs(got[k] - peak[k]) < 1e-9 for k in peak)


def test_target_ranks_examples(spark):
    queries = spark.createDataFrame([("q1", "t", "ft", "old")], "query_id string, target_memory_id string, target_canonical_id string, superseded_memory_id string")
    ranked = [("q1", f"m{i}", "old" if i == 0 else f"f{i}", 1.0 - i / 10) for i in range(6)] + [("q1", "t", "ft", 0.1)]
    scored = spark.createDataFrame(ranked, "query_id string, memory_id string, canonical_id string, score double")
    r = ret.target_ranks(scored, queries).first()
    assert (r.exact_rank, r.fact_rank, r.old_first) == (7, 7, True)
    gone = ret.target_ranks(scored.where("memory_id <> 't'"), queries).first()
    assert gone.exact_rank is None and gone.fact_rank is None


def test_exact_ranks_need_no_sort(spark):
    """Numbers fit a hash aggregate; a struct would sort all scored rows, twice."""
    queries = spark.createDataFrame([(1, 5, 5, -1)], "query_id long, target_memory_id long, target_canonical_id long, superseded_memory_id long")
    scores = [(1, i, s) for i, s in enumerate([0.5, 0.7, None, 0.5, 0.9, 0.5])]
    scored = spark.createDataFrame(scores, "query_id long, memory_id long, score double").selectExpr("*", "memory_id canonical_id", "'x' modality")
    ranks = ret.target_ranks(scored, queries, ["modality"])
    assert ranks.first().exact_rank == ranks.first().fact_rank == 6  # a missing score comes first
    narrow = ranks.select("query_id", "exact_rank")
    assert "SortAggregate" not in narrow._jdf.queryExecution().executedPlan().toString()
    unscored = scored.withColumn("score", F.when(F.col("memory_id") < 5, F.col("score")))
    assert [r.exact_rank for r in ret.target_ranks(unscored, queries, ["modality"]).collect()] == [2]


def test_parts_of_a_memory_move_on_as_its_best(spark, monkeypatch):
    rng = np.random.default_rng(3)
    parts = [(int(m), int(p), [float(x) for x in rng.choice([-1.0, 0.0, 1.0], 3)]) for m in range(9) for p in (0, 112, 224)[: 1 + m % 3]]
    asks = [(q, [float(x) for x in rng.choice([0.0, 1.0, 2.0], 3)]) for q in range(4)]
    records = spark.createDataFrame(parts, "memory_id long, start long, vector array<double>").repartition(2)
    queries = spark.createDataFrame(asks, "query_id long, vector array<double>")
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    expected = {}
    for m, p, v in parts:
        for q, w in asks:
            score = round(float(unit(v) @ unit(w)), 9)
            expected[q, m] = max(expected.get((q, m), (-9.0, 0)), (score, -p))
    for most in (4096, 1):
        monkeypatch.setattr(sim, "BROADCAST_QUERIES", most)
        rows = sim.score_all(records, queries, part="start").collect()
        got = {}
        for r in rows:
            got[r.query_id, r.memory_id] = max(got.get((r.query_id, r.memory_id), (-9.0, 0)), (round(r.score, 9) + 0.0, -r.start))
        assert got == expected
        if most > 1:
            assert len(sim.score_all(records.coalesce(1), queries, part="start").collect()) == 9 * 4


def test_chunks_do_not_repeat_their_page(spark):
    pages = spark.createDataFrame([(1, list("abcdefg")), (2, []), (3, None), (4, ["x"])], "page_id long, token_ids array<string>")
    cut = ch.chunks(pages, 4, 1)
    assert sorted((r.page_id, r.start, r.end, "".join(r.chunk_tokens)) for r in cut.collect()) == [(1, 0, 4, "abcd"), (1, 3, 7, "defg"), (4, 0, 1, "x")]
    plan = cut._jdf.queryExecution().executedPlan().toString()
    beside = re.findall(r", \[([^\]]*)\], (?:true|false), \[", plan)
    assert len(beside) == 1 and "page_id" in beside[0] and "token_ids" not in beside[0]
