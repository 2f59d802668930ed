import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerkeep.llm import multi_index as mi


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        i = int(np.flatnonzero(ids == q)[0])
        scores = (x * x[i]).sum(1)
        out[int(q)] = [(int(ids[j]), scores[j]) for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
    return out


def vectors(spark, n=600, copies=200):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[:copies] = x[0]
    return np.arange(n), x.astype(np.float64), spark.createDataFrame([(i, x[i].tolist(), 0.5, i) for i in range(n)], "vec_id long, embedding array<float>, score double, a int").repartition(5)


def test_walk_is_in_order_and_stops():
    rng = np.random.default_rng(0)
    da, db, weight = rng.random(6), rng.random(7), rng.integers(0, 4, (6, 7)).astype(float)
    order = sorted(((da[a] + db[b], a, b) for a in range(6) for b in range(7)))
    every = [(a, b) for _, a, b in order if weight[a, b]]
    assert mi.walk(da, db, weight, float("inf")) == every
    some = mi.walk(da, db, weight, 10)
    assert some == every[: len(some)] and sum(weight[c] for c in some) >= 10 > sum(weight[c] for c in some[:-1])
    assert heapq  # the frontier is a heap


def test_recall_scores_ties_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(mi, "PIECE", 40)
    ids, x, df = vectors(spark)
    found = mi.search(df, df.where("vec_id % 20 = 0"), 10, centroids=8).collect()
    expected = brute(ids, x, ids[::20], 10)
    hits = 0
    for q, best in expected.items():
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - (x[r.vec_id] * x[q]).sum()) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & {v for v, _ in best})
        if q < 200:  # copies of one vector: the smallest ids among them
            assert [r.vec_id for r in own] == [v for v, _ in best]
    assert hits >= 0.9 * 10 * len(expected)


def test_all_cells_give_the_exact_result(spark):
    ids, x, df = vectors(spark, 150, 0)
    found = mi.search(df, df.where("vec_id % 20 = 0"), 20, share=1.0, centroids=4).collect()
    expected = brute(ids, x, ids[::20], 20)
    for q, best in expected.items():
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [v for v, _ in best]


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0]), (20, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = mi.search(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in found] == [(0, 9, 2.0), (0, 1, 0.5), (0, 20, 0.0), (20, 1, 3.0), (20, 0, 0.0), (20, 9, 0.0)]
    assert mi.search(df.where(F.lit(False)), df, 20).collect() == []
    assert mi.search(df.where("vec_id = 3"), df, 20).collect() == []
    assert mi.search(df.where("vec_id = 0"), df, 20).collect() == []


def given(kind, n=2500):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 1 if kind == "one" else 32))
    if kind == "clusters":
        x = rng.normal(size=(25, 32))[rng.integers(25, size=n)] + 0.2 * x
    if kind != "one":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * np.exp(rng.normal(size=(n, 1)) * {"half": 0.5, "whole": 1.0}.get(kind, 0.0))


@pytest.mark.parametrize("kind", ["unit", "half", "whole", "one", "clusters"])
def test_recall_whatever_the_norms(spark, kind):
    x = given(kind)
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], "vec_id long, embedding array<double>").repartition(4)
    asked = ids[::20]
    found = {}
    for r in mi.search(df, df.where("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute(ids, x, asked, 20)
    assert sum(len(found[q] & {v for v, _ in best}) for q, best in expected.items()) >= 0.9 * 20 * len(asked)


def test_each_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(3)
    sizes = [1, 2, 5] * 30
    x = [rng.normal(size=s) for s in sizes]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = mi.search(df, df.where("vec_id % 20 = 0"), 20, share=1.0).collect()
    for q in range(0, 90, 20):
        near = sorted((-float((x[i] * x[q]).sum()), i) for i in range(90) if i != q and sizes[i] == sizes[q])[:20]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in near]
