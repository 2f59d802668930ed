"""Hot groups are cut into bands; the results must equal a plain window's."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerkeep.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.randrange(50), i, rng.randrange(1, 9)) for i in range(3000)]
    return spark.createDataFrame(data, "k string, t int, id int, v long").cache()


def by_key(rows):
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.t, r.id)):
        groups.setdefault(r.k, []).append(r)
    return groups


def order():
    return [F.col("t"), F.col("id")]


@pytest.mark.parametrize("min_rows", [40, 10**6])
def test_rank_sum_previous(rows, min_rows, monkeypatch):
    monkeypatch.setattr(ordered, "BANDS", 1000)
    ranked = ordered.rank_in_group(rows, ["k"], order(), "r", min_rows)
    summed = ordered.running_sum(ranked, ["k"], order(), F.col("v"), "s", min_rows)
    out = ordered.previous_in_group(summed, ["k"], order(), F.col("id"), "p", min_rows)
    got = {r.id: (r.r, r.s, r.p) for r in out.collect()}
    for members in by_key(rows).values():
        total, before = 0, None
        for i, r in enumerate(members, 1):
            total += r.v
            assert got[r.id] == (i, total, before)
            before = r.id


def test_hot_group_is_cut(rows, monkeypatch):
    monkeypatch.setattr(ordered, "BANDS", 1000)
    placed, cut = ordered._place(rows, ["k"], order(), 40)
    assert cut
    sizes = placed.groupBy("k", "_band").count().agg(F.max("count").alias("m")).first().m
    assert sizes < 400
