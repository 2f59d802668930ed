import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerkeep.llm import mixing

WEIGHTS = {"a": 0.5, "b": 0.3, "c": 0.2}


def corpus(spark, n=300):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        domain = "aaaaaabbbc"[i % 10]
        words = [f"{domain if rng.random() < 0.7 else 'x'}{rng.integers(40)}" for _ in range(rng.integers(1, 60))]
        rows.append((i, " ".join(words), domain if i % 2 else None, "r", 1))
    rows += [(1000, None, None, "r", 1), (1001, "", "a", "r", 1), (None, "a1 a2 a3", "nowhere", "r", 1), (5, rows[5][1], "a", "r", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string, rate string, tokens int")


def fitted(rows, least):
    """The same problem solved by plain projected gradient steps."""
    t = np.array([r.tokens for r in rows], dtype=float)
    p = np.array([[r.p_a, r.p_b, r.p_c] for r in rows])
    mass = (t[:, None] * p).sum(0)
    share = np.array([0.5, 0.3, 0.2])
    total = max(least * mass / share) * (1 + mixing.HEADROOM) if least else mass.sum()
    rate, gram = np.full(len(t), max(1.0, least)), (t[:, None, None] * p[:, :, None] * p[:, None, :]).sum(0)
    for _ in range(4000):
        gap = (rate[:, None] * t[:, None] * p).sum(0) - share * total
        rate = np.maximum(least, rate - p @ gap / np.linalg.eigvalsh(gram).max())
    return rate, share * total


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_totals_meet_targets_and_rates_equal_plain_descent(spark, least):
    docs = corpus(spark)
    rows = mixing.mix(docs, docs.where("domain is not null"), WEIGHTS, least=least).collect()
    assert len(rows) == docs.count()
    rate, target = fitted(rows, least)
    got = np.array([r.rate for r in rows])
    totals = sum(r.rate * r.tokens * np.array([r.p_a, r.p_b, r.p_c]) for r in rows)
    assert np.allclose(totals, target, rtol=1e-4)
    assert got.min() >= least
    assert np.allclose(got, rate, atol=2e-3)
    assert all(abs(r.p_a + r.p_b + r.p_c - 1) < 1e-9 for r in rows)
    assert all(int(np.floor(r.rate)) <= r.copies <= int(np.ceil(r.rate)) for r in rows)


def test_posteriors_follow_the_labelled_table(spark):
    docs = corpus(spark)
    rows = {r.doc_id: r for r in mixing.mix(docs, docs.where("domain is not null"), WEIGHTS).collect()}
    long = [r for i, r in rows.items() if i is not None and i < 300 and r.tokens > 20]
    right = [max("abc", key=lambda d: r[f"p_{d}"]) == "aaaaaabbbc"[r.doc_id % 10] for r in long]
    assert sum(right) > 0.95 * len(right)
    assert rows[1000].tokens == rows[1001].tokens == 0 and rows[1000].p_a == rows[1001].p_a


def test_copies_are_repeated(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 3)], "doc_id long, copies long")
    assert sorted(r.doc_id for r in mixing.repeat(df, ["doc_id"]).collect()) == [2, 3, 3, 3]


def test_empty_tables(spark):
    docs = corpus(spark, 20)
    none = docs.where(F.lit(False))
    assert mixing.mix(none, none, WEIGHTS).collect() == []
    unlabelled = mixing.mix(docs, none, WEIGHTS).collect()  # nothing learned: equal posteriors, nothing to choose between
    assert len(unlabelled) == 24 and all(abs(r.p_a - 1 / 3) < 1e-9 for r in unlabelled)
