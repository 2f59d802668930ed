import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerkeep.functions import text as tx
from ledgerkeep.operators import chunks as ch
from ledgerkeep.operators import metrics as met
from ledgerkeep.operators import prediction as pr
from ledgerkeep.operators import stats


def test_answer_scores(spark):
    rows = [("The Neovim.", "Neovim", 1, 1.0), ("Not Neovim", "Neovim", 0, 2 / 3), ("Neovim or Emacs", "Neovim", 0, 0.5), ("UNKNOWN", "Perth", 0, 0.0), ("b b c", "b b b", 0, 2 / 3)]
    df = spark.createDataFrame(rows, "a string, g string, em int, f double")
    out = df.select("em", tx.exact_match(F.col("a"), F.col("g")).alias("x"), "f", tx.token_f1(F.col("a"), F.col("g")).alias("y"))
    assert all(r.em == r.x and abs(r.f - r.y) < 1e-12 for r in out.collect())


def test_ratings_and_lines(spark):
    df = spark.createDataFrame([("5",), ("2.0!",), ("important",)], "t string")
    got = [tuple(r.r) for r in df.select(tx.parse_rating(F.col("t")).alias("r")).collect()]
    assert got == [(5, True), (2, True), (3, False)]
    line = spark.createDataFrame([("\n\nOslo\nAnswer: Perth",)], "t string").select(tx.first_line(F.col("t")).alias("l")).first().l
    assert line == "Oslo"


@pytest.mark.parametrize("length", [1, 512, 513, 960, 2457])
def test_chunks_cover_the_text(spark, length):
    page = spark.range(1).select(F.lit("p").alias("page_id"), F.sequence(F.lit(1), F.lit(length)).alias("token_ids"))
    rows = ch.chunks(page, 512, 64)
    spans = [(r.start, r.end) for r in rows.orderBy("start").collect()]
    assert spans[0][0] == 0 and spans[-1][1] == length and all(e - s <= 512 for s, e in spans)
    assert all(b[0] == a[1] - 64 for a, b in zip(spans, spans[1:]))
    assert ch.coverage_violations(rows, page.select("page_id", F.lit(length).alias("length"))).count() == 0


def test_chunk_sizes_are_checked(spark):
    for size, overlap in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            ch.chunk_ranges(F.lit(1), size, overlap)


def test_page_scores(spark):
    rows = [("q0", "p0", 0, 0.2), ("q0", "p1", 0, 0.9), ("q0", "p0", 1, 0.8), ("q1", "p0", 0, 0.7), ("q1", "p1", 0, 0.1), ("q1", "p0", 1, 0.3)]
    df = spark.createDataFrame(rows, "query_id string, page_id string, start long, score double")
    assert {(r.query_id, r.page_id): r.score for r in ch.page_scores(df).collect()} == {("q0", "p0"): 0.8, ("q0", "p1"): 0.9, ("q1", "p0"): 0.7, ("q1", "p1"): 0.1}


def test_failure_classes(spark):
    rows = [
        ("x", 9, ["a", "b"], ["a", "b"], 1, "correct"), ("x", 3, [], [], 0, "budget_infeasible"), ("x", 9, ["a"], ["a"], 0, "support_not_retained"),
        ("x", 9, ["a", "b"], ["a"], 0, "support_not_retrieved"), ("x", 9, ["a", "b"], ["a", "b"], 0, "supported_but_wrong"), ("full", 3, ["a", "b"], [], 0, "support_not_retrieved"),
    ]
    df = spark.createDataFrame(rows, "candidate string, budget_tokens long, storage_ids array<string>, context_ids array<string>, exact_match int, expected string")
    df = df.withColumn("supports", F.array(F.array(F.lit("a"), F.lit("b")))).withColumn("costs", F.create_map(F.lit("a"), F.lit(4).cast("long"), F.lit("b"), F.lit(4).cast("long"))).withColumn("store_tokens", F.lit(1).cast("long"))
    assert all(r.category == r.expected for r in met.failure_table(df).collect())


def test_win_tie_loss(spark):
    rows = [(0.5, t, "s", c, v) for t, a, b in (("t1", 1.0, 0.0), ("t2", 0.5, 0.5), ("t3", 0.0, 1.0)) for c, v in (("ours", a), ("base", b))]
    schema = "budget_ratio double, trajectory_id string, scenario string, candidate string, exact_match double"
    got = {r.scenario: (r.win, r.tie, r.loss) for r in met.win_tie_loss(spark.createDataFrame(rows, schema), "ours", "base").collect()}
    assert got == {"s": (1, 1, 1), "all": (1, 1, 1)}
    with pytest.raises(Exception, match="missing paired policy"):
        met.win_tie_loss(spark.createDataFrame(rows[:-1], schema), "ours", "base").collect()


def test_constant_side_is_undefined(spark):
    df = spark.createDataFrame([("s", "a", 1.0, 0.1), ("s", "b", 1.0, 0.2)], "snapshot_id string, memory_id string, target double, predicted double")
    assert stats.spearman(df).first().spearman is None
    assert stats.negative_detection(df).first().negative_recall is None


@pytest.mark.parametrize("hot", [3, 10**6])
def test_spearman_and_percentiles(spark, hot):
    rng = np.random.default_rng(0)
    t, p = rng.integers(0, 6, 80).astype(float), rng.integers(0, 9, 80).astype(float)
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, p))], "snapshot_id string, memory_id long, target double, predicted double")
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    expected = np.corrcoef(rank(t), rank(p))[0, 1]
    assert abs(stats.spearman(df, hot).first().spearman - expected) < 1e-12
    got = {r.fraction: r.percentile for r in stats.exact_percentiles(df, ["snapshot_id"], "predicted", [0.05, 0.5, 0.95], hot).collect()}
    assert all(abs(got[f] - np.quantile(p, f)) < 1e-12 for f in got)


def test_bootstrap(spark):
    df = spark.createDataFrame([("t1", -0.5), ("t2", 0.5)], "trajectory_id string, difference double").withColumn("k", F.lit("x"))
    r = stats.paired_bootstrap(df, ["k"], 400, 7).first()
    assert (r.mean_difference, r.ci_low, r.ci_high, r.verdict) == (0.0, -0.5, 0.5, "inconclusive")
    rng = np.random.default_rng(1)
    rows = [(k, f"t{i:04d}", float(v)) for k, n in (("x", 50), ("y", 333)) for i, v in enumerate(rng.normal(size=n))]
    many = spark.createDataFrame(rows, "k string, trajectory_id string, difference double")
    one, cut_up = (sorted(map(tuple, stats.paired_bootstrap(many, ["k"], 100, 3, bucket=size, min_rows=rows).collect())) for size, rows in ((10_000, 10_000), (7, 20)))
    assert all(a[:2] == b[:2] and max(abs(x - y) for x, y in zip(a[2:5], b[2:5])) < 1e-12 for a, b in zip(one, cut_up)) and len(one) == 2


def brute_counts(n, seed, repeat):
    """How often each of n places is drawn, by the scheme's words alone."""
    from math import comb

    def word(*parts):
        return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()

    times, nodes = [0] * n, [(0, n, n)]
    while nodes:
        lo, hi, m = nodes.pop()
        if hi - lo <= 32:
            for j in range(m):
                times[lo + int(word(seed, repeat, lo, hi, j // 4)[8 * (j % 4) : 8 * (j % 4) + 8], 16) % (hi - lo)] += 1
            continue
        mid = (lo + hi) // 2
        p, u, k, upto = Fraction(mid - lo, hi - lo), Fraction(2 * int(word(seed, repeat, lo, hi)[:8], 16) + 1, 1 << 33), 0, Fraction(0)
        while k < m:
            upto += comb(m, k) * p**k * (1 - p) ** (m - k)
            if upto >= u:
                break
            k += 1
        nodes += [(lo, mid, k), (mid, hi, m - k)]
    return times


def test_bootstrap_draws_follow_the_tree_whatever_the_buckets():
    n, repeats = 150, 6
    exact = np.array([brute_counts(n, 5, r) for r in range(repeats)])
    assert (exact.sum(axis=1) == n).all()
    one_by_one = np.array([stats._resampled(np.ones(1), i, n, repeats, 5) for i in range(n)]).T
    assert (one_by_one == exact).all()
    values = np.random.default_rng(2).normal(size=n)
    parts = sum(stats._resampled(values[i : i + 13], i, n, repeats, 5) for i in range(0, n, 13))
    assert np.allclose(parts, exact @ values, atol=1e-12)


def test_bootstrap_counts_are_multinomial():
    n, repeats = 2000, 300
    counts = np.array([stats._resampled(np.ones(1), i, n, repeats, 9) for i in (0, 700, 1999)])
    assert abs(counts.mean() - 1) < 0.1 and abs(counts.var() - 1) < 0.2
    halves = stats._resampled(np.ones(n // 2), 0, n, repeats, 9)
    assert abs(halves.mean() - n / 2) < 5 and 0.7 < halves.var() / (n / 4) < 1.4
    low, upto = stats._cumulative(10**9, 1, 3)  # wide nodes take a window, not all their draws
    assert len(upto) < 10**6 and abs(upto[-1] - 1) < 1e-12 and abs(low + int(np.searchsorted(upto, 0.5)) - 10**9 / 3) < 3


def test_unpaired_trajectories_are_rejected(spark):
    df = spark.createDataFrame([("t1", "a", 1.0), ("t1", "b", 0.0), ("t2", "a", 1.0)], "trajectory_id string, candidate string, exact_match double")
    with pytest.raises(Exception, match="unpaired"):
        stats.paired_differences(df, [("a", "b")], []).collect()


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 3))
    x[::7, 2] = np.nan
    y = x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=70)
    rows = [(float(a), float(b), None if np.isnan(c) else float(c), float(t)) for (a, b, c), t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, target double")
    model = pr.solve_ridge(pr.sufficient_statistics(df, ("a", "b", "c"), min_rows=5), ("a", "b", "c"), 2.0)
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = (filled - filled.mean(0)) / filled.std(0)
    w = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(model.weights, w) and abs(model.intercept - y.mean()) < 1e-12
    got = [r.p for r in df.select(pr.prediction(model).alias("p")).collect()]
    assert np.allclose(got, z @ w + y.mean())


def test_uncertain_labels_are_refused(spark):
    df = spark.createDataFrame([(1.0, 1.0, True)], "a double, target double, uncertain boolean")
    with pytest.raises(ValueError, match="uncertain"):
        pr.sufficient_statistics(df, ("a",))
