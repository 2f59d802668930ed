"""Queries on predicted value: feature rules, ridge fits, plans from predictions, prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerkeep.operators import labels as lab
from ledgerkeep.operators import prediction as pr
from ledgerkeep.operators import selection as sel
from ledgerkeep.operators import stats
from ledgerkeep.plans import baskets as bk
from ledgerkeep.plans import query
from ledgerkeep.plans import retention as rt
from ledgerkeep.plans.sqltext import with_sql
from ledgerkeep.session import cut

TARGETS = "tgt AS (SELECT snapshot_id, memory_id, avg(value) AS target FROM utils WHERE seed = 0 GROUP BY 1, 2)"
LABELLED = (*rt.LABEL_CTES, bk.FEATURES, TARGETS, "lbl AS (SELECT f.*, t.target, s.split FROM feats f JOIN tgt t USING (snapshot_id, memory_id) JOIN snaps s USING (snapshot_id))")


def labelled(spark, sf):
    """Features, leave-one-out targets and split of every memory."""
    rows = bk.staged_items(spark, sf)
    targets = lab.loo_labels(rt.utilities(spark, sf, (0,))).withColumnRenamed("loo_value", "target")
    feats = bk.features(spark, sf, rows)
    splits = bk.snapshots(spark, sf, rows).select("snapshot_id", "split")
    return feats.join(targets, ["snapshot_id", "memory_id"]).join(splits, "snapshot_id")


def training(spark, sf):
    return labelled(spark, sf).where("split = 'train'")


@query(
    "i1_feature_rules",
    with_sql(bk.ITEMS, bk.FEATURES, "SELECT snapshot_id, memory_id, concat_ws(',', CASE WHEN memory_id = 5 THEN 'null_age' END, CASE WHEN copies = 1 AND flag = 'N' THEN 'unobserved_similarity' END) AS reasons FROM feats WHERE memory_id = 5 OR (copies = 1 AND flag = 'N')"),
)
def i1(spark, sf):
    feats = bk.features(spark, sf)
    damaged = feats.withColumn("age", F.when(F.col("memory_id") != 5, F.col("age"))).withColumn(
        "historical_similarity",
        F.when(F.col("history_observed") | (F.col("flag") != "N"), F.col("historical_similarity")).otherwise(F.lit(0.5)),
    ).withColumn("memory_tokens", F.col("cost"))
    return pr.feature_violations(damaged)


@query(
    "i2_median_imputation",
    with_sql(bk.ITEMS, bk.FEATURES, "SELECT flag, round(quantile_cont(historical_similarity, 0.5), 9) AS median, count(*) - count(historical_similarity) AS missing FROM feats GROUP BY 1"),
)
def i2(spark, sf):
    feats = bk.features(spark, sf)
    medians = stats.exact_percentiles(feats, ["flag"], "historical_similarity", [0.5])
    holes = feats.groupBy("flag").agg(F.count_if(F.col("historical_similarity").isNull()).alias("missing"))
    return holes.join(medians, "flag", "left").select("flag", F.round("percentile", 9).alias("median"), "missing")


@query(
    "i3_standardization",
    with_sql(*LABELLED, """SELECT 'age' AS feature, round(avg(age), 6) AS mean, round(CASE WHEN stddev_pop(age) = 0 THEN 1 ELSE stddev_pop(age) END, 6) AS scale FROM lbl WHERE split = 'train'
      UNION ALL SELECT 'memory_tokens', round(avg(cost), 6), round(CASE WHEN stddev_pop(cost) = 0 THEN 1 ELSE stddev_pop(cost) END, 6) FROM lbl WHERE split = 'train'"""),
)
def i3(spark, sf):
    rows = training(spark, sf).withColumn("memory_tokens", F.col("cost"))
    s = pr.sufficient_statistics(rows, ("age", "memory_tokens"))
    table = pr.model_table(spark, [pr.solve_ridge(s, ("age", "memory_tokens"), 1.0)])
    return table.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


ONE_FEATURE = """fit AS (SELECT count(*) AS n, avg(cost) AS m, CASE WHEN stddev_pop(cost) = 0 THEN 1 ELSE stddev_pop(cost) END AS s, avg(target) AS b, covar_pop(cost, target) AS c FROM lbl WHERE split = 'train'),
pred AS (SELECT l.*, (l.cost - m) / s * (n * c / s / (n + 1.0)) + b - 0.1 AS predicted FROM lbl l, fit)"""


def one_feature_model(rows):
    rows = rows.where("split = 'train'").withColumn("memory_tokens", F.col("cost"))
    return pr.solve_ridge(pr.sufficient_statistics(rows, ("memory_tokens",)), ("memory_tokens",), 1.0)


@query("i4_ridge_one_feature", with_sql(*LABELLED, ONE_FEATURE, "SELECT 'memory_tokens' AS feature, round(n * c / s / (n + 1.0), 9) AS weight, round(b, 9) AS intercept FROM fit"))
def i4_one(spark, sf):
    table = pr.model_table(spark, [one_feature_model(labelled(spark, sf))])
    return table.select("feature", F.round("weight", 9).alias("weight"), F.round("intercept", 9).alias("intercept"))


#: The six features as SQL, the one that can be missing filled with its median where it is missing at all.
FEATURE_SQL = {
    "recency_rank": "recency_rank", "age": "age", "retrieval_frequency": "retrieval_frequency", "history_observed": "CAST(history_observed AS INT)",
    "historical_similarity": "coalesce(historical_similarity, fill)", "memory_tokens": "cost",
}
_MOMENTS = ", ".join(
    [f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) = 0 THEN 1 ELSE stddev_pop(x{i}) END AS s{i}, covar_pop(x{i}, y) AS t{i}" for i in range(6)]
    + [f"covar_pop(x{i}, x{j}) AS c{i}_{j}" for i in range(6) for j in range(6)]
)
#: The normal equations of each model as an augmented matrix, solved by elimination, one column per step.
RIDGE = (
    """filled AS (SELECT CASE WHEN count(*) > count(historical_similarity) THEN coalesce(quantile_cont(historical_similarity, 0.5), 0.0) ELSE 0.0 END AS fill FROM lbl WHERE split = 'train')""",
    "xs AS (SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(FEATURE_SQL.values())) + ", target AS y FROM lbl, filled WHERE split = 'train')",
    f"moments AS MATERIALIZED (SELECT count(*) AS n, avg(y) AS my, {_MOMENTS} FROM xs)",
    "plain AS MATERIALIZED (SELECT n, my, [" + ", ".join(f"m{i}" for i in range(6)) + "] AS means, [" + ", ".join(f"s{i}" for i in range(6)) + "] AS scales, ["
    + ", ".join(f"n * t{i} / s{i}" for i in range(6)) + "] AS b, [" + ", ".join("[" + ", ".join(f"n * c{i}_{j} / s{i} / s{j}" for j in range(6)) + "]" for i in range(6)) + "] AS gram FROM moments)",
)


def ridge_sql(alphas: tuple[float, ...], groups: dict[str, tuple[str, ...]], more: str = "") -> str:
    at = {f: i + 1 for i, f in enumerate(FEATURE_SQL)}
    models = ", ".join(f"('{g}-a{a:g}', CAST({a} AS DOUBLE), [{', '.join(str(at[f]) for f in names)}])" for g, names in groups.items() for a in alphas)
    names = ", ".join(f"'{f}'" for f in FEATURE_SQL)
    return with_sql(
        *LABELLED, *RIDGE, f"models(model, alpha, own) AS (VALUES {models})",
        """steps AS (SELECT model, own, CAST(0 AS BIGINT) AS k,
             list_transform(own, lambda i: list_append(list_transform(own, lambda j: gram[i][j] + CASE WHEN i = j THEN alpha ELSE 0 END), b[i])) AS a FROM models, plain
           UNION ALL
           SELECT model, own, k + 1, list_transform(a, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / r[k + 1])
             ELSE list_transform(r, lambda v, j: v - r[k + 1] * a[k + 1][j] / a[k + 1][k + 1]) END) FROM steps WHERE k < len(own))""",
        "solved AS (SELECT model, own[i] AS f, a[i][len(own) + 1] AS w FROM (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM steps WHERE k = len(own)))",
        f"""SELECT model, ([{names}])[f] AS feature, round(CASE WHEN f = 5 THEN fill ELSE 0.0 END, 6) AS median, round(means[f], 6) AS mean, round(scales[f], 6) AS scale,
             round(w, 6) + 0.0 AS weight, round(my, 6) + 0.0 AS intercept FROM solved, plain, filled {more}""",
    )


def _rounded_models(table):
    return table.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("median", "mean", "scale", "weight", "intercept")})


@query("i4_ridge_fit", ridge_sql((1.0,), {"full": pr.FEATURES}))
def i4(spark, sf):
    """All six features."""
    s = pr.sufficient_statistics(training(spark, sf).withColumn("memory_tokens", F.col("cost")))
    return _rounded_models(pr.model_table(spark, [pr.solve_ridge(s, pr.FEATURES, 1.0, "full-a1")]))


@query("i5_predictions", with_sql(*LABELLED, ONE_FEATURE, "SELECT snapshot_id, memory_id, round(predicted, 6) AS predicted FROM pred"))
def i5(spark, sf):
    return predicted(spark, sf).select("snapshot_id", "memory_id", F.round("predicted", 6).alias("predicted"))


def predicted(spark, sf):
    """Predictions shifted down by a constant storage price, so that some are negative."""
    rows = cut(labelled(spark, sf))
    model = one_feature_model(rows)
    return rows.withColumn("memory_tokens", F.col("cost")).withColumn("predicted", pr.prediction(model) - 0.1)


@query("i6_ablation_models", ridge_sql((0.1, 1.0, 10.0), pr.GROUPS, "UNION ALL SELECT 'zero', '', 0.0, 0.0, 1.0, 0.0, 0.0"))
def i6(spark, sf):
    s = pr.sufficient_statistics(training(spark, sf).withColumn("memory_tokens", F.col("cost")))
    return _rounded_models(pr.model_table(spark, pr.ablation_models(s, (0.1, 1.0, 10.0))))


@query(
    "g6_utility_plans",
    with_sql(*LABELLED, ONE_FEATURE, "uscored AS (SELECT snapshot_id, memory_id, cost, 'utility_aware' AS candidate, CAST(NULL AS BIGINT) AS selection_seed, TRUE AS positive_only, predicted AS score FROM pred)",
      bk.RATIO_SQL, bk.pick_sql("uscored", "upick"), f"SELECT snapshot_id, candidate, budget_ratio, budget_tokens, store_tokens, {rt.IDS} AS storage_ids FROM upick"),
)
def g6(spark, sf):
    rows = predicted(spark, sf)
    plans = sel.plan_table(rows, [sel.Candidate("utility_aware", F.col("predicted"), positive_only=True)], bk.RATIOS)
    return plans.select("snapshot_id", "candidate", "budget_ratio", "budget_tokens", "store_tokens", bk.ids_text("storage_ids").alias("storage_ids"))


@query(
    "h12_prediction_errors",
    with_sql(*LABELLED, ONE_FEATURE, "SELECT round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse, count(*) AS snapshots FROM (SELECT snapshot_id, avg(abs(target - predicted)) AS mae, avg((target - predicted)*(target - predicted)) AS mse FROM pred WHERE split = 'validation' GROUP BY 1)"),
)
def h12(spark, sf):
    errors = stats.prediction_errors(predicted(spark, sf).where("split = 'validation'"))
    return errors.withColumns({c: F.round(c, 6) for c in ("mae", "mse")})


SPEARMAN = """rk AS (SELECT snapshot_id, rank() OVER (PARTITION BY snapshot_id ORDER BY target) + (count(*) OVER (PARTITION BY snapshot_id, target) - 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY snapshot_id ORDER BY predicted) + (count(*) OVER (PARTITION BY snapshot_id, predicted) - 1) / 2.0 AS rp FROM pred WHERE split = 'validation'),
sp AS (SELECT snapshot_id, CASE WHEN min(rt) < max(rt) AND min(rp) < max(rp) THEN covar_pop(rt, rp) / (stddev_pop(rt) * stddev_pop(rp)) END AS spearman FROM rk GROUP BY 1)"""


@query("h13_spearman", with_sql(*LABELLED, ONE_FEATURE, SPEARMAN, "SELECT snapshot_id, round(spearman, 6) AS spearman FROM sp"))
def h13(spark, sf):
    rows = cut(predicted(spark, sf).where("split = 'validation'").select("snapshot_id", "memory_id", "target", "predicted"))
    return stats.spearman(rows).withColumn("spearman", F.round("spearman", 6))


@query("h13_spearman_summary", with_sql(*LABELLED, ONE_FEATURE, SPEARMAN, "SELECT round(avg(spearman), 6) AS spearman, count(spearman) AS defined, count(*) - count(spearman) AS undefined FROM sp"))
def h13_summary(spark, sf):
    rows = cut(predicted(spark, sf).where("split = 'validation'").select("snapshot_id", "memory_id", "target", "predicted"))
    return stats.spearman_summary(stats.spearman(rows)).withColumn("spearman", F.round("spearman", 6))


@query(
    "h14_negative_detection",
    with_sql(*LABELLED, ONE_FEATURE, """c AS (SELECT count(*) FILTER (WHERE target < 0 AND predicted < 0) AS true_positive, count(*) FILTER (WHERE target < 0) AS actual, count(*) FILTER (WHERE predicted < 0) AS predicted_negative FROM pred WHERE split = 'validation')""",
      "SELECT *, round(true_positive / nullif(predicted_negative, 0), 9) AS negative_precision, round(true_positive / nullif(actual, 0), 9) AS negative_recall FROM c"),
)
def h14(spark, sf):
    found = stats.negative_detection(predicted(spark, sf).where("split = 'validation'"))
    return found.withColumns({c: F.round(c, 9) for c in ("negative_precision", "negative_recall")})
