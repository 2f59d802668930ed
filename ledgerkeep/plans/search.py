"""Queries on vectors and texts: search, ranking metrics, deduplication, history features, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerkeep.functions import text as tx
from ledgerkeep.functions.hashing import bag_of_words, dense_vector, dense_vectors, draw32, seeded_unit, token_bucket
from ledgerkeep.operators import chunks as ch
from ledgerkeep.operators import memory as mem
from ledgerkeep.operators import metrics as met
from ledgerkeep.operators import retrieval as ret
from ledgerkeep.operators import selection as sel
from ledgerkeep.operators import similarity as sim
from ledgerkeep.operators.checks import metric_violations
from ledgerkeep.operators.live import search_active_log
from ledgerkeep.operators.ordered import rank_in_group
from ledgerkeep.plans import knowledge as kn
from ledgerkeep.plans import orderlog as ol
from ledgerkeep.plans import query
from ledgerkeep.plans.sqltext import with_sql
from ledgerkeep.session import cut
from ledgerkeep.sources.tables import spread, table

NEAR = 0.3  # the driver vectors are far apart; thresholds of 0.8 to 0.98 would find nothing


# --- vectors: each label's centroid asks for its members ---------------------------------------------------


def vectors(spark, sf):
    return table(spark, sf, "embeddings", "vec_id", "embedding", "label").select(
        F.col("vec_id").alias("memory_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("long").alias("canonical_id"),
        F.col("vec_id").alias("event_order"),
        F.lit("all").alias("scope"),
    )


def centroids(rows):
    means = (
        rows.select(F.col("canonical_id").alias("query_id"), F.posexplode("vector").alias("pos", "x"))
        .groupBy("query_id", "pos")
        .agg(F.avg("x").alias("m"))
    )
    return means.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e.m).alias("vector")
    )


def asked(rows):
    """Targets of each label's question: its fact, its newest record, and the next label as the outdated fact."""
    labels = rows.groupBy("canonical_id").agg(F.max("memory_id").alias("target_memory_id"))
    return labels.select(
        F.col("canonical_id").alias("query_id"),
        "target_memory_id",
        F.col("canonical_id").alias("target_canonical_id"),
        ((F.col("canonical_id") + 1) % 10).alias("superseded_memory_id"),
    )


VEC = """
emb AS (SELECT vec_id AS memory_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CAST(label AS BIGINT) AS canonical_id FROM embeddings),
cent AS (SELECT canonical_id AS query_id, list(m ORDER BY i) AS q FROM (SELECT canonical_id, r.i, avg(v[r.i]) AS m FROM emb, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
sc AS (SELECT query_id, memory_id, canonical_id, round(list_cosine_similarity(v, q), 12) AS score FROM emb, cent),
asked AS (SELECT canonical_id AS query_id, max(memory_id) AS target_memory_id, canonical_id AS target_canonical_id, (canonical_id + 1) % 10 AS superseded_memory_id FROM emb GROUP BY canonical_id)
"""


def scored(spark, sf):
    rows = vectors(spark, sf)
    scores = sim.score_all(rows, centroids(rows))
    return rows, scores.join(rows.select("memory_id", "canonical_id"), "memory_id")


@query(
    "e1_vector_top_k",
    with_sql(VEC, "rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM sc)",
             "SELECT query_id, memory_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 5"),
)
def e1(spark, sf):
    rows = vectors(spark, sf)
    return sim.top_k(rows, centroids(rows), 5).withColumn("score", F.round("score", 6))


@query(
    "e3_full_ranking",
    with_sql(VEC, "SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM sc"),
)
def e3(spark, sf):
    _, scores = scored(spark, sf)
    return sim.full_ranking(scores, ["query_id"]).select("query_id", "memory_id", "rank")


PAIRS = """prs AS (SELECT a.memory_id AS a, b.memory_id AS b, a.canonical_id AS ca, b.canonical_id AS cb, round(list_cosine_similarity(a.v, b.v), 12) AS s
  FROM emb a JOIN emb b ON a.memory_id < b.memory_id)"""


@query(
    "e4_similar_pairs",
    with_sql(VEC, PAIRS, "SELECT ca AS canonical_id, a AS memory_a, b AS memory_b, round(s, 6) AS similarity FROM prs WHERE ca = cb AND s >= 0.2"),
)
def e4(spark, sf):
    return sim.similar_pairs(vectors(spark, sf), ["canonical_id"], 0.2).withColumn("similarity", F.round("similarity", 6))


@query(
    "e12_vector_validity",
    "SELECT vec_id AS memory_id, 'norm' AS reason FROM embeddings WHERE label = 4 AND abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x * 4))) - 1) > 0.001",
)
def e12(spark, sf):
    rows = vectors(spark, sf)
    scaled = F.when(F.col("canonical_id") == 4, F.transform("vector", lambda x: x * 2)).otherwise(F.col("vector"))
    return sim.vector_violations(rows.withColumn("vector", scaled), 64)


GREEDY = f"""
ord AS (SELECT memory_id, v, CAST(row_number() OVER (ORDER BY memory_id DESC) AS BIGINT) AS p FROM emb),
nbrs AS (SELECT o.p, any_value(o.memory_id) AS memory_id, coalesce(list(n.p ORDER BY n.p) FILTER (WHERE n.p IS NOT NULL), CAST([] AS BIGINT[])) AS nb
  FROM ord o LEFT JOIN (SELECT a, b FROM prs WHERE s >= {NEAR}) e ON e.a = o.memory_id LEFT JOIN ord n ON n.memory_id = e.b GROUP BY o.p),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT k + 1, CASE WHEN list_has_any(kept, nb) THEN kept ELSE list_append(kept, k + 1) END FROM walk JOIN nbrs ON p = k + 1),
final AS (SELECT kept FROM walk ORDER BY k DESC LIMIT 1),
fates AS (SELECT n.memory_id, o.memory_id AS representative_id FROM nbrs n, final f JOIN ord o ON o.p = CASE WHEN list_contains(f.kept, n.p) THEN n.p ELSE list_min(list_intersect(f.kept, n.nb)) END)
"""


def fates(spark, sf):
    return sim.greedy_representatives(vectors(spark, sf), ["scope"], NEAR)


@query("g11_semantic_representatives", with_sql(VEC, PAIRS, GREEDY, "SELECT memory_id, representative_id FROM fates"))
def g11(spark, sf):
    return fates(spark, sf).select("memory_id", "representative_id")


@query(
    "g11_semantic_order",
    with_sql(VEC, PAIRS, GREEDY, "SELECT memory_id, row_number() OVER (ORDER BY CAST(memory_id <> representative_id AS INT), memory_id DESC) AS position FROM fates"),
)
def g11_order(spark, sf):
    return sim.semantic_order(vectors(spark, sf), fates(spark, sf), ["scope"]).select("memory_id", "position")


@query(
    "g12_dedup_select",
    with_sql(VEC, PAIRS, GREEDY, """reps AS (SELECT memory_id, memory_id % 7 + 1 AS cost FROM fates WHERE memory_id = representative_id),
      entries AS (SELECT list({'id': memory_id, 'cost': cost} ORDER BY memory_id DESC) AS e FROM reps),
      fill AS (SELECT e, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS spent, CAST([] AS BIGINT[]) AS taken FROM entries UNION ALL
        SELECT e, k+1, CASE WHEN spent + e[k+1].cost <= 400 THEN spent + e[k+1].cost ELSE spent END, CASE WHEN spent + e[k+1].cost <= 400 THEN list_append(taken, e[k+1].id) ELSE taken END FROM fill WHERE k < len(e))""",
      "SELECT r.memory_id, r.cost FROM reps r, (SELECT taken FROM fill ORDER BY k DESC LIMIT 1) f WHERE list_contains(f.taken, r.memory_id)"),
)
def g12(spark, sf):
    rows = vectors(spark, sf).withColumn("cost", F.col("memory_id") % 7 + 1).withColumn("budget", F.lit(400))
    kept = sim.dedup_select(rows.drop("vector"), fates(spark, sf), ["scope"], "budget", "cost")
    return kept.select("memory_id", "cost")


# --- count budgets and ranking metrics ---------------------------------------------------------------------

BUDGETS = (0.25, 0.5, 0.75)
BUDGET_POLICIES = """
rated AS (SELECT memory_id, canonical_id, CAST(('0x'||substr(md5('11:'||memory_id),1,8)) AS BIGINT) / 4294967296.0 AS importance FROM emb),
posn AS (SELECT 'recency' AS policy, memory_id, row_number() OVER (ORDER BY memory_id DESC) AS pos FROM emb
  UNION ALL SELECT 'importance', memory_id, row_number() OVER (ORDER BY importance DESC, memory_id) FROM rated
  UNION ALL SELECT 'semantic_dedup', memory_id, row_number() OVER (ORDER BY CAST(memory_id <> representative_id AS INT), memory_id DESC) FROM fates),
kept AS (SELECT policy, b.budget_ratio, memory_id FROM posn, (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75)) b(budget_ratio) WHERE pos <= floor((SELECT count(*) FROM emb) * budget_ratio)
  UNION ALL SELECT 'full', 1.0, memory_id FROM emb),
rnk AS (SELECT policy, budget_ratio, query_id, sc.memory_id, canonical_id, row_number() OVER (PARTITION BY policy, budget_ratio, query_id ORDER BY score DESC, sc.memory_id) AS rank FROM sc JOIN kept USING (memory_id)),
tr AS (SELECT policy, budget_ratio, query_id, min(rank) FILTER (WHERE memory_id = target_memory_id) AS exact_rank, min(rank) FILTER (WHERE canonical_id = target_canonical_id) AS fact_rank,
  bool_or(rank = 1 AND canonical_id = superseded_memory_id) AS old_first FROM rnk JOIN asked USING (query_id) GROUP BY 1, 2, 3),
rm AS (SELECT policy, budget_ratio, count(*) AS queries, avg(CAST(coalesce(exact_rank <= 1, FALSE) AS INT)) AS exact_recall_at_1, avg(CAST(coalesce(exact_rank <= 5, FALSE) AS INT)) AS exact_recall_at_5,
  avg(CAST(coalesce(fact_rank <= 1, FALSE) AS INT)) AS recall_at_1, avg(CAST(coalesce(fact_rank <= 5, FALSE) AS INT)) AS recall_at_5, avg(coalesce(1.0 / fact_rank, 0)) AS mrr, avg(coalesce(1.0 / exact_rank, 0)) AS exact_mrr,
  avg(CAST(fact_rank IS NOT NULL AS INT)) AS target_fact_retained, avg(CAST(old_first AS INT)) AS superseded_fact_at_1 FROM tr GROUP BY 1, 2)
"""


def kept_sets(spark, sf, rows):
    """Every policy and budget as (policy, budget_ratio, memory_id)."""
    importance = seeded_unit(F.lit(11), F.col("memory_id"))
    recency = sel.top_by_count(rows, ["scope"], [-F.col("event_order"), F.col("memory_id")], BUDGETS)
    rated = sel.top_by_count(rows, ["scope"], [-importance, F.col("memory_id")], BUDGETS)
    order = sim.semantic_order(rows, fates(spark, sf), ["scope"])
    dedup = sel.top_by_count(order, ["scope"], [F.col("position")], BUDGETS)

    def tag(df, policy):
        return df.select(F.lit(policy).alias("policy"), "budget_ratio", "memory_id")

    full = rows.select(F.lit("full").alias("policy"), F.lit(1.0).alias("budget_ratio"), "memory_id")
    return tag(recency, "recency").unionByName(tag(rated, "importance")).unionByName(tag(dedup, "semantic_dedup")).unionByName(full)


def plan_ranks(spark, sf):
    rows, scores = scored(spark, sf)
    scores = cut(scores)  # scored once, read by every kept set
    kept = cut(kept_sets(spark, sf, rows))
    grid = [(p, r) for p in ("recency", "importance", "semantic_dedup") for r in BUDGETS] + [("full", 1.0)]
    groups = spark.createDataFrame(grid, "policy string, budget_ratio double")
    return rows, kept, ret.target_ranks(scores.join(kept, "memory_id"), asked(rows), ["policy", "budget_ratio"], groups)


RANKING_MEASURES = [
    "exact_recall_at_1", "exact_recall_at_5", "recall_at_1", "recall_at_5", "mrr", "exact_mrr", "target_fact_retained", "superseded_fact_at_1",
]


@query(
    "h1_ranking_metrics",
    with_sql(VEC, PAIRS, GREEDY, BUDGET_POLICIES, "SELECT policy, budget_ratio, queries, " + ", ".join(f"round({m}, 6) AS {m}" for m in RANKING_MEASURES) + " FROM rm"),
)
def h1(spark, sf):
    _, _, ranks = plan_ranks(spark, sf)
    table_ = met.ranking_metrics(ranks, ["policy", "budget_ratio"])
    return table_.withColumns({m: F.round(m, 6) for m in RANKING_MEASURES})


@query(
    "h40_retrieval_outcomes",
    with_sql(VEC, PAIRS, GREEDY, BUDGET_POLICIES, """SELECT policy, budget_ratio, CASE WHEN fact_rank IS NULL THEN 'target_pruned' WHEN old_first THEN 'obsolete_rank1' WHEN fact_rank = 1 THEN 'correct_rank1'
      WHEN fact_rank > 5 THEN 'retained_but_not_top5' ELSE 'correct_below_rank1' END AS outcome, count(*) AS queries FROM tr GROUP BY 1, 2, 3"""),
)
def h40(spark, sf):
    _, _, ranks = plan_ranks(spark, sf)
    return ranks.groupBy("policy", "budget_ratio", met.retrieval_outcome().alias("outcome")).agg(F.count("*").alias("queries"))


@query(
    "h37_recall_loss",
    with_sql(VEC, PAIRS, GREEDY, BUDGET_POLICIES, "SELECT r.policy, r.budget_ratio, round((f.mrr - r.mrr) * 100 * 0.1 / (1 - r.budget_ratio), 6) + 0.0 AS loss_per_tenth FROM rm r, rm f WHERE f.policy = 'full' AND r.policy <> 'full'"),
)
def h37(spark, sf):
    _, _, ranks = plan_ranks(spark, sf)
    summary = met.ranking_metrics(ranks, ["policy", "budget_ratio"]).withColumn("scenario", F.lit("all"))
    loss = met.recall_loss(summary, ["scenario"], "mrr")
    return loss.select("policy", "budget_ratio", (F.round("loss_per_tenth", 6) + F.lit(0.0)).alias("loss_per_tenth"))


@query(
    "b14_metric_invariants",
    with_sql(VEC, PAIRS, GREEDY, BUDGET_POLICIES, """n AS (SELECT policy, budget_ratio, count(*) AS k FROM kept GROUP BY 1, 2)""",
      "SELECT policy, budget_ratio, 'kept_count' AS reasons FROM n WHERE k <> floor((SELECT count(*) FROM emb) * CASE WHEN policy = 'recency' THEN budget_ratio / 2 ELSE budget_ratio END)"),
)
def b14(spark, sf):
    """The recency rows claim half their real budget, which the audit must notice."""
    rows, kept, ranks = plan_ranks(spark, sf)
    counts = kept.groupBy("policy", "budget_ratio").agg(F.count("*").alias("kept_rows"))
    total = rows.agg(F.count("*").alias("n")).first().n
    summary = met.ranking_metrics(ranks, ["policy", "budget_ratio"]).join(counts, ["policy", "budget_ratio"])
    claimed = F.when(F.col("policy") == "recency", F.col("budget_ratio") / 2).otherwise(F.col("budget_ratio"))
    claims = summary.withColumn("real_ratio", F.col("budget_ratio")).withColumn("budget_ratio", claimed).withColumn("group_rows", F.lit(total))
    bad = metric_violations(claims, ["policy", "real_ratio"])
    return bad.withColumnRenamed("real_ratio", "budget_ratio")


@query(
    "h34_threshold_calibration",
    with_sql(VEC, PAIRS, """grid(t) AS (VALUES (CAST(0.25 AS DOUBLE)), (0.3), (0.35)), near AS MATERIALIZED (SELECT a, b, s FROM prs WHERE s >= 0.25), ord AS MATERIALIZED (SELECT memory_id, canonical_id, CAST(row_number() OVER (ORDER BY memory_id DESC) AS BIGINT) AS p FROM emb),
      hits AS (SELECT g.t, e.a, list(n.p) AS nb FROM near e JOIN ord n ON n.memory_id = e.b JOIN grid g ON e.s >= g.t GROUP BY 1, 2),
      nbrs AS MATERIALIZED (SELECT g.t, o.p, coalesce(h.nb, CAST([] AS BIGINT[])) AS nb FROM grid g CROSS JOIN ord o LEFT JOIN hits h ON h.t = g.t AND h.a = o.memory_id),
      walk AS (SELECT t, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM grid UNION ALL SELECT w.t, k + 1, CASE WHEN list_has_any(kept, nb) THEN kept ELSE list_append(kept, k + 1) END FROM walk w JOIN nbrs n ON n.t = w.t AND n.p = k + 1),
      fin AS (SELECT t, arg_max(kept, k) AS kept FROM walk GROUP BY 1),
      posn AS (SELECT f.t, o.memory_id, row_number() OVER (PARTITION BY f.t ORDER BY CAST(NOT list_contains(f.kept, o.p) AS INT), o.p) AS pos FROM fin f, ord o),
      kp AS (SELECT t, b.r, memory_id FROM posn, (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75)) b(r) WHERE pos <= floor((SELECT count(*) FROM emb) * r)),
      rr AS (SELECT t, r, query_id, memory_id, canonical_id, row_number() OVER (PARTITION BY t, r, query_id ORDER BY score DESC, memory_id) AS rank FROM sc JOIN kp USING (memory_id)),
      mm AS (SELECT t, r, avg(coalesce(1.0 / fr, 0)) AS mrr FROM (SELECT t, r, query_id, min(rank) FILTER (WHERE memory_id = target_memory_id) AS fr FROM rr JOIN asked USING (query_id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
      tt AS (SELECT t, round(avg(mrr), 9) AS score FROM mm GROUP BY 1)""",
      "SELECT t AS threshold, score, row_number() OVER (ORDER BY score DESC, t DESC) = 1 AS chosen FROM tt"),
)
def h34(spark, sf):
    """Mean exact reciprocal rank over the budgets per threshold; ties go to the larger threshold."""
    from ledgerkeep.operators.choice import choose_threshold

    rows, scores = scored(spark, sf)
    scores = cut(scores)
    trials = None
    for t in (0.25, 0.3, 0.35):
        order = sim.semantic_order(rows, sim.greedy_representatives(rows, ["scope"], t), ["scope"])
        kept = sel.top_by_count(order, ["scope"], [F.col("position")], BUDGETS).select("budget_ratio", "memory_id", F.lit(t).alias("threshold"))
        trials = kept if trials is None else trials.unionByName(kept)
    ranks = ret.target_ranks(scores.join(cut(trials), "memory_id"), asked(rows), ["threshold", "budget_ratio"])
    return choose_threshold(met.ranking_metrics(ranks, ["threshold", "budget_ratio"]), "exact_mrr")


# --- texts: benchmark passages ask the documents -----------------------------------------------------------


def bag_sql(name: str, source: str, key: str) -> str:
    return f"""
{name}_t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]')) AS tok FROM {source}),
{name}_c AS (SELECT k, CAST('0x'||substr(sha256(tok), 7, 2) AS INT) AS bucket, count(*) AS hits FROM {name}_t GROUP BY 1, 2),
{name} AS (SELECT k, bucket, hits / greatest(sqrt(sum(hits*hits) OVER (PARTITION BY k)), 1e-12) AS w FROM {name}_c)"""


@query("d1_tokens", with_sql(bag_sql("b", "documents", "doc_id"), "SELECT k AS doc_id, tok AS token, count(*) AS hits FROM b_t GROUP BY 1, 2"))
def d1(spark, sf):
    docs = spread(table(spark, sf, "documents", "doc_id", "text"))
    return docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("hits"))


@query("d2_hash_buckets", with_sql(bag_sql("b", "documents", "doc_id"), "SELECT bucket, count(DISTINCT tok) AS tokens FROM (SELECT tok, CAST('0x'||substr(sha256(tok), 7, 2) AS INT) AS bucket FROM b_t) GROUP BY 1"))
def d2(spark, sf):
    docs = spread(table(spark, sf, "documents", "text"))
    words = docs.select(F.explode(tx.tokens(F.col("text"))).alias("token")).distinct()
    return words.groupBy(token_bucket(F.col("token")).alias("bucket")).agg(F.count("*").alias("tokens"))


@query("d3_hashed_bag", with_sql(bag_sql("b", "documents", "doc_id"), "SELECT k AS doc_id, bucket, round(w, 9) AS weight FROM b"))
def d3(spark, sf):
    docs = spread(table(spark, sf, "documents", "doc_id", "text"))
    return bag_of_words(docs, "doc_id", "text").withColumn("weight", F.round("weight", 9))


QUERY_PREFIX = "Query: "


def doc_search(spark, sf, k):
    docs = dense_vectors(spread(table(spark, sf, "documents", "doc_id", "text")).withColumnRenamed("doc_id", "memory_id"), "memory_id", "text")
    asks = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit(QUERY_PREFIX), "text").alias("text"))
    return sim.top_k(docs, dense_vectors(asks, "query_id", "text"), k)


DOC_SEARCH = (
    bag_sql("d", "documents", "doc_id"), bag_sql("q", "(SELECT item_id, 'Query: '||text AS text FROM benchmark)", "item_id"),
    "dsc AS (SELECT q.k AS query_id, d.k AS memory_id, round(sum(d.w*q.w), 12) AS score FROM d JOIN q USING (bucket) GROUP BY 1, 2)",
    "dtop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM dsc)",
)


@query("e1_text_search", with_sql(*DOC_SEARCH, "SELECT query_id, memory_id, round(score, 6) AS score, rank FROM dtop WHERE rank <= 10"))
def e1_text(spark, sf):
    return doc_search(spark, sf, 10).withColumn("score", F.round("score", 6))


LIVE = (
    ol.LOG, "live AS (SELECT memory_id, content AS text FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem n WHERE n.supersedes = m.memory_id))",
    bag_sql("lv", "live", "memory_id"), bag_sql("aq", "(SELECT n_nationkey, 'Query: customer '||n_nationkey||' owes' AS text FROM nation)", "n_nationkey"),
    "lsc AS (SELECT aq.k AS query_id, lv.k AS memory_id, round(sum(lv.w*aq.w), 12) AS score FROM lv JOIN aq USING (bucket) GROUP BY 1, 2)",
    "ltop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM lsc)",
)


@query("e1_live_log_search", with_sql(*LIVE, "SELECT query_id, memory_id, round(score, 6) AS score, rank FROM ltop WHERE rank <= 5"))
def e1_live(spark, sf):
    """Questions over the log as it stands: superseded records are never found. Finished orders' vectors are in store."""
    log = ol.log(spark, sf)
    stored = dense_vectors(log.where("source = 'F'"), "memory_id", "content").withColumn("embedding_version", F.lit(ol.VERSION))
    asks = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("query_id"), F.concat(F.lit(QUERY_PREFIX + "customer "), F.col("n_nationkey").cast("string"), F.lit(" owes")).alias("text")
    )
    hits = search_active_log(kn.staged_log(spark, sf), stored, dense_vectors(asks, "query_id", "text"), 5, ol.VERSION)
    return hits.select("query_id", "memory_id", F.round("score", 6).alias("score"), "rank")


COSTS = "cst AS (SELECT doc_id AS memory_id, CAST(strlen(to_json({'content': text, 'memory_id': CAST(doc_id AS VARCHAR)})) + 3 AS BIGINT) AS cost FROM documents)"
BUDGETED = """hd AS (SELECT query_id, list({'id': memory_id, 'cost': cost} ORDER BY rank) AS e FROM dtop JOIN cst USING (memory_id) WHERE rank <= 10 GROUP BY 1),
ctx AS (SELECT query_id, e, 0 AS k, CAST(0 AS BIGINT) AS memory_tokens, CAST([] AS BIGINT[]) AS taken FROM hd UNION ALL
  SELECT query_id, e, k+1, CASE WHEN memory_tokens + e[k+1].cost + CAST(len(taken) > 0 AS INT) <= 4000 THEN memory_tokens + e[k+1].cost + CAST(len(taken) > 0 AS INT) ELSE memory_tokens END,
   CASE WHEN memory_tokens + e[k+1].cost + CAST(len(taken) > 0 AS INT) <= 4000 THEN list_append(taken, e[k+1].id) ELSE taken END FROM ctx WHERE k < len(e)),
ctxf AS (SELECT * FROM ctx WHERE k = len(e))"""


def doc_costs(spark, sf):
    docs = spread(table(spark, sf, "documents", "doc_id", "text"))
    return docs.select(F.col("doc_id").alias("memory_id"), tx.storage_bytes(F.col("doc_id"), F.col("text")).alias("cost"))


@query("e2_budgeted_retrieval", with_sql(*DOC_SEARCH, COSTS, BUDGETED, "SELECT query_id, array_to_string(taken, ',') AS context_ids, memory_tokens FROM ctxf"))
def e2(spark, sf):
    hits = doc_search(spark, sf, 10).join(doc_costs(spark, sf), "memory_id")
    read = ret.budgeted_context(hits, ["query_id"], 4000)
    return read.withColumn("context_ids", F.array_join(F.transform("context_ids", lambda m: m.cast("string")), ","))


@query("h2_retrieved_tokens", with_sql(*DOC_SEARCH, "SELECT round(avg(t), 6) AS retrieved_tokens, count(*) AS queries FROM (SELECT query_id, sum(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''))) AS t FROM dtop JOIN documents ON doc_id = memory_id WHERE rank <= 5 GROUP BY 1)"))
def h2(spark, sf):
    docs = spread(table(spark, sf, "documents", "doc_id", "text")).select(F.col("doc_id").alias("memory_id"), tx.word_count(F.col("text")).alias("tokens"))
    per_query = doc_search(spark, sf, 5).join(docs, "memory_id").groupBy("query_id").agg(F.sum("tokens").alias("t"))
    return per_query.agg(F.round(F.avg("t"), 6).alias("retrieved_tokens"), F.count("*").alias("queries"))


@query(
    "e13_hit_evidence",
    with_sql(*DOC_SEARCH, "SELECT query_id, k.k AS k, CAST(count(*) FILTER (WHERE memory_id % 40 = query_id % 40) > 0 AS INT) AS recall_at_k FROM dtop, (VALUES (1), (3), (5)) k(k) WHERE rank <= k.k GROUP BY 1, 2"),
)
def e13(spark, sf):
    """The fact of a passage is its id modulo 40, shared with documents."""
    hits = doc_search(spark, sf, 5).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda h: h.memory_id % 40).alias("facts")
    )
    grid = hits.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    return grid.select("query_id", "k", F.array_contains(F.slice("facts", F.lit(1), F.col("k")), F.col("query_id") % 40).cast("int").alias("recall_at_k"))


@query(
    "c12_answer_memories",
    with_sql(*DOC_SEARCH, """SELECT query_id, text AS content, CAST(0.3 AS DOUBLE) AS importance, 'generated_answer' AS source, '{"evidence_ids":['||ids||'],"verified":false}' AS metadata
      FROM (SELECT query_id, string_agg(CAST(memory_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM dtop WHERE rank <= 3 GROUP BY 1) JOIN benchmark ON item_id = query_id"""),
)
def c12(spark, sf):
    hits = doc_search(spark, sf, 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))).alias("hits"))
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    return mem.answer_memories(hits.join(texts, "query_id")).select("query_id", "content", "importance", "source", "metadata")


# --- chunks ------------------------------------------------------------------------------------------------

CHUNK, OVERLAP = 128, 16
CHUNKS = f"""
pg AS (SELECT doc_id AS page_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS toks FROM documents),
chk AS (SELECT page_id, toks, CAST(i.i * {CHUNK - OVERLAP} AS BIGINT) AS "start", CAST(least(i.i * {CHUNK - OVERLAP} + {CHUNK}, len(toks)) AS BIGINT) AS "end"
  FROM pg, LATERAL (SELECT unnest(range(CAST(greatest(ceil((len(toks) - {CHUNK}) / {CHUNK - OVERLAP}.0), 0) AS BIGINT) + 1)) AS i) i WHERE len(toks) > 0)
"""


def pages(spark, sf):
    docs = spread(table(spark, sf, "documents", "doc_id", "text"))
    return docs.select(F.col("doc_id").alias("page_id"), F.filter(F.split(F.trim("text"), "\\s+"), lambda w: w != "").alias("token_ids"))


def page_chunks(spark, sf):
    return ch.chunks(pages(spark, sf), CHUNK, OVERLAP)


@query("e7_chunk_ranges", with_sql(CHUNKS, 'SELECT page_id, "start", "end", md5(array_to_string(toks["start" + 1:"end"], \' \')) AS digest FROM chk'))
def e7(spark, sf):
    rows = page_chunks(spark, sf)
    return rows.select("page_id", "start", "end", F.md5(F.array_join("chunk_tokens", " ").cast("binary")).alias("digest"))


def modality_scores(spark, sf):
    """Scores of documents for each passage by their best chunks, and as a whole."""
    rows = page_chunks(spark, sf).select(F.col("page_id").alias("memory_id"), "start", F.array_join("chunk_tokens", " ").alias("text"))
    asks = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    qv = cut(dense_vectors(asks, "query_id", "text"))
    by_chunk = sim.score_all(dense_vectors(rows, "memory_id", "text", "start"), qv, part="start").withColumnRenamed("memory_id", "page_id")
    joined = ch.bound(F.col("token_ids"), lambda t: F.when(F.size(t) > 0, F.array(F.array_join(t, " "))))
    whole = pages(spark, sf).select(F.col("page_id").alias("memory_id"), F.explode_outer(joined).alias("text")).where(F.col("text").isNotNull())
    flat = sim.score_all(dense_vectors(whole, "memory_id", "text"), qv).withColumnRenamed("memory_id", "page_id")
    return by_chunk, flat


MODAL = (
    CHUNKS, bag_sql("cb", "(SELECT page_id, \"start\" AS st, array_to_string(toks[\"start\" + 1:\"end\"], ' ') AS text FROM chk)", "page_id * 1000000 + st"),
    bag_sql("wb", "(SELECT page_id, array_to_string(toks, ' ') AS text FROM pg WHERE len(toks) > 0)", "page_id"), bag_sql("qb", "benchmark", "item_id"),
    """csc AS (SELECT i.item_id AS query_id, page_id, "start", coalesce(s.score, 0.0) AS score FROM chk CROSS JOIN benchmark i
      LEFT JOIN (SELECT qb.k AS q, cb.k AS c, round(sum(cb.w*qb.w), 12) AS score FROM cb JOIN qb USING (bucket) GROUP BY 1, 2) s ON s.q = i.item_id AND s.c = page_id * 1000000 + "start"),
    pgs AS (SELECT query_id, page_id, max(score) AS score, arg_min("start", {'n': -score, 's': "start"}) AS best_start FROM csc GROUP BY 1, 2),
    wsc AS (SELECT i.item_id AS query_id, page_id, coalesce(s.score, 0.0) AS score FROM (SELECT page_id FROM pg WHERE len(toks) > 0) CROSS JOIN benchmark i
      LEFT JOIN (SELECT qb.k AS q, wb.k AS p, round(sum(wb.w*qb.w), 12) AS score FROM wb JOIN qb USING (bucket) GROUP BY 1, 2) s ON s.q = i.item_id AND s.p = page_id),
    modal AS (SELECT 'chunk' AS modality, query_id, page_id, score FROM pgs UNION ALL SELECT 'whole', query_id, page_id, score FROM wsc),
    mrank AS (SELECT *, row_number() OVER (PARTITION BY modality, query_id ORDER BY score DESC, page_id) AS rank FROM modal)""",
)


@query("e8_page_scores", with_sql(*MODAL, "SELECT query_id, page_id, round(score, 6) AS score FROM pgs"))
def e8(spark, sf):
    by_chunk, _ = modality_scores(spark, sf)
    return ch.page_scores(by_chunk).select("query_id", "page_id", F.round("score", 6).alias("score"))


def modal(spark, sf):
    by_chunk, flat = modality_scores(spark, sf)
    best = ch.page_scores(by_chunk)
    both = best.select(F.lit("chunk").alias("modality"), "query_id", "page_id", "score").unionByName(
        flat.select(F.lit("whole").alias("modality"), "query_id", "page_id", "score")
    )
    return best, both


@query("e9_page_ranking", with_sql(*MODAL, "SELECT modality, query_id, rank AS target_rank FROM mrank WHERE page_id = query_id"))
def e9(spark, sf):
    """Rank of the page with the passage's number, per modality; counted, not sorted."""
    _, both = modal(spark, sf)
    asks = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("item_id").alias("target_memory_id"), F.col("item_id").alias("target_canonical_id"), F.lit(-1).cast("long").alias("superseded_memory_id")
    )
    scored_pages = cut(both).select("modality", "query_id", F.col("page_id").alias("memory_id"), F.col("page_id").alias("canonical_id"), "score")
    ranks = ret.target_ranks(scored_pages, asks, ["modality"])
    return ranks.where(F.col("exact_rank").isNotNull()).select("modality", "query_id", F.col("exact_rank").alias("target_rank"))


@query(
    "e10_top_pages",
    with_sql(*MODAL, "SELECT query_id, rank, max(page_id) FILTER (WHERE modality = 'chunk') AS chunk, max(page_id) FILTER (WHERE modality = 'whole') AS whole FROM mrank WHERE rank <= 3 GROUP BY 1, 2"),
)
def e10(spark, sf):
    _, both = modal(spark, sf)
    return ch.pages_by_modality(ch.top_pages(both, 3), ["chunk", "whole"])


@query("e10_best_chunk", with_sql(*MODAL, "SELECT query_id, best_start, round(score, 6) AS score FROM pgs WHERE page_id = query_id"))
def e10_chunk(spark, sf):
    best, _ = modal(spark, sf)
    return best.where(F.col("page_id") == F.col("query_id")).select("query_id", "best_start", F.round("score", 6).alias("score"))


@query(
    "e11_chunk_coverage",
    with_sql(CHUNKS, f"""SELECT page_id, CASE WHEN len(toks) <= {CHUNK} THEN 'no_chunks' ELSE 'start' END AS reason FROM pg WHERE len(toks) > 0
      UNION ALL SELECT page_id, 'no_chunks' FROM pg WHERE len(toks) = 0"""),
)
def e11(spark, sf):
    """Every page's first chunk is lost; the audit must name each page."""
    lengths = pages(spark, sf).select("page_id", F.size("token_ids").cast("long").alias("length"))
    return ch.coverage_violations(page_chunks(spark, sf).where("start > 0"), lengths)


# --- history: assistant turns ask, user turns are remembered -----------------------------------------------

HISTORY = (
    "turns AS (SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS id FROM conversations)", bag_sql("tb", "turns", "id"),
    """hm AS (SELECT conv_id, id, turn, CAST(strlen(to_json({'content': text, 'memory_id': CAST(id AS VARCHAR)})) + 3 AS BIGINT) AS cost FROM turns WHERE role = 'user'),
    hq AS (SELECT conv_id, id, turn FROM turns WHERE role = 'assistant'),
    hp AS (SELECT q.conv_id, q.id AS query_id, m.id AS memory_id, m.cost, coalesce((SELECT round(sum(a.w*b.w), 12) FROM tb a JOIN tb b USING (bucket) WHERE a.k = q.id AND b.k = m.id), 0.0) AS score FROM hq q JOIN hm m ON m.conv_id = q.conv_id AND m.turn < q.turn),
    hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM hp),
    he AS (SELECT conv_id, query_id, list({'id': memory_id, 'cost': cost} ORDER BY rank) AS e FROM hr WHERE rank <= 3 GROUP BY 1, 2),
    hc AS (SELECT conv_id, query_id, e, 0 AS k, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS taken FROM he UNION ALL
      SELECT conv_id, query_id, e, k+1, CASE WHEN used + e[k+1].cost + CAST(len(taken) > 0 AS INT) <= 600 THEN used + e[k+1].cost + CAST(len(taken) > 0 AS INT) ELSE used END,
        CASE WHEN used + e[k+1].cost + CAST(len(taken) > 0 AS INT) <= 600 THEN list_append(taken, e[k+1].id) ELSE taken END FROM hc WHERE k < len(e)),
    hf AS (SELECT memory_id, count(*) AS f FROM (SELECT unnest(taken) AS memory_id FROM hc WHERE k = len(e)) GROUP BY 1),
    hs AS (SELECT memory_id, max(score) AS s FROM hp GROUP BY 1),
    hfe AS (SELECT m.conv_id AS snapshot_id, m.id AS memory_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn DESC, m.id) - 1 AS recency_rank, d.d - m.turn AS age, coalesce(f, 0) AS retrieval_frequency,
      s IS NOT NULL AS history_observed, s AS historical_similarity, cost AS memory_tokens
      FROM hm m JOIN (SELECT conv_id, max(turn) + 1 AS d FROM turns GROUP BY 1) d USING (conv_id) LEFT JOIN hf ON hf.memory_id = m.id LEFT JOIN hs ON hs.memory_id = m.id)""",
)


def conversation(spark, sf):
    """(memories, history, decisions) of the conversations."""
    turns = spread(table(spark, sf, "conversations")).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    cost = tx.storage_bytes(F.col("id"), F.col("text")).alias("cost")
    rows = cut(
        turns.select(
            F.col("conv_id").alias("snapshot_id"), "id", F.col("turn").alias("event_order"), "role", cost, dense_vector(F.col("text")).alias("vector")
        )
    )
    memories = rows.where("role = 'user'").select("snapshot_id", F.col("id").alias("memory_id"), "event_order", "vector", "cost")
    history = rows.where("role = 'assistant'").select("snapshot_id", F.col("id").alias("query_id"), "event_order", "vector")
    decisions = rows.groupBy("snapshot_id").agg((F.max("event_order") + 1).alias("decision"))
    return memories, history, decisions


def features(spark, sf):
    return ret.history_features(*conversation(spark, sf), top_k=3, read_budget=600)


@query("f1_available_memories", "SELECT event_id, user_id, CAST(count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS available FROM events")
def f1(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type")
    counts = ret.available_counts(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type").isin("purchase", "signup"))
    return counts.select("event_id", "user_id", "available")


@query("f2_retrieval_frequency", with_sql(*HISTORY, "SELECT snapshot_id, memory_id, retrieval_frequency FROM hfe"))
def f2(spark, sf):
    return features(spark, sf).select("snapshot_id", "memory_id", "retrieval_frequency")


@query("f3_historical_similarity", with_sql(*HISTORY, "SELECT snapshot_id, memory_id, round(historical_similarity, 6) AS historical_similarity FROM hfe"))
def f3(spark, sf):
    return features(spark, sf).select("snapshot_id", "memory_id", F.round("historical_similarity", 6).alias("historical_similarity"))


@query("f4_history_observed", with_sql(*HISTORY, "SELECT snapshot_id, memory_id, history_observed FROM hfe"))
def f4(spark, sf):
    return features(spark, sf).select("snapshot_id", "memory_id", "history_observed")


@query("f5_recency_rank", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS recency_rank FROM events")
def f5(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "ts")
    ranked = rank_in_group(e, ["user_id"], [-F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")])
    return ranked.select("event_id", "user_id", (F.col("rank") - 1).alias("recency_rank"))


@query("f6_age_and_cost", with_sql(*HISTORY, "SELECT snapshot_id, memory_id, recency_rank, age, memory_tokens FROM hfe"))
def f6(spark, sf):
    return features(spark, sf).select("snapshot_id", "memory_id", "recency_rank", "age", "memory_tokens")


@query(
    "f7_future_guard",
    "SELECT c.conv_id AS snapshot_id, c.turn AS event_order FROM conversations c JOIN (SELECT conv_id, max(turn) AS d FROM conversations WHERE role = 'user' GROUP BY 1) d USING (conv_id) WHERE role = 'assistant' AND turn >= d",
)
def f7(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "role").withColumnsRenamed({"conv_id": "snapshot_id", "turn": "event_order"})
    decisions = c.where("role = 'user'").groupBy("snapshot_id").agg(F.max("event_order").alias("decision"))
    return ret.future_history(c.where("role = 'assistant'"), decisions).select("snapshot_id", "event_order")


@query(
    "f8_stratified_sample",
    """SELECT user_id, event_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY user_id, stratum ORDER BY CAST('0x'||substr(md5('5:'||event_id), 1, 8) AS BIGINT), event_id) AS rn
      FROM (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'retrieved' ELSE 'other' END AS stratum FROM events)) WHERE rn <= 2""",
)
def f8(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "event_type")
    stratum = F.when(F.col("event_type") == "view", "retrieved").otherwise("other")
    sample = ret.stratified_sample(e, ["user_id"], stratum, 2, draw32(F.lit(5), F.col("event_id")), "event_id")
    return sample.select("user_id", "event_id", "stratum")
