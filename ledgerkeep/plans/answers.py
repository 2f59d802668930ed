"""Queries on texts and answers: scoring rules, prompts, condition summaries, run accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerkeep.functions import text as tx
from ledgerkeep.operators import metrics as met
from ledgerkeep.operators.choice import choose_per_group
from ledgerkeep.operators.evaluation import cheapest_support, covers, without
from ledgerkeep.operators.stats import exact_percentiles
from ledgerkeep.plans import baskets as bk
from ledgerkeep.plans import knowledge as kn
from ledgerkeep.plans import orderlog as ol
from ledgerkeep.plans import query
from ledgerkeep.plans.sqltext import with_sql
from ledgerkeep.sources.tables import spread, table

PUNCT = tx.PUNCTUATION.replace("'", "''")


def words_sql(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(translate(replace(lower({x}), 'ß', 'ss'), '{PUNCT}', ''), '\\s+'), "
        "lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"
    )


def norm_sql(x: str) -> str:
    return f"array_to_string({words_sql(x)}, ' ')"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- rules over whole text tables --------------------------------------------------------------------------


@query("d4_query_prefix", "SELECT item_id, 'Query: '||text AS text FROM benchmark")
def d4(spark, sf):
    return table(spark, sf, "benchmark").withColumn("text", F.concat(F.lit("Query: "), "text"))


@query("d5_normalized_answers", f"SELECT conv_id, turn, md5({norm_sql('text')}) AS digest FROM conversations")
def d5(spark, sf):
    return table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", F.md5(tx.normalize_answer(F.col("text")).cast("binary")).alias("digest")
    )


TURNS = f"""tp AS (SELECT a.conv_id, a.turn, a.text AS answer, g.text AS gold FROM conversations a JOIN conversations g ON g.conv_id = a.conv_id AND g.turn = a.turn - 1),
aw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({words_sql('answer')}) AS w FROM tp) GROUP BY 1, 2, 3),
gw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({words_sql('gold')}) AS w FROM tp) GROUP BY 1, 2, 3),
cm AS (SELECT conv_id, turn, CAST(sum(least(aw.n, gw.n)) AS BIGINT) AS common FROM aw JOIN gw USING (conv_id, turn, w) GROUP BY 1, 2),
tf AS (SELECT tp.*, coalesce(common, 0) AS common, CASE WHEN common > 0 THEN 2.0 * common / (len({words_sql('answer')}) + len({words_sql('gold')})) ELSE 0.0 END AS f1 FROM tp LEFT JOIN cm USING (conv_id, turn))"""


def turn_pairs(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    return c.withColumnRenamed("text", "answer").join(before, ["conv_id", "turn"])


@query("d6_answer_scores", with_sql(TURNS, f"SELECT conv_id, turn, CAST({norm_sql('answer')} = {norm_sql('gold')} AS INT) AS exact_match, round(f1, 9) AS token_f1 FROM tf"))
def d6(spark, sf):
    return turn_pairs(spark, sf).select(
        "conv_id",
        "turn",
        tx.exact_match(F.col("answer"), F.col("gold")).alias("exact_match"),
        F.round(tx.token_f1(F.col("answer"), F.col("gold")), 9).alias("token_f1"),
    )


@query("d6_long_text_overlap", with_sql(TURNS, "SELECT conv_id, turn, common, round(f1, 9) AS token_f1 FROM tf"))
def d6_long(spark, sf):
    sides = F.explode(
        F.array(
            F.struct(F.lit("answer").alias("side"), F.col("answer").alias("text")),
            F.struct(F.lit("gold").alias("side"), F.col("gold").alias("text")),
        )
    )
    rows = turn_pairs(spark, sf).select("conv_id", "turn", sides.alias("s")).select("conv_id", "turn", "s.side", tx.normalize_answer(F.col("s.text")).alias("t"))
    words = rows.select("conv_id", "turn", "side", F.explode(tx.words(F.col("t"))).alias("word"))
    shared = met.overlap_by_join(words, ["conv_id", "turn"])
    # pairs without any word have no row in the words, but a result
    whole = turn_pairs(spark, sf).select("conv_id", "turn").join(shared, ["conv_id", "turn"], "left")
    return whole.select("conv_id", "turn", F.coalesce("common", F.lit(0).cast("long")).alias("common"), F.round(F.coalesce("token_f1", F.lit(0.0)), 9).alias("token_f1"))


@query("d7_storage_bytes", "SELECT doc_id, CAST(strlen(to_json({'content': text, 'memory_id': CAST(doc_id AS VARCHAR)})) + 3 AS BIGINT) AS cost FROM documents")
def d7(spark, sf):
    docs = spread(table(spark, sf, "documents", "doc_id", "text"))
    return docs.select("doc_id", tx.storage_bytes(F.col("doc_id"), F.col("text")).alias("cost"))


@query("d8_word_counts", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def d8(spark, sf):
    return spread(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("d9_context_cost", with_sql(bk.ITEMS, "SELECT snapshot_id, CAST(sum(cost) + count(*) - 1 AS BIGINT) AS context_cost FROM items GROUP BY 1"))
def d9(spark, sf):
    grouped = bk.items(spark, sf).groupBy("snapshot_id").agg(F.collect_list("cost").alias("costs"))
    return grouped.select("snapshot_id", tx.joined_cost(F.col("costs")).cast("long").alias("context_cost"))


RATED = r"""CASE WHEN regexp_full_match(rating_text, '\s*[1-5](\.0)?[.!]?\s*')"""


@query("d10_ratings", with_sql(bk.ITEMS, bk.FEATURES, f"SELECT snapshot_id, memory_id, {RATED} THEN CAST(substr(trim(rating_text), 1, 1) AS BIGINT) ELSE 3 END AS score, {RATED} THEN TRUE ELSE FALSE END AS valid FROM feats"))
def d10(spark, sf):
    return bk.features(spark, sf).select("snapshot_id", "memory_id", F.inline(F.array(tx.parse_rating(F.col("rating_text")))))


@query(
    "d11_prompts",
    with_sql(ol.LOG, f"""SELECT memory_id, md5({quote(tx.RATING_PROMPT)} || content || {quote(tx.RATING_PROMPT_END)}) AS rating,
      md5({quote(tx.ANSWER_PROMPT)} || to_json({{'content': content, 'memory_id': memory_id}}) || {quote(tx.QUESTION_MARK)} || source || {quote(tx.ANSWER_MARK)}) AS answer,
      md5({quote(tx.CONTENT_PROMPT)} || content || {quote(tx.QUESTION_MARK)} || source || {quote(tx.ANSWER_MARK)}) AS content_only,
      md5({quote(tx.CITED_PROMPT)} || '[' || to_json({{'memory_id': memory_id, 'content': content}}) || ']' || {quote(tx.QUESTION_MARK)} || source || {quote(tx.ANSWER_MARK)}) AS cited FROM mem"""),
)
def d11(spark, sf):
    rows = ol.log(spark, sf)
    context = F.array(F.struct("memory_id", "content"))
    question = F.col("source")
    digest = lambda c: F.md5(c.cast("binary"))
    return rows.select(
        "memory_id",
        digest(tx.rating_prompt(F.col("content"))).alias("rating"),
        digest(tx.answer_prompt(question, context)).alias("answer"),
        digest(tx.content_prompt(question, F.array("content"))).alias("content_only"),
        digest(tx.cited_prompt(question, context)).alias("cited"),
    )


@query("d12_first_lines", "SELECT doc_id, md5(trim(split_part(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1), ' ')) AS first_line, contains(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AS completed FROM documents")
def d12(spark, sf):
    docs = spread(table(spark, sf, "documents", "doc_id", "text"))
    return docs.select(
        "doc_id",
        F.md5(tx.first_line(F.col("text")).cast("binary")).alias("first_line"),
        tx.has_completed_line(F.col("text")).alias("completed"),
    )


CODES = """codes AS (SELECT o_orderkey, lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS gold, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'G.' WHEN '2' THEN 'H' WHEN '3' THEN 'X' WHEN '4' THEN 'U' ELSE 'O' END AS kind FROM orders),
behave AS (SELECT o_orderkey, gold, CASE kind WHEN 'G.' THEN ' The '||gold||'.' WHEN 'H' THEN substr(gold, 4) WHEN 'X' THEN 'code '||gold||' it is' WHEN 'U' THEN ' UNKNOWN ' ELSE 'no idea' END AS answer FROM codes)"""


@query(
    "d13_answer_behaviour",
    with_sql(CODES, "SELECT o_orderkey, CASE substr(answer, 1, 3) WHEN ' Th' THEN 'correct' WHEN 'cod' THEN 'full_answer_with_extra_text' WHEN ' UN' THEN 'unknown' WHEN 'no ' THEN 'other_error' ELSE 'half_only' END AS behaviour FROM behave"),
)
def d13(spark, sf):
    return behaviours(spark, sf).select("o_orderkey", "behaviour")


def behaviours(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    three = lambda c: F.lpad((F.col(c) % 1000).cast("string"), 3, "0")
    gold = F.concat(three("o_custkey"), three("o_orderkey"))
    kind = F.substring("o_orderpriority", 1, 1)
    rows = o.withColumn("gold", gold).withColumn(
        "answer",
        F.when(kind == "1", F.concat(F.lit(" The "), "gold", F.lit(".")))
        .when(kind == "2", F.substring(F.col("gold"), 4, 99))
        .when(kind == "3", F.concat(F.lit("code "), "gold", F.lit(" it is")))
        .when(kind == "4", " UNKNOWN ")
        .otherwise("no idea"),
    )
    return rows.withColumn("behaviour", tx.answer_behaviour(F.col("answer"), F.col("gold"), F.lit(3)))


@query(
    "d14_template_values",
    with_sql(ol.LOG, "SELECT memory_id, CAST(key AS VARCHAR) AS value FROM (SELECT 'm'||o_orderkey AS memory_id, CAST(round(o_totalprice*100) AS BIGINT) AS key FROM orders)"),
)
def d14(spark, sf):
    """The value that, put into its relation's template, gives the sentence."""
    rows = ol.log(spark, sf).select("memory_id", "content", F.col("subject").cast("string").alias("subject"))
    values = table(spark, sf, "orders", "o_orderkey", "o_totalprice").select(
        F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("memory_id"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("value")
    )
    filled = F.concat(F.lit("Currently, customer "), "subject", F.lit(" owes "), "value", F.lit("."))
    return rows.join(values, "memory_id").where(F.col("content") == filled).select("memory_id", "value")


@query("d15_leakage_keys", "SELECT k AS text_key, count(*) AS copies FROM (SELECT md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS k FROM documents) GROUP BY 1 HAVING count(*) > 1")
def d15(spark, sf):
    docs = spread(table(spark, sf, "documents", "text"))
    return docs.groupBy(F.md5(tx.leakage_key(F.col("text")).cast("binary")).alias("text_key")).agg(F.count("*").alias("copies")).where("copies > 1")


@query(
    "d16_id_set_algebra",
    with_sql(bk.ITEMS, "w AS (SELECT snapshot_id, list_sort(list(memory_id)) AS ids, coalesce(list_sort(list(memory_id) FILTER (WHERE flag = 'R')), CAST([] AS BIGINT[])) AS r FROM items GROUP BY 1)",
      "SELECT snapshot_id, len(r) = len(ids) AS covered, array_to_string(list_filter(ids, lambda m: NOT list_contains(r, m)), ',') AS rest, array_to_string(list_filter(ids, lambda m: m <> 2), ',') AS without_two, list_contains(r, 1) AS has_one FROM w"),
)
def d16(spark, sf):
    red = F.when(F.col("flag") == "R", F.col("memory_id"))
    rows = bk.items(spark, sf).groupBy("snapshot_id").agg(
        F.array_sort(F.collect_list("memory_id")).alias("ids"), F.array_sort(F.collect_list(red)).alias("r")
    )
    rest = rows.withColumn("rest", F.array_except("ids", "r")).withColumn("two", without(F.col("ids"), F.lit(2).cast("long")))
    return rest.select(
        "snapshot_id",
        covers(F.array("ids"), F.col("r")).alias("covered"),
        bk.ids_text("rest").alias("rest"),
        bk.ids_text("two").alias("without_two"),
        F.array_contains("r", F.lit(1).cast("long")).alias("has_one"),
    )


@query(
    "d17_support_costs",
    with_sql(bk.ITEMS, bk.QUERIES, "cs AS (SELECT snapshot_id, map_from_entries(list({'k': memory_id, 'v': cost})) AS cm FROM items GROUP BY 1)",
      "SELECT a.snapshot_id, query_id, CAST(list_min(list_transform(supports, lambda g: list_sum(list_transform(g, lambda m: cm[m])))) AS BIGINT) AS minimum FROM asks a JOIN cs USING (snapshot_id)"),
)
def d17(spark, sf):
    rows = bk.items(spark, sf)
    costs = rows.groupBy("snapshot_id").agg(F.map_from_entries(F.collect_list(F.struct("memory_id", "cost"))).alias("costs"))
    return bk.queries(rows).join(costs, "snapshot_id").select("snapshot_id", "query_id", cheapest_support(F.col("supports"), F.col("costs")).alias("minimum"))


@query(
    "d18_budget_arithmetic",
    "SELECT event_id, CAST(floor(CAST(json_extract_string(props, '$.k') AS BIGINT) * 0.25) AS BIGINT) AS quarter, greatest(-1.0, least(1.0, (value - 20) / 20)) AS clipped, isfinite(value) AS finite FROM events",
)
def d18(spark, sf):
    e = table(spark, sf, "events", "event_id", "value", "props")
    k = F.from_json("props", "k bigint")["k"]
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 20) / 20))
    return e.select("event_id", F.floor(k * 0.25).alias("quarter"), clipped.alias("clipped"), finite.alias("finite"))


@query("d19_timestamp_offsets", "SELECT o_orderkey, o_orderstatus <> 'P' AS valid FROM orders")
def d19(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    tail = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "F", "Z").otherwise("+02:00")
    return o.select("o_orderkey", tx.has_offset(F.concat(stamp, tail)).alias("valid"))


@query("d20_canonical_metadata", """SELECT event_id, '{"event":"'||event_type||'","k":'||json_extract_string(props, '$.k')||',"more":{"a":[1.5,null],"b":'||event_id||'}}' AS metadata FROM events""")
def d20(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type", "props")
    unsorted = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "more": {"b": '), F.col("event_id").cast("string"), F.lit(', "a": [1.50, null]}, "event": "'), "event_type", F.lit('"}'))
    return e.select("event_id", tx.canonical_json(unsorted).alias("metadata"))


# --- answers under conditions ------------------------------------------------------------------------------


def answered(spark, sf):
    """One answer per case and condition: the reader repeats the first amount it was shown, sometimes with a second line."""
    rows = kn.shown(spark, sf)
    gold = ol.log(spark, sf).select(
        F.col("seq").alias("case_id"),
        F.regexp_extract("content", "owes (\\d+)", 1).alias("gold_answer"),
        F.col("memory_id").alias("target"),
        "event_order",
        F.col("subject").alias("trajectory_id"),
        F.col("source"),
    )
    seen = F.nullif(F.regexp_extract("contents", "owes (\\d+)", 1), F.lit(""))
    talk = F.when(F.col("event_order") % 5 == 0, "\nas noted").otherwise("")
    joined = rows.join(gold, "case_id").withColumn("generated_answer", F.concat(F.coalesce(seen, F.lit("UNKNOWN")), talk))
    answer, truth = F.col("generated_answer"), F.col("gold_answer")
    retrieves = F.col("condition").isin("conflicting", "irrelevant")
    return joined.select(
        "case_id",
        "condition",
        "trajectory_id",
        "source",
        (F.col("event_order") % 3).alias("seed"),
        "generated_answer",
        "gold_answer",
        tx.exact_match(answer, truth).alias("exact_match"),
        tx.token_f1(answer, truth).alias("f1"),
        tx.exact_match(tx.first_line(answer), truth).alias("first_line_em"),
        tx.word_count(F.col("contents")).alias("memory_tokens"),
        F.when(retrieves, F.array_contains(F.split("ids", ","), F.col("target")).cast("int")).alias("recall_at_k"),
        F.when(retrieves, (F.col("event_order") % 2).cast("int")).alias("target_fact_retained"),
    )


ANSWERED = f"""an0 AS (SELECT s.*, regexp_extract(m.content, 'owes (\\d+)', 1) AS gold_answer, m.memory_id AS target, m.event_order, m.subject AS trajectory_id, m.source,
   coalesce(nullif(regexp_extract(s.contents, 'owes (\\d+)', 1), ''), 'UNKNOWN') AS seen FROM shown s JOIN mem m ON m.seq = s.case_id),
an AS (SELECT *, event_order % 3 AS seed, CASE WHEN event_order % 5 = 0 THEN seen || chr(10) || 'as noted' ELSE seen END AS generated_answer,
   CAST(seen = gold_answer AND event_order % 5 <> 0 AS INT) AS exact_match, CAST(seen = gold_answer AS INT) AS first_line_em,
   CASE WHEN seen <> gold_answer THEN 0.0 WHEN event_order % 5 = 0 THEN 0.5 ELSE 1.0 END AS f1,
   CAST(len(list_filter(regexp_split_to_array(trim(contents), '\\s+'), lambda x: x <> '')) AS BIGINT) AS memory_tokens,
   CASE WHEN condition IN ('conflicting', 'irrelevant') THEN CAST(list_contains(string_split(ids, ','), target) AS INT) END AS recall_at_k,
   CASE WHEN condition IN ('conflicting', 'irrelevant') THEN event_order % 2 END AS target_fact_retained FROM an0)"""
ANSWER_CTES = (ol.LOG, kn.CASES, ANSWERED)


@query(
    "h3_condition_summary",
    with_sql(*ANSWER_CTES, """base AS (SELECT case_id, exact_match AS b FROM an WHERE condition = 'no_memory'), sd AS (SELECT condition, stddev_pop(m) AS seed_sd FROM (SELECT condition, seed, avg(exact_match) AS m FROM an GROUP BY 1, 2) GROUP BY 1)""",
      """SELECT condition, count(*) AS n, round(avg(exact_match), 6) AS exact_match, round(avg(f1), 6) AS f1, round(avg(exact_match - b), 6) AS utility, count(*) FILTER (WHERE exact_match > b) AS positive, count(*) FILTER (WHERE exact_match < b) AS negative,
      round(avg(recall_at_k), 6) AS recall, CASE WHEN count(recall_at_k) > 0 THEN count(*) FILTER (WHERE recall_at_k = 0) END AS retrieval_misses, CASE WHEN count(recall_at_k) > 0 THEN count(*) FILTER (WHERE target_fact_retained = 0) END AS pruned_target,
      CASE WHEN count(recall_at_k) > 0 THEN count(*) FILTER (WHERE recall_at_k = 1 AND exact_match = 0) END AS hit_but_wrong, round(avg(memory_tokens), 6) AS memory_tokens, round(any_value(seed_sd), 6) AS seed_sd
      FROM an JOIN base USING (case_id) JOIN sd USING (condition) GROUP BY 1"""),
)
def h3(spark, sf):
    table_ = met.condition_summary(answered(spark, sf))
    return table_.withColumns({c: F.round(c, 6) for c in ("exact_match", "f1", "utility", "recall", "memory_tokens", "seed_sd")})


@query(
    "h4_paired_difference",
    with_sql(*ANSWER_CTES, "d AS (SELECT a.exact_match - b.exact_match AS d FROM an a JOIN an b USING (case_id) WHERE a.condition = 'consolidation_keep_temporal_cue' AND b.condition = 'conflicting')",
      "SELECT count(*) AS n, round(avg(d), 6) AS mean_difference, count(*) FILTER (WHERE d > 0) AS improved, count(*) FILTER (WHERE d < 0) AS worsened, count(*) FILTER (WHERE d = 0) AS unchanged FROM d"),
)
def h4(spark, sf):
    rows = answered(spark, sf)
    pair = met.paired_difference(
        rows.where("condition = 'consolidation_keep_temporal_cue'"), rows.where("condition = 'conflicting'"), "case_id"
    )
    return pair.withColumn("mean_difference", F.round("mean_difference", 6))


@query("h5_format_sensitivity", with_sql(*ANSWER_CTES, "SELECT condition, round(avg(exact_match), 6) AS strict_em, round(avg(first_line_em), 6) AS first_line_em, count(*) FILTER (WHERE contains(generated_answer, chr(10))) AS multiline_answers FROM an GROUP BY 1"))
def h5(spark, sf):
    return met.format_sensitivity(answered(spark, sf)).withColumns({c: F.round(c, 6) for c in ("strict_em", "first_line_em")})


@query(
    "h11_score_tables",
    with_sql(*ANSWER_CTES, "it AS (SELECT condition, source, trajectory_id, avg(exact_match) AS v FROM an GROUP BY 1, 2, 3)",
      "SELECT condition, round(avg(v) FILTER (WHERE source = 'F'), 6) AS train, round(avg(v) FILTER (WHERE source = 'O'), 6) AS validation, round(avg(v) FILTER (WHERE source = 'P'), 6) AS test FROM it GROUP BY 1"),
)
def h11(spark, sf):
    split = F.when(F.col("source") == "F", "train").when(F.col("source") == "O", "validation").otherwise("test")
    scores = met.score_table(answered(spark, sf).withColumn("split", split), ["train", "validation", "test"])
    return scores.withColumns({c: F.round(c, 6) for c in ("train", "validation", "test")})


@query(
    "h41_answer_categories",
    with_sql(*ANSWER_CTES, """w AS (SELECT a.*, n.exact_match AS base, r.exact_match AS rel, c.exact_match AS con FROM an a JOIN an n ON n.case_id = a.case_id AND n.condition = 'no_memory' JOIN an r ON r.case_id = a.case_id AND r.condition = 'relevant' JOIN an c ON c.case_id = a.case_id AND c.condition = 'conflicting')""",
      """SELECT case_id, condition, 'positive_utility' AS category FROM w WHERE exact_match > base UNION ALL SELECT case_id, condition, 'negative_utility' FROM w WHERE exact_match < base
      UNION ALL SELECT case_id, condition, 'retrieval_miss' FROM w WHERE recall_at_k = 0 UNION ALL SELECT case_id, condition, 'hit_but_wrong' FROM w WHERE recall_at_k = 1 AND exact_match = 0
      UNION ALL SELECT case_id, condition, 'hit_but_wrong_value' FROM w WHERE recall_at_k = 1 AND first_line_em = 0 UNION ALL SELECT case_id, condition, 'conflict_degradation' FROM w WHERE condition = 'conflicting' AND exact_match < rel
      UNION ALL SELECT case_id, condition, 'consolidation_degradation' FROM w WHERE condition = 'consolidation_strip_temporal_cue' AND exact_match < con"""),
)
def h41(spark, sf):
    return met.answer_categories(answered(spark, sf))


@query(
    "h36_protocol_selection",
    with_sql(*ANSWER_CTES, """p AS (SELECT 'plain_eos' AS protocol, 3 AS ord, avg(exact_match) AS em FROM an WHERE source = 'F' UNION ALL SELECT 'plain_line', 2, avg(first_line_em) FROM an WHERE source = 'F'
      UNION ALL SELECT 'chat_line', 0, avg(first_line_em) FROM an WHERE source = 'F')""", "SELECT 'dev' AS stage, arg_min(protocol, {'e': -em, 'o': ord}) AS chosen FROM p"),
)
def h36(spark, sf):
    """Chosen on development cases only; equal scores fall back to the fixed order."""
    dev = answered(spark, sf).where("source = 'F'")
    means = dev.agg(F.avg("exact_match").alias("whole"), F.avg("first_line_em").alias("line"))
    protocols = F.array(
        F.struct(F.lit("chat_line").alias("protocol"), F.lit(0).alias("ord"), F.col("line").alias("em")),
        F.struct(F.lit("plain_line").alias("protocol"), F.lit(2).alias("ord"), F.col("line").alias("em")),
        F.struct(F.lit("plain_eos").alias("protocol"), F.lit(3).alias("ord"), F.col("whole").alias("em")),
    )
    trials = means.select(F.lit("dev").alias("stage"), F.inline(protocols))
    return choose_per_group(trials, ["stage"], "protocol", [-F.col("em"), F.col("ord")])


@query(
    "h39_evidence_controls",
    with_sql(CODES, "SELECT substr(o_orderpriority, 1, 1) AS condition, CASE substr(answer, 1, 3) WHEN ' Th' THEN 'correct' WHEN 'cod' THEN 'full_answer_with_extra_text' WHEN ' UN' THEN 'unknown' WHEN 'no ' THEN 'other_error' ELSE 'half_only' END AS behaviour, count(*) AS answers FROM behave JOIN orders USING (o_orderkey) GROUP BY 1, 2"),
)
def h39(spark, sf):
    rows = behaviours(spark, sf)
    return rows.groupBy(F.substring("o_orderpriority", 1, 1).alias("condition"), "behaviour").agg(F.count("*").alias("answers"))


@query(
    "h30_repeat_stability",
    with_sql(*ANSWER_CTES, "SELECT a.source, count(*) AS answers, count(*) FILTER (WHERE a.generated_answer <> b.generated_answer) AS changed FROM an a JOIN an b USING (case_id) WHERE a.condition = 'relevant' AND b.condition = 'conflicting' GROUP BY 1"),
)
def h30(spark, sf):
    rows = answered(spark, sf).withColumnRenamed("generated_answer", "answer")
    return met.changed_answers(rows.where("condition = 'relevant'"), rows.where("condition = 'conflicting'"), ["case_id"], ["source"])


# --- run accounting ----------------------------------------------------------------------------------------


@query(
    "h31_seed_spread",
    "SELECT event_type, count(*) AS seeds, round(avg(m), 6) AS mean_value, round(stddev_pop(m), 6) AS mean_value_std FROM (SELECT event_type, user_id % 5 AS seed, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1",
)
def h31(spark, sf):
    e = table(spark, sf, "events", "event_type", "user_id", "value")
    per_seed = e.groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("mean_value"))
    spread = met.mean_and_spread(per_seed, ["event_type"], ["mean_value"])
    return spread.withColumns({c: F.round(c, 6) for c in ("mean_value", "mean_value_std")})


@query(
    "h32_latency_percentiles",
    "SELECT event_type, f.f AS fraction, round(CASE WHEN f.f = 0.5 THEN p5 ELSE p95 END, 6) AS percentile FROM (SELECT event_type, quantile_cont(value, 0.5) AS p5, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1), (VALUES (CAST(0.5 AS DOUBLE)), (0.95)) f(f)",
)
def h32(spark, sf):
    e = table(spark, sf, "events", "event_type", "value")
    return exact_percentiles(e, ["event_type"], "value", [0.5, 0.95]).withColumn("percentile", F.round("percentile", 6))


@query(
    "h33_cost_rollup",
    "SELECT event_type, count(*) AS generations, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS seconds, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, round(avg(CAST(value > 10 AS INT)), 6) AS valid_fraction FROM events GROUP BY 1",
)
def h33(spark, sf):
    e = table(spark, sf, "events", "event_type", "value", "props")
    rows = e.select(
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("seconds"),
        F.from_json("props", "k bigint")["k"].alias("tokens"),
        (F.col("value") > 10).alias("valid"),
    )
    return met.cost_rollup(rows, ["event_type"]).withColumn("valid_fraction", F.round("valid_fraction", 6))


@query(
    "h35_model_selection",
    "SELECT event_type, arg_min(k, {'a': -em, 'b': mae, 'c': k}) AS chosen FROM (SELECT event_type, CAST(user_id % 7 AS VARCHAR) AS k, round(avg(value), 6) AS em, count(*) AS mae FROM events GROUP BY 1, 2) GROUP BY 1",
)
def h35(spark, sf):
    e = table(spark, sf, "events", "event_type", "user_id", "value")
    trials = e.groupBy("event_type", (F.col("user_id") % 7).cast("string").alias("k")).agg(F.round(F.avg("value"), 6).alias("em"), F.count("*").alias("mae"))
    return choose_per_group(trials, ["event_type"], "k", [-F.col("em"), F.col("mae"), F.col("k")])


@query(
    "h37_endpoint_slope",
    "SELECT o_orderstatus, round((arg_max(v, n) - arg_min(v, n)) / ((max(n) - min(n)) / 1000.0), 3) AS slope FROM (SELECT o_orderstatus, CAST(substr(o_orderpriority, 1, 1) AS INT) * 1000 AS n, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY 1",
)
def h37_slope(spark, sf):
    o = table(spark, sf, "orders", "o_orderstatus", "o_orderpriority", "o_totalprice")
    points = o.groupBy("o_orderstatus", (F.substring("o_orderpriority", 1, 1).cast("int") * 1000).alias("n")).agg(F.avg("o_totalprice").alias("v"))
    return met.endpoint_slope(points, ["o_orderstatus"], "n", "v").withColumn("slope", F.round("slope", 3))


@query(
    "h38_rating_histogram",
    with_sql(bk.ITEMS, bk.FEATURES, f"r AS (SELECT {RATED} THEN CAST(substr(trim(rating_text), 1, 1) AS BIGINT) ELSE 3 END AS score, {RATED} THEN 1 ELSE 0 END AS valid FROM feats)", "SELECT score, count(*) AS ratings, CAST(sum(valid) AS BIGINT) AS valid FROM r GROUP BY 1"),
)
def h38(spark, sf):
    ratings = bk.features(spark, sf).select(F.inline(F.array(tx.parse_rating(F.col("rating_text")))))
    return ratings.groupBy("score").agg(F.count("*").alias("ratings"), F.count_if("valid").alias("valid"))
