"""Queries on the knowledge log: sources, sinks, state, audits."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ledgerkeep.functions import text as tx
from ledgerkeep.operators import checks
from ledgerkeep.operators import memory as mem
from ledgerkeep.operators import selection as sel
from ledgerkeep.operators.handoff import frequency_mismatches
from ledgerkeep.operators.live import log_violations
from ledgerkeep.plans import baskets as bk
from ledgerkeep.plans import orderlog as ol
from ledgerkeep.plans import query
from ledgerkeep.plans.sqltext import with_sql
from ledgerkeep.schemas import MEMORY
from ledgerkeep.session import cut, staging_path
from ledgerkeep.sources import artifacts, logs
from ledgerkeep.sources.snapshots import flatten_snapshots
from ledgerkeep.sources.tables import table

# --- sources and sinks ------------------------------------------------------------------------------------

RECORD = [f.name for f in MEMORY.fields]


def event_text(rows):
    event = F.struct(
        F.lit(1).alias("schema_version"), F.lit("memory_written").alias("type"), F.struct(*RECORD).alias("memory")
    )
    return rows.select("seq", F.to_json(event).alias("line"))


def staged_log(spark, sf, damage=False):
    """The log as JSON text with its sequence number, written once and read back with an explicit schema."""
    rows = event_text(ol.log(spark, sf).withColumn("pending", F.col("source") == "P") if damage else ol.log(spark, sf))
    if damage:
        rows = rows.withColumn(
            "line", F.when(F.contains("line", F.lit('"source":"P"')), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
        )
    path = staging_path(spark, "log")
    rows.write.option("compression", "gzip").json(path)
    return spark.read.schema("seq bigint, line string").json(path)


@query(
    "a1_event_log_scan",
    with_sql(ol.LOG, "SELECT seq, memory_id, content, timestamp, importance, source, supersedes, priority FROM mem"),
)
def a1(spark, sf):
    events = logs.require_sound(logs.parse_events(staged_log(spark, sf)))
    return events.select(
        "seq", "memory_id", "content", "timestamp", "importance", "source", "supersedes", F.col("metadata")["priority"].alias("priority")
    )


@query("a2_corrupt_lines", with_sql(ol.LOG, "SELECT seq FROM mem WHERE source = 'P'"))
def a2(spark, sf):
    return logs.corrupt_lines(logs.parse_events(staged_log(spark, sf, damage=True)))


@query("a3_torn_tail", "SELECT count(*) AS lines, TRUE AS one_tail_per_file FROM customer")
def a3(spark, sf):
    """Log files that end without a newline: the closing brace serves as the record separator when writing."""
    c = table(spark, sf, "customer", "c_custkey")
    path = staging_path(spark, "torn")
    c.select(F.concat(F.lit('\n{"key":'), F.col("c_custkey").cast("string"))).write.option("lineSep", "}").text(path)
    lines = logs.read_lines(spark, path)
    torn = F.col("line").isNotNull() & ~F.col("terminated")
    return lines.agg(
        F.count_if(F.col("line") != "").alias("lines"),
        (F.count_if(torn) == F.count_distinct("file")).alias("one_tail_per_file"),
    )


@query(
    "a4_strict_jsonl",
    with_sql(ol.LOG, "SELECT source, count(*) AS lines, count(*) FILTER (WHERE source <> 'O') AS bad FROM mem GROUP BY 1"),
)
def a4(spark, sf):
    """Open orders are objects, finished ones blank lines, pending ones bare arrays."""
    line = (
        F.when(F.col("source") == "O", F.to_json(F.struct("memory_id", "source")))
        .when(F.col("source") == "P", F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("]")))
        .otherwise(F.lit("  "))
    )
    lines = ol.log(spark, sf).select("source", line.alias("line"))
    bad = logs.strict_line_violations(lines).groupBy("source").agg(F.count("*").alias("bad"))
    return lines.groupBy("source").agg(F.count("*").alias("lines")).join(bad, "source", "left").select(
        "source", "lines", F.coalesce("bad", F.lit(0)).alias("bad")
    )


@query(
    "a5_json_documents",
    "SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS customers, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building FROM customer GROUP BY 1",
)
def a5(spark, sf):
    """One multi-line JSON document per nation, written and read back whole."""
    c = table(spark, sf, "customer", "c_nationkey", "c_mktsegment")
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("b"))
    text = F.concat_ws(
        "\n",
        F.lit("{"),
        F.concat(F.lit('  "nation": '), F.col("c_nationkey").cast("string"), F.lit(",")),
        F.concat(F.lit('  "customers": '), F.col("n").cast("string"), F.lit(",")),
        F.concat(F.lit('  "building": '), F.col("b").cast("string")),
        F.lit("}"),
    )
    path = staging_path(spark, "documents")
    counts.select("c_nationkey", text.alias("value")).write.partitionBy("c_nationkey").text(path)
    return logs.read_documents(spark, path + "/*", "nation bigint, customers bigint, building bigint")


@query("a6_json_sink", with_sql(ol.LOG, "SELECT seq, memory_id, importance FROM mem"))
def a6(spark, sf):
    path = staging_path(spark, "jsonl")
    artifacts.write_json_lines(ol.log(spark, sf).select("seq", "memory_id", "importance"), path, ["seq"])
    return logs.read_strict_json(spark, path, "seq bigint, memory_id string, importance double")


@query("a7_csv_sink", with_sql(ol.LOG, "SELECT seq, memory_id, content FROM mem"))
def a7(spark, sf):
    path = staging_path(spark, "csv")
    artifacts.write_csv(ol.log(spark, sf).select("seq", "memory_id", "content"), path, ["seq"])
    return spark.read.schema("seq bigint, memory_id string, content string").option("header", True).option("mode", "FAILFAST").csv(path)


def nested_snapshots(spark, sf):
    """Snapshots as the nested rows they are exchanged in; an order's lines are few by construction."""
    rows = bk.staged_items(spark, sf)
    text = F.concat(F.col("flag"), F.lit(" line of "), F.col("net").cast("string"))
    memories = rows.groupBy("snapshot_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "memory_id",
                    F.concat_ws("-", "snapshot_id", "memory_id").alias("canonical_id"),
                    F.col("flag").alias("leakage_group"),
                    text.alias("content"),
                    "event_order",
                )
            )
        ).alias("memories"),
        F.array_sort(
            F.collect_list(
                F.when(F.col("copies") > 1, F.struct(
                    F.concat(F.lit("h"), F.col("memory_id").cast("string")).alias("query_id"), text.alias("text"), "event_order"
                ))
            )
        ).alias("history_queries"),
    )
    future = bk.queries(rows).groupBy("snapshot_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "query_id",
                    F.concat(F.lit("which lines have "), F.col("query_id")).alias("text"),
                    bk.ids_text("ids").alias("gold_answer"),
                    F.col("supports").alias("supporting_memory_sets"),
                )
            )
        ).alias("future_queries")
    )
    snaps = bk.snapshots(spark, sf, rows).select("snapshot_id", "trajectory_id", "split", "scenario", F.col("decision").alias("event_order"))
    return snaps.join(memories, "snapshot_id").join(future, "snapshot_id")


@query(
    "a8_flatten_snapshots",
    with_sql(bk.ITEMS, bk.SNAPSHOTS, bk.QUERIES, """SELECT 'snapshots' AS part, count(*) AS n FROM snaps UNION ALL SELECT 'memories', count(*) FROM items
      UNION ALL SELECT 'history_queries', count(*) FROM items WHERE copies > 1 UNION ALL SELECT 'future_queries', count(*) FROM asks"""),
)
def a8(spark, sf):
    tables = flatten_snapshots(cut(nested_snapshots(spark, sf)))
    parts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("a9_artifact_manifest", "SELECT 'same' AS state, TRUE AS all_files")
def a9(spark, sf):
    path = staging_path(spark, "report")
    counts = table(spark, sf, "orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority", "o_orderstatus").count()
    artifacts.write_json_lines(counts, path, ["o_orderpriority", "o_orderstatus"])
    saved = cut(artifacts.manifest(spark, path))
    states = artifacts.verify_manifest(saved, artifacts.manifest(spark, path))
    return states.groupBy("state").agg((F.count("*") > 0).alias("all_files"))


@query(
    "a10_table_scan",
    "SELECT l_returnflag, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1",
)
def a10(spark, sf):
    li = table(spark, sf, "lineitem", "l_returnflag", "l_quantity", "l_shipdate")
    recent = li.where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp"))
    return recent.groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


# --- state ------------------------------------------------------------------------------------------------


@query(
    "c1_content_ids",
    with_sql(ol.LOG, """SELECT seq, 'mem_' || substr(sha256('{"content": ' || to_json(content) || ', "importance": ' || importance || ', "metadata": {"customer": "' || subject || '", "priority": "' || priority
       || '"}, "source": "' || source || '", "supersedes": ' || coalesce('"' || supersedes || '"', 'null') || '}'), 1, 32) AS memory_id FROM mem"""),
)
def c1(spark, sf):
    return mem.with_content_id(ol.log(spark, sf)).select("seq", "memory_id")


WRITES = """writes AS (SELECT seq, memory_id, content AS payload FROM mem
  UNION ALL SELECT seq + 9000000000000000000 // 2, CASE WHEN source = 'O' THEN 'n'||memory_id ELSE memory_id END, CASE WHEN source = 'P' THEN content||' amended' ELSE content END FROM mem)"""


def writes(spark, sf):
    rows = ol.log(spark, sf)
    again = rows.select(
        (F.col("seq") + 9000000000000000000 // 2).alias("seq"),
        F.when(F.col("source") == "O", F.concat(F.lit("n"), "memory_id")).otherwise(F.col("memory_id")).alias("memory_id"),
        F.when(F.col("source") == "P", F.concat("content", F.lit(" amended"))).otherwise(F.col("content")).alias("payload"),
    )
    return rows.select("seq", "memory_id", F.col("content").alias("payload")).unionByName(again)


@query(
    "c2_idempotent_writes",
    with_sql(ol.LOG, WRITES, """ranked AS (SELECT *, first_value(payload) OVER (PARTITION BY memory_id ORDER BY seq) AS p0 FROM writes)""",
      """SELECT memory_id, sha256(payload) AS payload_hash, min(seq) AS first_seq, CAST(payload = any_value(p0) AS BIGINT) AS accepted, CASE WHEN payload = any_value(p0) THEN count(*) - 1 ELSE 0 END AS retries,
      CASE WHEN payload = any_value(p0) THEN 0 ELSE count(*) END AS conflicts FROM ranked GROUP BY memory_id, payload"""),
)
def c2(spark, sf):
    return mem.classify_writes(writes(spark, sf))


VIOLATIONS = """firsts AS (SELECT memory_id, min(seq) AS s FROM bad GROUP BY 1), takes AS (SELECT supersedes, min(seq) AS s FROM bad WHERE supersedes IS NOT NULL GROUP BY 1),
viol AS (SELECT b.seq, b.memory_id, 'duplicate_id' AS reason FROM bad b JOIN firsts f USING (memory_id) WHERE b.seq > f.s
  UNION ALL SELECT b.seq, b.memory_id, 'unknown_or_later_target' FROM bad b WHERE b.supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad t WHERE t.memory_id = b.supersedes AND t.seq < b.seq)
  UNION ALL SELECT b.seq, b.memory_id, 'already_replaced' FROM bad b JOIN takes t ON t.supersedes = b.supersedes WHERE b.seq > t.s)"""


def staged_damaged(spark, sf):
    return cut(ol.damaged(spark, sf).select("seq", "memory_id", "supersedes"))


@query("c3_replay_violations", with_sql(ol.LOG, ol.DAMAGED, VIOLATIONS, "SELECT * FROM viol"))
def c3(spark, sf):
    return mem.replay_violations(staged_damaged(spark, sf))


@query("c3_first_violation", with_sql(ol.LOG, ol.DAMAGED, VIOLATIONS, "SELECT min(seq) AS seq FROM viol"))
def c3_first(spark, sf):
    return mem.first_violation(mem.replay_violations(staged_damaged(spark, sf)))


@query(
    "a2_log_violations",
    with_sql(ol.LOG, ol.DAMAGED, VIOLATIONS, """SELECT seq, reason FROM viol UNION ALL SELECT seq, 'blank_content' FROM mem WHERE key % 7 = 0
      UNION ALL SELECT seq, 'importance' FROM mem WHERE relation = '3-MEDIUM' UNION ALL SELECT seq, 'supersedes_itself' FROM bad WHERE supersedes = memory_id"""),
)
def a2_rules(spark, sf):
    """A log with broken record rules, used ids and wrong targets, by line."""
    rows = ol.damaged(spark, sf)
    rows = rows.withColumn("content", F.when(F.col("key") % 7 == 0, " ").otherwise(F.col("content")))
    rows = rows.withColumn("importance", F.when(F.col("relation") == "3-MEDIUM", 7.0).otherwise(F.col("importance")))
    return log_violations(cut(logs.parse_events(event_text(rows))))


@query(
    "c4_active_view",
    with_sql(ol.LOG, "SELECT seq, memory_id, content FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem n WHERE n.supersedes = m.memory_id)"),
)
def c4(spark, sf):
    return mem.active_view(ol.log(spark, sf)).select("seq", "memory_id", "content")


@query(
    "c5_history_view",
    with_sql(ol.LOG, "SELECT seq, memory_id, EXISTS (SELECT 1 FROM mem n WHERE n.supersedes = m.memory_id) AS superseded FROM mem m"),
)
def c5(spark, sf):
    return mem.history_view(ol.log(spark, sf)).select("seq", "memory_id", "superseded")


@query("c6_point_lookup", with_sql(ol.LOG, "SELECT seq, memory_id, content FROM mem WHERE memory_id = 'm77'"))
def c6(spark, sf):
    return mem.lookup(ol.log(spark, sf), "m77").select("seq", "memory_id", "content")


@query(
    "c7_write_admission",
    with_sql(ol.LOG, ol.DAMAGED, """active AS (SELECT memory_id FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem n WHERE n.supersedes = m.memory_id))""",
      "SELECT seq, memory_id, supersedes IS NULL OR supersedes IN (SELECT memory_id FROM active) AS admitted FROM bad"),
)
def c7(spark, sf):
    return mem.admissible(ol.damaged(spark, sf), ol.log(spark, sf)).select("seq", "memory_id", "admitted")


ADMISSION = (
    ol.DAMAGED.replace("bad AS (", "bad AS MATERIALIZED ("),
    """waits AS (SELECT r, d, role, count(*) OVER (PARTITION BY r) AS n FROM (
      SELECT b.seq AS r, d.seq AS d, 'rival' AS role FROM bad b JOIN bad d ON d.memory_id = b.memory_id AND d.seq < b.seq
      UNION ALL SELECT b.seq, d.seq, 'rival' FROM bad b JOIN bad d ON d.supersedes = b.supersedes AND d.seq < b.seq
      UNION ALL SELECT b.seq, d.seq, 'target' FROM bad b JOIN bad d ON d.memory_id = b.supersedes AND d.seq < b.seq))""",
    """judged(seq, ok) USING KEY (seq) AS (
      SELECT seq, supersedes IS NULL FROM bad WHERE seq NOT IN (SELECT r FROM waits)
      UNION
      SELECT w.r, NOT bool_or(w.role = 'rival' AND j.ok) AND (any_value(b.supersedes) IS NULL OR bool_or(w.role = 'target' AND j.ok))
      FROM waits w JOIN recurring.judged j ON j.seq = w.d JOIN bad b ON b.seq = w.r
      WHERE w.r NOT IN (SELECT seq FROM recurring.judged) GROUP BY w.r HAVING count(*) = any_value(w.n))""",
)


@query("c7_batch_admission", with_sql(ol.LOG, *ADMISSION, "SELECT b.seq, memory_id, supersedes, ok AS admitted FROM bad b JOIN judged USING (seq)"))
def c7_batch(spark, sf):
    """Row by row this is a sequential rule; the SQL judges a row once all earlier rows of its id and target are judged."""
    return mem.admit_batch(ol.damaged(spark, sf))


@query(
    "c8_missing_vectors",
    "SELECT doc_id AS memory_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND label <> 3)",
)
def c8(spark, sf):
    docs = table(spark, sf, "documents", "doc_id").withColumnRenamed("doc_id", "memory_id")
    version = F.when(F.col("label") == 3, "old").otherwise("v1")
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("memory_id"), version.alias("embedding_version"), F.col("embedding").alias("vector")
    )
    return mem.missing_vectors(docs, vectors, "v1", 64)


@query(
    "c9_stale_vectors",
    "SELECT doc_id AS memory_id FROM documents WHERE (lang = 'de' AND upper(text) <> text) OR lang = 'es'",
)
def c9(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    old = docs.select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    text = F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))
    new = docs.where(F.col("lang") != "es").select(F.col("doc_id").alias("memory_id"), text.alias("content"))
    return mem.stale_vectors(old, new)


CONSOLIDATE = """latest AS (SELECT *, row_number() OVER (PARTITION BY subject, relation ORDER BY event_order DESC, memory_id DESC) AS rn, count(*) OVER (PARTITION BY subject, relation) AS source_count FROM mem)"""


def _records(spark, sf):
    return ol.log(spark, sf).withColumn("canonical_id", F.col("memory_id"))


@query(
    "c10_consolidate",
    with_sql(ol.LOG, CONSOLIDATE, "SELECT subject, relation, 'merged-'||memory_id AS memory_id, memory_id AS canonical_id, replace(content, 'Currently, ', '') AS content, source_count FROM latest WHERE rn = 1"),
)
def c10(spark, sf):
    return mem.consolidate(_records(spark, sf))


@query(
    "c10_provenance",
    with_sql(ol.LOG, CONSOLIDATE, "SELECT 'merged-'||l.memory_id AS memory_id, m.memory_id AS source_id FROM latest l JOIN mem m USING (subject, relation) WHERE l.rn = 1"),
)
def c10_provenance(spark, sf):
    records = cut(_records(spark, sf))
    return mem.provenance(records, mem.consolidate(records))


@query(
    "c11_consolidate_keep_cue",
    with_sql(ol.LOG, CONSOLIDATE, "SELECT subject, relation, 'merged-'||memory_id AS memory_id, memory_id AS canonical_id, content, source_count FROM latest WHERE rn = 1"),
)
def c11(spark, sf):
    return mem.consolidate(_records(spark, sf), keep_cue=True)


CUT = "CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text"


@query(
    "c13_capture_last_turn",
    f"SELECT c.conv_id, turn, role, {CUT} FROM conversations c JOIN (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1) l USING (conv_id) WHERE turn >= t AND role IN ('user', 'assistant')",
)
def c13_last(spark, sf):
    return mem.capture(table(spark, sf, "conversations"), "last_turn", 200)


@query("c13_capture_user_only", f"SELECT conv_id, turn, role, {CUT} FROM conversations WHERE role = 'user'")
def c13_user(spark, sf):
    return mem.capture(table(spark, sf, "conversations"), "full_session", 200, include_assistant=False)


CASES = """pairs AS (SELECT n.seq AS case_id, n.relation, n.memory_id, n.content, n.event_order, o.memory_id AS old_id, o.content AS old_content FROM mem n JOIN mem o ON o.memory_id = n.supersedes),
distract AS (SELECT relation, arg_min(memory_id, {'e': event_order, 'm': memory_id}) AS memory_id, arg_min(content, {'e': event_order, 'm': memory_id}) AS content FROM mem WHERE source = 'P' GROUP BY 1),
shown AS (
  SELECT case_id, 'no_memory' AS condition, '' AS ids, '' AS contents FROM pairs
  UNION ALL SELECT case_id, 'relevant', memory_id, content FROM pairs
  UNION ALL SELECT case_id, 'irrelevant', d.memory_id, d.content FROM pairs JOIN distract d USING (relation)
  UNION ALL SELECT case_id, 'conflicting', CASE WHEN event_order % 2 = 1 THEN old_id||','||memory_id ELSE memory_id||','||old_id END,
     CASE WHEN event_order % 2 = 1 THEN old_content||','||content ELSE content||','||old_content END FROM pairs
  UNION ALL SELECT case_id, 'consolidation_keep_temporal_cue', 'merged-'||memory_id, content FROM pairs
  UNION ALL SELECT case_id, 'consolidation_strip_temporal_cue', 'merged-'||memory_id, replace(content, 'Currently, ', '') FROM pairs)"""


def cases(spark, sf):
    """A case is a superseding record with the one it replaced. The log is read three times, so it is written once."""
    rows = cut(ol.log(spark, sf).select("seq", "memory_id", "content", "event_order", "supersedes", "relation", "source"))
    struct = F.struct("memory_id", "content", "event_order")
    new = rows.where(F.col("supersedes").isNotNull()).select(
        F.col("seq").alias("case_id"), "relation", "supersedes", struct.alias("current"), (F.col("event_order") % 2 == 1).alias("swap")
    )
    old = rows.select(F.col("memory_id").alias("supersedes"), struct.alias("old"))
    distractors = rows.where(F.col("source") == "P").select("relation", "memory_id", "content", "event_order")
    return mem.assemble_conditions(new.join(old, "supersedes"), distractors)


def shown(spark, sf):
    rows = mem.explode_conditions(cases(spark, sf))
    return rows.select(
        "case_id",
        "condition",
        F.array_join(F.transform("memories", lambda m: m.memory_id), ",").alias("ids"),
        F.array_join(F.transform("memories", lambda m: m.content), ",").alias("contents"),
    )


@query("c14_condition_assembly", with_sql(ol.LOG, CASES, "SELECT case_id, condition, ids, contents FROM shown"))
def c14(spark, sf):
    return shown(spark, sf)


@query("a11_explode_conditions", with_sql(ol.LOG, CASES, "SELECT condition, count(*) AS cases, CAST(sum(CASE WHEN ids = '' THEN 0 ELSE len(string_split(ids, ',')) END) AS BIGINT) AS memories FROM shown GROUP BY 1"))
def a11(spark, sf):
    rows = mem.explode_conditions(cases(spark, sf))
    return rows.groupBy("condition").agg(F.count("*").alias("cases"), F.sum(F.size("memories")).alias("memories"))


@query(
    "c15_case_targets",
    with_sql(ol.LOG, "SELECT n.seq AS case_id, n.memory_id AS target_id, o.memory_id AS superseded_id, o.content AS superseded_content FROM mem n JOIN mem o ON o.memory_id = n.supersedes"),
)
def c15(spark, sf):
    return cases(spark, sf).select(
        "case_id", F.col("current.memory_id").alias("target_id"), F.col("old.memory_id").alias("superseded_id"), F.col("old.content").alias("superseded_content")
    )


# --- audits -----------------------------------------------------------------------------------------------


@query(
    "b1_record_constraints",
    """SELECT 'c'||c_custkey AS memory_id, concat_ws(',', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'blank_source' END, CASE WHEN NOT c_acctbal / 8000 BETWEEN 0 AND 1 THEN 'importance' END,
      CASE WHEN c_nationkey = 3 THEN 'timestamp' END, CASE WHEN c_nationkey = 4 THEN 'supersedes_itself' END, CASE WHEN c_nationkey = 5 THEN 'metadata' END) AS reasons FROM customer
      WHERE c_mktsegment = 'MACHINERY' OR NOT c_acctbal / 8000 BETWEEN 0 AND 1 OR c_nationkey IN (3, 4, 5)""",
)
def b1(spark, sf):
    c = table(spark, sf, "customer")
    nation = F.col("c_nationkey")
    me = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return checks.record_violations(
        c.select(
            me.alias("memory_id"),
            F.col("c_name").alias("content"),
            F.when(F.col("c_mktsegment") == "MACHINERY", " ").otherwise(F.col("c_mktsegment")).alias("source"),
            F.lit(ol.VERSION).alias("embedding_version"),
            (F.col("c_acctbal") / 8000).alias("importance"),
            F.when(nation == 3, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+00:00").alias("timestamp"),
            F.when(nation == 4, me).alias("supersedes"),
            F.when(nation == 5, '["list"]').otherwise(F.to_json(F.struct("c_nationkey"))).alias("metadata"),
        )
    )


@query(
    "b2_snapshot_constraints",
    with_sql(bk.ITEMS, bk.SNAPSHOTS, bk.QUERIES, "od AS (SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders)",
      """SELECT DISTINCT 'memory_time' AS rule, snapshot_id FROM items JOIN od ON o_orderkey = snapshot_id WHERE event_order >= day + 60
      UNION ALL SELECT DISTINCT 'history_time', snapshot_id FROM items JOIN od ON o_orderkey = snapshot_id WHERE copies > 1 AND event_order >= day + 60
      UNION ALL SELECT DISTINCT 'duplicate_query', snapshot_id FROM (SELECT snapshot_id FROM items WHERE copies > 1 GROUP BY snapshot_id HAVING count(*) > 1)
      UNION ALL SELECT DISTINCT 'support', snapshot_id FROM asks WHERE query_id = 'flag:N'
      UNION ALL SELECT 'split', snapshot_id FROM snaps WHERE scenario = '5-LOW'"""),
)
def b2(spark, sf):
    """Decision 60 days after the order date; damage: unknown split for low priority, unknown support for flag N."""
    rows = bk.items(spark, sf)
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    day = o.select(F.col("o_orderkey").alias("snapshot_id"), (F.unix_date(F.to_date("o_orderdate")).cast("long") + 60).alias("event_order"))
    snaps = bk.snapshots(spark, sf, rows).join(day, "snapshot_id").select(
        "snapshot_id", "event_order", F.when(F.col("scenario") == "5-LOW", "spare").otherwise(F.col("split")).alias("split")
    )
    history = rows.where(F.col("copies") > 1).select("snapshot_id", F.lit("h").alias("query_id"), "event_order")
    asks = bk.queries(rows)
    wrong = F.when(F.col("query_id") == "flag:N", F.array(F.array(F.lit(-1).cast("long")))).otherwise(F.col("supports"))
    late = F.lit(2**40)
    future = asks.select(
        "snapshot_id", "query_id", late.alias("event_order"), F.lit(0).alias("position"), F.col("query_id").alias("gold_answer"), wrong.alias("supports")
    )
    return checks.snapshot_violations(snaps, rows, history, future)


@query(
    "b3_cross_split_leakage",
    with_sql("d AS (SELECT doc_id, source, CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'validation' ELSE 'test' END AS split, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS k FROM documents)",
      """SELECT kind, value, count(DISTINCT split) AS splits FROM (SELECT 'source' AS kind, source AS value, split FROM d UNION ALL SELECT 'content', md5(k), split FROM d) GROUP BY 1,2 HAVING count(DISTINCT split) > 1"""),
)
def b3(spark, sf):
    from ledgerkeep.functions.text import leakage_key

    docs = table(spark, sf, "documents", "text", "lang", "source")
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "validation").otherwise("test")
    return checks.cross_split_leakage(
        docs.withColumn("split", split), {"source": F.col("source"), "content": F.md5(leakage_key(F.col("text")).cast("binary"))}
    )


@query(
    "b4_dataset_overlap",
    with_sql("""lines(src, k) AS (SELECT 'd', trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '\\s+', ' ', 'g')) FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents)
      UNION ALL SELECT 'b', trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '\\s+', ' ', 'g')) FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark))""",
      "SELECT 'content' AS kind, k AS value FROM lines WHERE src = 'd' INTERSECT SELECT 'content', k FROM lines WHERE src = 'b'"),
)
def b4(spark, sf):
    from ledgerkeep.functions.text import leakage_key

    def lines(name):
        return table(spark, sf, name, "text").select(F.explode(F.split("text", "\n")).alias("x")).select(leakage_key(F.col("x")).alias("content"))

    return checks.shared_values(lines("documents"), lines("benchmark"), ["content"])


@query(
    "b5_past_view",
    with_sql(bk.ITEMS, "SELECT snapshot_id, memory_id, event_order FROM items"),
)
def b5(spark, sf):
    past = checks.past_view(nested_snapshots(spark, sf), ["memory_id", "event_order"], ["query_id", "event_order"])
    leaks = checks.schema_leaks(
        past,
        ["snapshot_id", "trajectory_id", "event_order", "memories.memory_id", "memories.event_order", "history_queries.query_id", "history_queries.event_order"],
    )
    if leaks:
        raise ValueError(f"future fields in the past view: {leaks}")
    return past.select("snapshot_id", F.inline("memories"))


@query(
    "b6_field_coalescing",
    with_sql("l AS (SELECT doc_id, CASE WHEN quality = 1 THEN CAST(quality AS DOUBLE) END AS value, CASE WHEN toxic = 1 THEN -1.0 END AS old, 0.5 AS loo FROM labels)", "SELECT doc_id, coalesce(value, old, loo) AS target FROM l"),
)
def b6(spark, sf):
    rows = table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.col("quality")).alias("value"),
        F.struct(F.when(F.col("toxic") == 1, F.lit(-1)).alias("value")).alias("target"),
        F.lit(0.5).alias("loo_value"),
    )
    return rows.select("doc_id", checks.first_present(rows, [F.col("value"), F.col("target.value"), F.col("loo_value")], "number").alias("target"))


@query(
    "b7_alias_mapping",
    """SELECT role, turn % 5 AS spelling, CASE turn % 5 WHEN 0 THEN 'consolidation_strip_temporal_cue' WHEN 1 THEN 'consolidation_keep_temporal_cue'
      WHEN 2 THEN 'consolidation_strip_temporal_cue' WHEN 3 THEN 'retrieved:'||role||':k5' END AS condition_name, count(*) AS n FROM conversations GROUP BY ALL""",
)
def b7(spark, sf):
    """Old spellings, a retrieved condition, and a name in the wrong case, which is unknown."""
    rows = table(spark, sf, "conversations", "role", "turn").withColumn("spelling", F.col("turn") % 5)
    retrieved = F.concat(F.lit("retrieved:"), F.col("role"), F.lit(":k5"))
    old = F.element_at(F.array(F.lit("consolidated"), F.lit("merged_keep_current"), F.lit("merged_strip_current"), retrieved, F.lit("Relevant")), F.col("spelling").cast("int") + 1)
    named = checks.apply_aliases(rows.withColumn("condition", old), "condition")
    return named.groupBy("role", "spelling", "condition_name").agg(F.count("*").alias("n"))


@query(
    "b8_phase_order",
    with_sql(ol.LOG, "SELECT memory_id, seq FROM mem WHERE source <> 'P' AND seq > (SELECT min(seq) FROM mem WHERE source = 'P')"),
)
def b8(spark, sf):
    rows = ol.log(spark, sf).select("memory_id", "seq", "source")
    return checks.phase_order_violations(rows.select("memory_id", "seq"), rows.where(F.col("source") != "P"), ["memory_id"])


@query("b8_mixed_hashes", with_sql(ol.LOG, "SELECT md5(source) AS plan_hash, count(*) AS answers FROM mem WHERE source <> 'O' GROUP BY 1"))
def b8_hash(spark, sf):
    """Answers made from other plan tables than the frozen one."""
    rows = ol.log(spark, sf).select(F.md5(F.col("source").cast("binary")).alias("plan_hash"))
    return checks.mixed_hashes(rows, "plan_hash", hashlib.md5(b"O").hexdigest())


@query(
    "b12_frequency_mismatches",
    "SELECT l_orderkey AS snapshot_id, CAST(l_linenumber AS BIGINT) AS memory_id, CAST(l_quantity AS BIGINT) AS retrieval_frequency, CAST(10 AS BIGINT) AS expected_frequency FROM lineitem WHERE l_linenumber = 1 AND l_quantity <> 10",
)
def b12_frequency(spark, sf):
    """By design the first line of each order is read ten times."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    found = li.select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").cast("long").alias("memory_id"), F.col("l_quantity").cast("long").alias("retrieval_frequency"))
    expected = found.where("memory_id = 1").select("snapshot_id", "memory_id", F.lit(10).cast("long").alias("expected_frequency")).distinct()
    return frequency_mismatches(found, expected).select("snapshot_id", "memory_id", "retrieval_frequency", "expected_frequency")


@query(
    "b9_coverage_audit",
    with_sql(bk.ITEMS, """grid AS (SELECT DISTINCT l_orderkey AS snapshot_id, n AS memory_id FROM lineitem, range(1, 8) r(n))""",
      "act AS (SELECT l_orderkey AS snapshot_id, CAST(l_linenumber AS BIGINT) AS memory_id FROM lineitem WHERE l_linenumber <> 7 UNION ALL SELECT l_orderkey, 8 FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1)",
      """SELECT snapshot_id, memory_id, coalesce(copies, 0) AS copies, CASE WHEN copies IS NULL THEN 'missing' WHEN want IS NULL THEN 'unexpected' ELSE 'duplicate' END AS state
      FROM (SELECT *, TRUE AS want FROM grid) g FULL JOIN (SELECT snapshot_id, memory_id, count(*) AS copies FROM act GROUP BY 1,2) a USING (snapshot_id, memory_id) WHERE copies IS NULL OR want IS NULL OR copies > 1"""),
)
def b9(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    key = F.col("l_orderkey").alias("snapshot_id")
    grid = li.select(key).distinct().withColumn("memory_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))))
    actual = li.where("l_linenumber <> 7").select(key, F.col("l_linenumber").cast("long").alias("memory_id")).unionByName(
        li.where("l_quantity = 50 and l_linenumber = 1").select(key, F.lit(8).cast("long").alias("memory_id"))
    )
    return checks.coverage(grid, actual, ["snapshot_id", "memory_id"])


@query(
    "b10_response_integrity",
    with_sql(bk.ITEMS, bk.SNAPSHOTS, bk.QUERIES, bk.RANKINGS, "alls AS (SELECT snapshot_id, list_sort(list(memory_id)) AS ids FROM items GROUP BY 1)", "conds AS (SELECT snapshot_id, ids AS storage_ids, CAST(0 AS BIGINT) AS seed FROM alls)",
      bk.responses_sql("conds"), """SELECT snapshot_id, query_id, array_to_string(storage_ids, ',') AS storage_ids,
       concat_ws(',', CASE WHEN memory_tokens > 60 THEN 'read_budget' END, CASE WHEN query_id = 'flag:A' THEN 'score' END, CASE WHEN scenario = '1-URGENT' THEN 'runtime' END) AS reasons
       FROM resp JOIN snaps USING (snapshot_id) WHERE memory_tokens > 60 OR query_id = 'flag:A' OR scenario = '1-URGENT'"""),
)
def b10(spark, sf):
    """Audited under a tighter budget than they were made with, with damaged scores and run times."""
    rows = bk.staged_items(spark, sf)
    full = rows.groupBy("snapshot_id").agg(F.array_sort(F.collect_list("memory_id")).alias("storage_ids"))
    answers = bk.respond(spark, sf, full, rows=rows).join(bk.snapshots(spark, sf, rows).select("snapshot_id", "scenario"), "snapshot_id")
    size = F.size("ranking_ids")
    ranking = F.transform("ranking_ids", lambda m, i: F.struct(m.alias("memory_id"), (size - i).cast("double").alias("score")))
    seen = answers.select(
        "snapshot_id", "query_id", "storage_ids", F.col("storage_ids").alias("memory_ids"), ranking.alias("ranking"), "context_ids", "memory_tokens", "exact_match",
        F.when(F.col("query_id") == "flag:A", 2).otherwise(F.col("exact_match")).alias("expected_match"),
        F.when(F.col("scenario") == "1-URGENT", F.lit(float("nan"))).otherwise(F.lit(0.1)).alias("duration_seconds"),
    )
    bad = checks.response_violations(seen, bk.TOP_K, 60)
    return bad.withColumn("storage_ids", bk.ids_text("storage_ids"))


@query(
    "b10_content_rules",
    with_sql(ol.LOG, """why AS (SELECT seq, memory_id, concat_ws(',', CASE WHEN key % 13 = 4 THEN 'task' END, CASE WHEN key % 7 = 1 THEN 'context_content' END, CASE WHEN key % 13 = 4 OR key % 5 = 2 OR key % 7 = 1 THEN 'prompt' END) AS reasons FROM mem)""",
      "SELECT seq AS snapshot_id, memory_id AS query_id, reasons FROM why WHERE reasons <> ''"),
)
def b10_content(spark, sf):
    """Answers over single records, some with another question, an altered context or an altered prompt."""
    rows = ol.log(spark, sf)
    questions = rows.select(F.col("seq").alias("snapshot_id"), F.col("memory_id").alias("query_id"), F.concat(F.lit("What is known of "), "subject").alias("text"), F.col("source").alias("answer"))
    memory = F.struct(F.col("memory_id"), F.col("content"))
    told = rows.select(
        F.col("seq").alias("snapshot_id"), F.col("memory_id").alias("query_id"), "key", F.col("source").alias("gold_answer"), F.array(memory).alias("memories"),
        F.concat(F.lit("What is known of "), "subject").alias("query"), F.array(memory).alias("context"),
    )
    told = told.withColumn("prompt", tx.answer_prompt(F.col("query"), F.col("context")))
    changed = F.transform("context", lambda m: F.struct(m.memory_id.alias("memory_id"), F.concat(m.content, F.lit("!")).alias("content")))
    damaged = told.withColumns({
        "query": F.when(F.col("key") % 13 == 4, F.lit("Something else")).otherwise(F.col("query")),
        "context": F.when(F.col("key") % 7 == 1, changed).otherwise(F.col("context")),
        "prompt": F.when(F.col("key") % 5 == 2, F.concat("prompt", F.lit(" "))).otherwise(F.col("prompt")),
    })
    return checks.content_violations(damaged, questions)


@query(
    "b11_handoff_tables",
    with_sql(bk.ITEMS, bk.SNAPSHOTS, bk.FEATURES, "SELECT split, split <> 'test' AS labelled, count(*) AS n, CAST(sum(CASE WHEN split = 'test' THEN NULL ELSE net END) AS BIGINT) AS target FROM feats JOIN snaps USING (snapshot_id) GROUP BY 1, 2"),
)
def b11(spark, sf):
    from ledgerkeep.operators.handoff import handoff

    rows = bk.items(spark, sf)
    feats = bk.features(spark, sf, rows).drop("net").join(bk.snapshots(spark, sf, rows).select("snapshot_id", "split"), "snapshot_id")
    labels = rows.select("snapshot_id", "memory_id", F.col("net").alias("target"))
    parts = handoff(feats, labels)
    whole = parts["train"].unionByName(parts["validation"]).unionByName(parts["test_features"], allowMissingColumns=True)
    return whole.groupBy("split", (F.col("split") != "test").alias("labelled")).agg(
        F.count("*").alias("n"), F.sum("target").alias("target")
    )


@query(
    "b12_scenario_checks",
    with_sql(bk.ITEMS, "old AS (SELECT snapshot_id, arg_min({'m': memory_id, 'f': flag}, {'e': event_order, 'm': memory_id}) AS o FROM items GROUP BY 1)",
      "SELECT snapshot_id, o.m AS oldest_id, o.f = 'R' AS oldest_is_support FROM old"),
)
def b12(spark, sf):
    from ledgerkeep.operators.handoff import oldest_is_support

    rows = bk.items(spark, sf)
    return oldest_is_support(rows, F.col("flag") == "R")


@query(
    "b13_table_diff",
    with_sql(bk.ITEMS, """SELECT snapshot_id, memory_id, 'missing_row' AS "column", CAST(NULL AS DOUBLE) AS delta FROM items WHERE memory_id = 7
      UNION ALL SELECT snapshot_id, memory_id, 'score', CAST(1 AS DOUBLE) FROM items WHERE memory_id = 2 UNION ALL SELECT snapshot_id, memory_id, 'flag', NULL FROM items WHERE memory_id = 3 AND flag <> 'A'"""),
)
def b13(spark, sf):
    rows = bk.items(spark, sf).select("snapshot_id", "memory_id", F.col("cost").cast("double").alias("score"), "flag")
    other = rows.where("memory_id <> 7").select(
        "snapshot_id",
        "memory_id",
        F.when(F.col("memory_id") == 2, F.col("score") + 1).otherwise(F.col("score") * (1 + 1e-13)).alias("score"),
        F.when(F.col("memory_id") == 3, "A").otherwise(F.col("flag")).alias("flag"),
    )
    return checks.table_diff(other, rows, ["snapshot_id", "memory_id"])


@query(
    "b15_handoff_inputs",
    "SELECT 'o_custkey' AS kind, CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O'",
)
def b15(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    return checks.shared_owners(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey", "o_orderkey"])


@query(
    "b15_duplicate_rows",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def b15_duplicates(spark, sf):
    return checks.duplicate_keys(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(
    "g22_cost_ceiling",
    with_sql("e AS (SELECT event_id, user_id, CAST(round(value*100) AS BIGINT) AS c, sum(CAST(round(value*100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)",
      "SELECT event_id, user_id, CAST(run AS BIGINT) AS spent_after FROM e WHERE run - c < 100000"),
)
def g22(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "ts", "value").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return sel.within_cost_ceiling(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("cents"), 100000).select(
        "event_id", "user_id", "spent_after"
    )
