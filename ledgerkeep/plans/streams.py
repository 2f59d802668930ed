"""Queries that run a stream to its end over files derived from the tables, and the model hooks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerkeep.operators import models
from ledgerkeep.plans import knowledge as kn
from ledgerkeep.plans import orderlog as ol
from ledgerkeep.plans import query
from ledgerkeep.plans.answers import ANSWER_CTES, answered
from ledgerkeep.plans.search import bag_sql
from ledgerkeep.plans.sqltext import with_sql
from ledgerkeep.session import cut, staging_path
from ledgerkeep.sources.tables import spread, table
from ledgerkeep.streaming import log_stream as ls


@query("n1_stream_ingest", with_sql(ol.LOG, "SELECT seq, memory_id, supersedes FROM mem WHERE source <> 'P'"))
def n1(spark, sf):
    lines = kn.event_text(ol.log(spark, sf)).withColumn(
        "line", F.when(F.contains("line", F.lit('"source":"P"')), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    )
    source, out = staging_path(spark, "lines"), staging_path(spark, "ingest")
    lines.repartition(4).write.json(source)
    ls.run_to_end(ls.ingest(ls.read_log_stream(spark, source, 2), f"{out}/accepted", f"{out}/rejected"), f"{out}/state")
    return spark.read.parquet(f"{out}/accepted").select("seq", "memory_id", "supersedes")


OUTCOMES = """ranked AS (SELECT *, first_value(payload) OVER (PARTITION BY memory_id ORDER BY seq) AS p0 FROM writes),
outcomes AS (SELECT memory_id, payload, count(*) AS n, CAST(payload = any_value(p0) AS BIGINT) AS first FROM ranked GROUP BY 1, 2)"""


@query(
    "n2_stream_writes",
    with_sql(ol.LOG, kn.WRITES, OUTCOMES, "SELECT memory_id, CAST(sum(first) AS BIGINT) AS accepted, CAST(sum(CASE WHEN first = 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS retries, CAST(sum(CASE WHEN first = 0 THEN n ELSE 0 END) AS BIGINT) AS conflicts FROM outcomes GROUP BY 1"),
)
def n2(spark, sf):
    """Writes arrive in log order, a slice of the log per micro-batch, with a restart in between."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ls.ROCKSDB)
    source, out = staging_path(spark, "writes"), staging_path(spark, "outcomes")
    for part in slices_by_seq(kn.writes(spark, sf), 2):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema("seq bigint, memory_id string, payload string").parquet(source)
        ls.run_to_end(ls.idempotent_writes(stream).writeStream.format("parquet").option("path", out).outputMode("append"), f"{out}-state")
    return spark.read.parquet(out).groupBy("memory_id").agg(
        F.sum("accepted").alias("accepted"), F.sum("retries").alias("retries"), F.sum("conflicts").alias("conflicts")
    )


def slices_by_seq(rows, parts: int) -> list:
    """The rows in ``parts`` ranges of seq, as files of a stream would bring them."""
    rows = cut(rows)
    ends = rows.select(F.percentile_approx("seq", [i / parts for i in range(1, parts)])).first()[0] or []
    number = F.aggregate(F.array(*[F.lit(e) for e in ends]), F.lit(0), lambda n, e: n + (F.col("seq") > e).cast("int")) if ends else F.lit(0)
    return [rows.where(number == i) for i in range(parts)]


def _rule_changes(spark, rows, order: tuple[int, ...]) -> str:
    """Run the rules over slices of a log that arrive in ``order``, restarting the stream at every slice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ls.ROCKSDB)
    source, out = staging_path(spark, "records"), staging_path(spark, "changes")
    rows = rows.select("seq", "memory_id", "supersedes")
    parts = slices_by_seq(rows, len(order))
    for i in order:
        parts[i].write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        ls.run_to_end(ls.rule_changes(stream).writeStream.format("parquet").option("path", out).outputMode("append"), f"{out}-state")
    return out


@query(
    "n3_stream_violations",
    with_sql(ol.LOG, ol.DAMAGED, "firsts AS (SELECT memory_id, min(seq) AS f FROM bad GROUP BY 1)", "takes AS (SELECT supersedes, min(seq) AS f FROM bad WHERE supersedes IS NOT NULL GROUP BY 1)",
      """SELECT seq, b.memory_id, 'duplicate_id' AS reason FROM bad b JOIN firsts f ON f.memory_id = b.memory_id WHERE seq > f
      UNION ALL SELECT seq, b.memory_id, 'unknown_or_later_target' FROM bad b LEFT JOIN firsts f ON f.memory_id = b.supersedes WHERE supersedes IS NOT NULL AND (f IS NULL OR f >= seq)
      UNION ALL SELECT seq, b.memory_id, 'already_replaced' FROM bad b JOIN takes t ON t.supersedes = b.supersedes WHERE seq > f"""),
)
def n3_violations(spark, sf):
    """A damaged log whose slices arrive out of order: corrections leave what a replay of the whole log finds."""
    return ls.read_violations(spark, _rule_changes(spark, ol.damaged(spark, sf), (1, 0, 2)))


@query(
    "n3_stream_late_view",
    with_sql(ol.LOG, ol.DAMAGED, "SELECT seq, memory_id FROM bad b WHERE NOT EXISTS (SELECT 1 FROM bad n WHERE n.supersedes = b.memory_id)"),
)
def n3_late(spark, sf):
    """The active view of the same log, its slices arriving out of order."""
    rows = ol.damaged(spark, sf)
    return rows.select("seq", "memory_id").join(ls.read_replaced(spark, _rule_changes(spark, rows, (1, 0))), "memory_id", "left_anti")


@query("n3_stream_active_view", with_sql(ol.LOG, "SELECT seq, memory_id FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem n WHERE n.supersedes = m.memory_id)"))
def n3(spark, sf):
    source, out = staging_path(spark, "records"), staging_path(spark, "view")
    rows = ol.log(spark, sf).select("seq", "memory_id", "content", "supersedes")
    rows.repartitionByRange(4, "seq").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    ls.run_to_end(ls.active_view_sink(stream, out), f"{out}/state")
    return ls.read_active_view(spark, out).select("seq", "memory_id")


@query(
    "n4_stream_scores",
    with_sql(*ANSWER_CTES, "SELECT condition AS run, count(*) AS answers, CAST(sum(memory_tokens) AS BIGINT) AS seconds, sum(memory_tokens) >= 5000 AS ceiling_reached FROM an GROUP BY 1"),
)
def n4(spark, sf):
    """Running totals per run after the whole stream was read."""
    source, name = staging_path(spark, "answers"), "run_cost_" + staging_path(spark, "x").rsplit("-", 1)[1]
    rows = answered(spark, sf).select(F.col("condition").alias("run"), "generated_answer", "gold_answer", F.col("memory_tokens").alias("seconds"))
    rows.repartition(4).write.parquet(source)
    stream = ls.score_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source))
    totals = ls.running_cost(stream, 5000)
    ls.run_to_end(totals.writeStream.format("memory").queryName(name).outputMode("complete"), f"{source}-state")
    return spark.table(name)


def letter_counts(texts: pd.Series) -> np.ndarray:
    """A stand-in for a user's embedder: how often four letters occur."""
    return np.stack([texts.str.count(c).to_numpy() for c in "aeio"], axis=1).astype(float)


@query(
    "o1_embed_missing",
    with_sql("v AS (SELECT doc_id, [len(text) - len(replace(text, c, '')) for c in ['a', 'e', 'i', 'o']] AS vec FROM documents)", "SELECT doc_id AS memory_id, array_to_string(vec, ',') AS vector FROM v"),
)
def o1(spark, sf):
    docs = spread(table(spark, sf, "documents", "doc_id", "text")).select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    stored = spark.createDataFrame([], "memory_id bigint, embedding_version string, vector array<double>")
    vectors = models.embed_missing(docs, stored, "letters", 4, letter_counts)
    return vectors.select("memory_id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query(
    "o1_hash_embedder",
    with_sql(bag_sql("b", "conversations", "conv_id * 1000 + turn"), "SELECT k AS memory_id, bucket, round(w, 9) AS weight FROM b"),
)
def o1_hash(spark, sf):
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.col("text").alias("content"))
    stored = spark.createDataFrame([], "memory_id bigint, embedding_version string, vector array<double>")
    vectors = models.embed_missing(rows, stored, models.HASH_VERSION, 256)
    return vectors.select("memory_id", F.posexplode("vector").alias("bucket", "weight")).where("weight > 0").withColumn("weight", F.round("weight", 9))


@query(
    "o2_answer_pending",
    with_sql(ol.LOG, "SELECT memory_id, '[TEST ONLY] '||content||' ['||memory_id||']' AS generated_answer FROM mem"),
)
def o2(spark, sf):
    pending = ol.log(spark, sf).select("memory_id", F.array(F.struct("memory_id", "content")).alias("context"))
    return models.answer_pending(pending).select("memory_id", "generated_answer")


def count_words(texts: pd.Series) -> pd.Series:
    return texts.str.split().str.len()


@query("o3_token_costs", "SELECT item_id AS memory_id, CAST(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS BIGINT) AS cost FROM benchmark")
def o3(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("memory_id"), F.col("text").alias("content"))
    return models.with_cost(rows, count_words).select("memory_id", "cost")
