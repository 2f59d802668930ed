"""Orders seen as a knowledge log: each order of a customer supersedes that customer's previous one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkeep.operators.ordered import previous_in_group
from ledgerkeep.sources.tables import table

VERSION = "hash-test-v1:256"
SEQ_BASE = 10**14  # day * base + key keeps log order in one number without a global sort


def log(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    rows = o.withColumn("seq", day * SEQ_BASE + F.col("o_orderkey"))
    linked = previous_in_group(rows, ["o_custkey"], [F.col("seq")], F.col("o_orderkey"), "prev")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    return linked.select(
        "seq",
        F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("memory_id"),
        F.concat(F.lit("Currently, customer "), F.col("o_custkey").cast("string"), F.lit(" owes "), cents, F.lit(".")).alias("content"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        (F.substring("o_orderpriority", 1, 1).cast("int") / 5).alias("importance"),
        F.col("o_orderstatus").alias("source"),
        F.lit(VERSION).alias("embedding_version"),
        F.concat(F.lit("m"), F.col("prev").cast("string")).alias("supersedes"),
        F.create_map(F.lit("priority"), "o_orderpriority", F.lit("customer"), F.col("o_custkey").cast("string")).alias("metadata"),
        F.col("o_custkey").alias("subject"),
        F.col("o_orderpriority").alias("relation"),
        day.alias("event_order"),
        F.col("o_orderkey").alias("key"),
    )


LOG = f"""
mem AS (
  SELECT day*{SEQ_BASE} + o_orderkey AS seq, 'm'||o_orderkey AS memory_id,
    'Currently, customer '||o_custkey||' owes '||CAST(round(o_totalprice*100) AS BIGINT)||'.' AS content,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp, CAST(substr(o_orderpriority,1,1) AS INT)/5.0 AS importance,
    o_orderstatus AS source, '{VERSION}' AS embedding_version,
    'm'||lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY day*{SEQ_BASE} + o_orderkey) AS supersedes,
    o_orderpriority AS priority, o_custkey AS subject, o_orderpriority AS relation, day AS event_order, o_orderkey AS key
  FROM (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders))
"""


def damaged(spark: SparkSession, sf: str) -> DataFrame:
    """The log with urgent orders pointing at the next key and low-priority ones re-using an older id."""
    rows = log(spark, sf)
    urgent, low = F.col("relation") == "1-URGENT", F.col("relation") == "5-LOW"
    return rows.withColumn(
        "supersedes", F.when(urgent, F.concat(F.lit("m"), (F.col("key") + 1).cast("string"))).otherwise(F.col("supersedes"))
    ).withColumn("memory_id", F.when(low, F.concat(F.lit("m"), (F.floor(F.col("key") / 2)).cast("string"))).otherwise(F.col("memory_id")))


DAMAGED = """
bad AS (SELECT seq, CASE WHEN relation = '5-LOW' THEN 'm'||(key // 2) ELSE memory_id END AS memory_id,
  CASE WHEN relation = '1-URGENT' THEN 'm'||(key + 1) ELSE supersedes END AS supersedes FROM mem)
"""
