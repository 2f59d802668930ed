"""Queries of the training-data operators: thin callers that apply each to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkeep.llm import chat, collocations, cover_codes, decontaminate, jaccard, language, licenses, line_dedup, mixing, multi_index, quality, simhash, token_blocks
from ledgerkeep.session import staging_path
from ledgerkeep.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The id that ends a document in token files.
END_ID = 2


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def word_tokenizer() -> str:
    """The installed word-end BPE vocabulary; any other file of its kind can be passed to the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_token_blocks")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "token-blocks")
    token_blocks.write(table(spark, sf, "documents", "doc_id", "text"), path, word_tokenizer(), END_ID)
    return token_blocks.read_documents(spark, path)


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents", "doc_id", "text"), size=3, radius=3)
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "labels", "doc_id", "quality"))


#: Shares of words by language that the mix aims at.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing classifier: documents that ``labels`` covers, their language as the domain."""
    covered = labels.where("doc_id is not null").select("doc_id").distinct()
    return docs.join(covered, "doc_id", "left_semi").select("doc_id", "text", F.col("lang").alias("domain"))


@query("op7_domain_mixing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    labelled = labelled_domains(docs, table(spark, sf, "labels", "doc_id"))
    mixed = mixing.mix(docs, labelled, TARGETS, keep=["doc_id"])
    return mixed.select("doc_id", "tokens", *(F.round(f"p_{d}", 6).alias(f"p_{d}") for d in sorted(TARGETS)), F.round("rate", 6).alias("rate"), "copies")


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


#: Units as in operators: sentences of lines, A-Z lower-cased, white space collapsed, least words six.
OP2_SQL = r"""
WITH cut AS (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+')) AS piece,
           generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+'), 1) AS nth
    FROM documents),
placed AS (
    SELECT doc_id, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY nth) - length(piece) AS unit_begin, length(piece) AS size,
           trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain
    FROM cut),
ranked AS (
    SELECT doc_id, unit_begin, unit_begin + size AS unit_end, first_value(doc_id) OVER w AS kept_doc_id, first_value(unit_begin) OVER w AS kept_begin,
           row_number() OVER w AS nth
    FROM placed WHERE length(plain) - length(replace(plain, ' ', '')) + CAST(plain <> '' AS INT) >= 6
    WINDOW w AS (PARTITION BY plain ORDER BY doc_id, unit_begin))
SELECT doc_id, CAST(unit_begin AS INT) AS unit_begin, CAST(unit_end AS INT) AS unit_end, kept_doc_id, CAST(kept_begin AS INT) AS kept_begin
FROM ranked WHERE nth > 1
"""


@query("op2_line_dedup", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.repeats(table(spark, sf, "documents", "doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    return found.select("doc_id", F.col("begin").alias("unit_begin"), F.col("end").alias("unit_end"), "kept_doc_id", "kept_begin")


@query("op2_passage_dedup")
def op2_passages(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.passages(table(spark, sf, "documents", "doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    return found.select("doc_id", F.col("begin").alias("unit_begin"), F.col("end").alias("unit_end"), "kept_doc_id", "kept_begin")


@query("op3_prefix_targets")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(table(spark, sf, "conversations", "conv_id", "turn", "role", "text").union(own)))


@query("op4_multi_index")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings", "vec_id", "embedding")
    return multi_index.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query("op9_language_ppm")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return language.languages(table(spark, sf, "documents", "doc_id", "text", "lang"))


@query("op10_license_scan")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents", "doc_id", "text")).drop("blocks")


@query("op11_collocations")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents", "text", "lang"))


@query("op13_cover_codes")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return cover_codes.codes(table(spark, sf, "embeddings", "vec_id", "embedding", "label")).drop("label")


@query("op12_jaccard_join")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf, "documents", "doc_id", "text"), size=4, share=85)
