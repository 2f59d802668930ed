"""The corpus pipeline: documents in, token files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerkeep.llm import decontaminate, mixing, quality, simhash, token_blocks
from ledgerkeep.llm.queries import END_ID, TARGETS, labelled_domains, word_tokenizer
from ledgerkeep.session import staging_path
from ledgerkeep.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return simhash.one_of_each(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def domain_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated at rates of at least one, so that languages meet their shares and none is lost."""
    labelled = labelled_domains(docs, table(spark, sf_dir, "labels", "doc_id"))
    mixed = mixing.mix(docs, labelled, TARGETS, least=1.0, prefix="__mix_")
    return mixing.repeat(mixed, docs.columns, "__mix_copies")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents in ascending doc_id order, and their index read back from them."""
    path = staging_path(spark, "pipeline-tokens")
    token_blocks.write(docs, path, word_tokenizer(), END_ID)
    return token_blocks.read_documents(spark, path)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("domain_mixing", domain_mixing),
    ("token_output", token_output),
]

#: SimHash, the learned classifiers and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = staging_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
