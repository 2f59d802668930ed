"""Where user models enter: batch functions over the rows that still need them.

A function gets a pandas Series of texts per Arrow batch and returns one value per text, so a model is loaded once
per worker and never called row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkeep.functions.hashing import DIMENSION, dense_vectors
from ledgerkeep.functions.text import echo_answer, storage_bytes
from ledgerkeep.operators.memory import missing_vectors

HASH_VERSION = "hash-test-v1:256"


def embed_missing(
    records: DataFrame,
    vectors: DataFrame,
    version: str,
    dimension: int,
    embed: Callable[[pd.Series], np.ndarray] | None = None,
) -> DataFrame:
    """Usable vectors of all records: the stored ones and new ones for the rest (memory_id, embedding_version, vector).

    ``embed`` None uses the built-in hashed bag of words, which stays in the JVM.
    """
    todo = missing_vectors(records, vectors, version, dimension).select("memory_id", "content")
    if embed is None:
        if dimension != DIMENSION:
            raise ValueError(f"the built-in vectors have {DIMENSION} dimensions")
        fresh = dense_vectors(todo, "memory_id", "content")
    else:
        id_type = dict(records.dtypes)["memory_id"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = np.asarray(embed(batch["content"]), dtype=np.float64)
                if out.shape != (len(batch), dimension) or not np.isfinite(out).all():
                    raise ValueError("the embedder returned invalid vectors")
                yield pd.DataFrame({"memory_id": batch["memory_id"], "vector": list(out)})

        fresh = todo.mapInPandas(run, f"memory_id {id_type}, vector array<double>")
    kept = vectors.where(F.col("embedding_version") == version).join(
        todo.select("memory_id"), "memory_id", "left_anti"
    ).join(records.select("memory_id"), "memory_id", "left_semi")
    return kept.select("memory_id", "embedding_version", F.col("vector").cast("array<double>").alias("vector")).unionByName(
        fresh.select("memory_id", F.lit(version).alias("embedding_version"), "vector")
    )


def answer_pending(pending: DataFrame, generate: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Add ``generated_answer`` to rows with ``prompt`` and ``context``. None gives the evidence-echo test answer."""
    if generate is None:
        return pending.withColumn("generated_answer", echo_answer(F.col("context")))
    model = F.pandas_udf(generate, "string")
    return pending.withColumn("generated_answer", model("prompt"))


def with_cost(records: DataFrame, tokens: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Add ``cost``: bytes of the stored JSON, or a user's token count of the content."""
    if tokens is None:
        return records.withColumn("cost", storage_bytes(F.col("memory_id"), F.col("content")))
    return records.withColumn("cost", F.pandas_udf(tokens, "long")("content"))
