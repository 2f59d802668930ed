"""Explicit schemas of the stored records."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_VERSION = 1
MEMORY_WRITTEN = "memory_written"

MEMORY = T.StructType(
    [
        T.StructField("memory_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("embedding_version", T.StringType()),
        T.StructField("supersedes", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _event() -> T.StructType:
    return T.StructType(
        [
            T.StructField("schema_version", T.LongType()),
            T.StructField("type", T.StringType()),
            T.StructField("memory", MEMORY),
        ]
    )


EVENT = _event()
