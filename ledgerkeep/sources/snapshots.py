"""Nested snapshots to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_snapshots(nested: DataFrame) -> dict[str, DataFrame]:
    """snapshots, memories, history_queries and future_queries of nested snapshot rows."""
    arrays = ("memories", "history_queries", "future_queries")
    tables = {"snapshots": nested.select(*[c for c in nested.columns if c not in arrays])}
    for name in arrays:
        if name in nested.columns:
            tables[name] = nested.select("snapshot_id", F.inline(name))
    return tables
