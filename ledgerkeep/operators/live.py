"""Search over the log as it stands: read, check, drop superseded records, refresh vectors, rank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkeep.functions.hashing import DIMENSION
from ledgerkeep.operators import checks
from ledgerkeep.operators import memory as mem
from ledgerkeep.operators.models import embed_missing
from ledgerkeep.operators.similarity import top_k
from ledgerkeep.session import cut
from ledgerkeep.sources import logs


def log_violations(parsed: DataFrame, order: str = "seq") -> DataFrame:
    """Every reason why a log is not valid, by line: (seq, reason). ``parsed`` comes from ``parse_events``.

    A line is corrupt if it is no event, if a record rule fails, if its id was used before, or if it supersedes a
    record that is not there yet or is replaced already.
    """
    corrupt = logs.corrupt_lines(parsed, order).select(F.col(order).alias("seq"), F.lit("not_an_event").alias("reason"))
    events = logs.event_rows(parsed, order).withColumnRenamed(order, "seq")
    rules = checks.record_violations(events.withColumn("metadata", F.to_json("metadata")), "seq")
    replay = mem.replay_violations(events.select("seq", "memory_id", "supersedes"))
    return corrupt.unionByName(rules.select("seq", F.explode(F.split("reasons", ",")).alias("reason"))).unionByName(replay.select("seq", "reason"))


def search_active_log(
    lines: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    version: str,
    dimension: int = DIMENSION,
    embed: Callable[[pd.Series], np.ndarray] | None = None,
) -> DataFrame:
    """The k best active records of each query: query_id, rank, score and the record's fields.

    ``lines``: seq, line (JSON events). ``vectors``: memory_id, embedding_version, vector, as stored; missing ones are
    made. ``queries``: query_id, vector. An invalid log stops the run with its first bad line.
    """
    parsed = cut(logs.parse_events(lines).select("seq", "event", "well_formed"))
    first = log_violations(parsed).agg(F.min("seq").alias("n")).first().n
    if first is not None:
        raise ValueError(f"corrupt event log at line {first}")
    active = cut(mem.active_view(logs.event_rows(parsed)))
    usable = embed_missing(active.select("memory_id", "content"), vectors, version, dimension, embed)
    hits = top_k(usable.select("memory_id", "vector"), queries, k)
    return hits.join(active, "memory_id").select("query_id", "rank", "score", *active.columns)
