"""The log as a stream: ingest with a side output, idempotent writes, the active view, scoring with running cost.

Supersession follows log order (``seq``), never event time. Every sink below is keyed by micro-batch id, so a batch
that is replayed after a failure overwrites its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ledgerkeep.functions.text import exact_match, token_f1
from ledgerkeep.sources.logs import parse_events

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINE_SCHEMA = "seq bigint, line string"
#: Ids are dealt into this many buckets, and a bucket is one key of the state store: calls into Python and into the store
#: then grow with buckets, not with ids. Part of a stream's checkpoint, so it must not change while the stream lives.
BUCKETS = 4096


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


def _load(state) -> dict:
    """A bucket's entries: the first column by the tuple of the others."""
    if not state.exists():
        return {}
    key, *rest = [c.to_pylist() for c in pa.ipc.open_stream(state.get()[0]).read_all().columns]
    return dict(zip(key, zip(*rest)))


def _store(state, entries: dict, schema: pa.Schema) -> None:
    columns = [list(entries), *zip(*entries.values())]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema))
    state.update((sink.getvalue().to_pybytes(),))


def read_log_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LINE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest(lines: DataFrame, accepted: str, rejected: str) -> DataStreamWriter:
    """Well-formed events to one folder, raw bad lines to another."""

    def sink(df: DataFrame, batch: int) -> None:
        parsed = parse_events(df)
        _write_batch(parsed.where("well_formed").select("seq", "event.memory.*"), accepted, batch)
        _write_batch(parsed.where("not well_formed").select("seq", "line"), rejected, batch)

    return lines.writeStream.foreachBatch(sink)


def _combine_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.groupby(["memory_id", "payload_hash"], as_index=False, dropna=False, sort=False).agg(seq=("seq", "min"), copies=("copies", "sum"))


class FirstPayload(StatefulProcessor):
    """Per id of a bucket the first payload seen; later rows are retries of it or conflicts with it."""

    SCHEMA = pa.schema([("memory_id", pa.string()), ("payload_hash", pa.string())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first", "entries binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[str, dict[str, tuple[int, int]]] = {}
        for pdf in rows:
            for target, payload, low, n in zip(*[pdf[c].tolist() for c in ("memory_id", "payload_hash", "seq", "copies")]):
                mine = counts.setdefault(target, {})
                seen = mine.get(payload)
                mine[payload] = (min(low, seen[0]), n + seen[1]) if seen else (low, n)
        known = _load(self._first)
        out: list[tuple] = []
        for target, mine in counts.items():
            fresh = target not in known
            if fresh:
                known[target] = (min(mine, key=lambda p: mine[p][0]),)
            first = known[target][0]
            out += [
                (target, p, low, int(fresh and p == first), n - int(fresh) if p == first else 0, 0 if p == first else n)
                for p, (low, n) in mine.items()
            ]
        _store(self._first, known, self.SCHEMA)
        yield pd.DataFrame(out, columns=["memory_id", "payload_hash", "first_seq", "accepted", "retries", "conflicts"])

    def close(self) -> None:
        pass


WRITE_OUTCOME = "memory_id string, payload_hash string, first_seq bigint, accepted bigint, retries bigint, conflicts bigint"


def idempotent_writes(writes: DataFrame) -> DataFrame:
    """Outcome rows of a stream of writes (seq, memory_id, payload). State holds one hash per id; ids never expire.

    Needs the RocksDB state store. Repeats collapse in each Arrow batch before the shuffle, so an id retried very
    often still reaches its state in few rows. Inside a micro-batch the smallest seq counts as first.
    """
    hashed = writes.select("memory_id", F.sha2("payload", 256).alias("payload_hash"), "seq", F.lit(1).cast("long").alias("copies"))
    combined = hashed.mapInPandas(_combine_batches, hashed.schema).withColumn("bucket", _bucket(F.col("memory_id")))
    return combined.groupBy("bucket").transformWithStateInPandas(FirstPayload(), WRITE_OUTCOME, "Append", "None")


class LogRules(StatefulProcessor):
    """The replay rules for the ids of a bucket, whatever order their rows arrive in.

    State per id: the first own row (settled), the first row that replaces the id, and the rows that named it as their target
    before it was there (pending). A row that arrives late can make earlier verdicts wrong: a pending row is cleared
    by an own row with a smaller seq, an own row or a replacement that turns out not to be the first becomes a violation.
    Such corrections are rows with ``change`` -1 or +1. Pending rows, which one id can have many of, stay in the store one by one.
    """

    SCHEMA = pa.schema([("key", pa.string()), ("own", pa.int64()), ("seq", pa.int64()), ("by", pa.string())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getValueState("known", "entries binary")
        self._pending = handle.getMapState("pending", "key string, seq bigint", "by string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = _load(self._known)
        for pdf in rows:
            out: list[tuple] = []
            arrived: dict[str, tuple[list, list]] = {}
            for target, seq, by in zip(pdf["key"].tolist(), pdf["seq"].tolist(), pdf["by"].tolist()):
                own, claims = arrived.setdefault(target, ([], []))
                if by is None:
                    own.append(seq)
                else:
                    claims.append((seq, by))
            earlier = {}  # ids whose first own row is new
            for target, (own, claims) in arrived.items():
                before, taken, taken_by = known.get(target, (None, None, None))
                first = before
                if own:
                    first = min(own) if before is None else min(before, *own)
                    later = [s for s in own if s != first]
                    if first != before:
                        earlier[target] = first
                        later += [] if before is None else [before]
                    out += [("violation", s, target, "duplicate_id", 1) for s in later]
                if claims:
                    low = min(claims, key=lambda c: c[0])
                    win = low if taken is None or low[0] < taken else (taken, taken_by)
                    beaten = [c for c in claims if c[0] != win[0]]
                    if taken is None:
                        out.append(("replaced", None, target, None, 1))
                    elif win[0] != taken:
                        beaten.append((taken, taken_by))
                    out += [("violation", s, b, "already_replaced", 1) for s, b in beaten]
                    taken, taken_by = win
                    for s, b in claims:
                        if first is None or first >= s:
                            out.append(("violation", s, b, "unknown_or_later_target", 1))
                            self._pending.updateValue((target, s), (b,))
                known[target] = (first, taken, taken_by)
            if earlier:
                cleared = [(k, v[0]) for k, v in self._pending.iterator() if k[0] in earlier and k[1] > earlier[k[0]]]
                for (target, s), b in cleared:
                    out.append(("violation", s, b, "unknown_or_later_target", -1))
                    self._pending.removeKey((target, s))
            yield pd.DataFrame({c: pd.Series([o[i] for o in out], dtype=t) for i, (c, t) in enumerate(_CHANGE_TYPES)})
        _store(self._known, known, self.SCHEMA)

    def close(self) -> None:
        pass


CHANGES = "kind string, seq bigint, memory_id string, reason string, change bigint"
_CHANGE_TYPES = [("kind", object), ("seq", "Int64"), ("memory_id", object), ("reason", object), ("change", "int64")]


def rule_changes(records: DataFrame) -> DataFrame:
    """Changes of the log's verdicts while its rows (seq, memory_id, supersedes) arrive in any order and number of
    micro-batches. Each row goes to the state of its own id and to that of its target. Needs the RocksDB state store;
    ``read_violations`` and ``read_replaced`` add the changes up."""
    own = F.struct(F.col("memory_id").alias("key"), "seq", F.lit(None).cast("string").alias("by"))
    claim = F.struct(F.col("supersedes").alias("key"), "seq", F.col("memory_id").alias("by"))
    both = F.when(F.col("supersedes").isNull(), F.array(own)).otherwise(F.array(own, claim))
    messages = records.select(F.explode(both).alias("m")).select("m.key", "m.seq", "m.by", _bucket(F.col("m.key")))
    return messages.groupBy("bucket").transformWithStateInPandas(LogRules(), CHANGES, "Append", "None")


def read_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Violations that stand after all changes so far: seq, memory_id, reason."""
    changes = spark.read.schema(CHANGES).parquet(folder).where("kind = 'violation'")
    return changes.groupBy("seq", "memory_id", "reason").agg(F.sum("change").alias("c")).where("c > 0").drop("c")


def read_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that some row replaces: the active view is the records without them."""
    return spark.read.schema(CHANGES).parquet(folder).where("kind = 'replaced'").select("memory_id").distinct()


def active_view_sink(records: DataFrame, folder: str) -> DataStreamWriter:
    """Append each batch's records and the ids they supersede; see ``read_active_view``."""

    def sink(df: DataFrame, batch: int) -> None:
        _write_batch(df, f"{folder}/records", batch)
        gone = df.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("memory_id")).distinct()
        _write_batch(gone, f"{folder}/tombstones", batch)

    return records.writeStream.foreachBatch(sink)


def read_active_view(spark: SparkSession, folder: str) -> DataFrame:
    """Records without a tombstone, over all batches so far."""
    records = spark.read.parquet(f"{folder}/records")
    return records.join(spark.read.parquet(f"{folder}/tombstones"), "memory_id", "left_anti")


def score_stream(responses: DataFrame) -> DataFrame:
    """Scores added row by row; no state."""
    answer, gold = F.col("generated_answer"), F.col("gold_answer")
    return responses.withColumns({"exact_match": exact_match(answer, gold), "token_f1": token_f1(answer, gold)})


def running_cost(responses: DataFrame, ceiling: float) -> DataFrame:
    """Seconds and answers per run so far, and whether the ceiling is reached (complete mode)."""
    totals = responses.groupBy("run").agg(F.count("*").alias("answers"), F.sum("seconds").alias("seconds"))
    return totals.withColumn("ceiling_reached", F.col("seconds") >= ceiling)


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything available, then stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

