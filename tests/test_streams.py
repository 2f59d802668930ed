import random

from pyspark.sql import functions as F

from ledgerkeep.operators import memory as mem
from ledgerkeep.session import staging_path
from ledgerkeep.streaming import log_stream as ls

LOG = "seq long, memory_id string, supersedes string"


def test_rules_of_rows_in_any_order_equal_a_replay(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ls.ROCKSDB)
    rng = random.Random(5)
    rows = [(i, f"m{rng.randrange(25)}", rng.choice([None, f"m{rng.randrange(30)}"])) for i in range(80)]
    log = spark.createDataFrame(rows, LOG)
    order = rows[:]
    rng.shuffle(order)
    source, out = staging_path(spark, "rows"), staging_path(spark, "changes")
    for begin in (0, 30, 55):  # a restart before each part; files in between go through one trigger each
        end = {0: 30, 30: 55, 55: 80}[begin]
        for part in (order[begin : (begin + end) // 2], order[(begin + end) // 2 : end]):
            spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
        ls.run_to_end(ls.rule_changes(stream).writeStream.format("parquet").option("path", out).outputMode("append"), f"{out}-state")
        seen = spark.createDataFrame(order[:end], LOG)
        assert sorted(map(tuple, ls.read_violations(spark, out).collect())) == sorted(map(tuple, mem.replay_violations(seen).collect()))
        active = seen.join(ls.read_replaced(spark, out), "memory_id", "left_anti")
        assert sorted(r.seq for r in active.collect()) == sorted(r.seq for r in mem.active_view(seen).collect())
    changes = spark.read.schema(ls.CHANGES).parquet(out)
    assert changes.where("change < 0").count() > 0 and log.count() == 80
    assert changes.where(F.col("kind") == "replaced").groupBy("memory_id").count().where("count > 1").isEmpty()


def calls(spark, tmp_path, monkeypatch, build, rows, schema):
    """How often the state processor is called while the stream of ``rows`` is read."""
    seen = tmp_path / "calls"
    seen.mkdir()
    for processor in (ls.FirstPayload, ls.LogRules):
        handle = processor.handleInputRows

        def counted(self, key, parts, timers, handle=handle):
            (seen / str(key[0])).touch()
            yield from handle(self, key, parts, timers)

        monkeypatch.setattr(processor, "handleInputRows", counted)
    monkeypatch.setattr(ls, "BUCKETS", 7, raising=False)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ls.ROCKSDB)
    source, out = staging_path(spark, "rows"), staging_path(spark, "out")
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ls.run_to_end(build(stream).writeStream.format("parquet").option("path", out).outputMode("append"), f"{out}-state")
    return out, len(list(seen.iterdir()))


def test_writes_call_the_state_once_a_bucket(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, *[f"m{k}" for k in range(60)]]), rng.choice(["a", "b", "c"])) for i in range(400)]
    out, called = calls(spark, tmp_path, monkeypatch, ls.idempotent_writes, rows, "seq long, memory_id string, payload string")
    assert called <= 7
    expected: dict = {}
    first: dict = {}
    for _, m, payload in rows:
        counts = expected.setdefault(m, [0, 0, 0])
        counts[0 if m not in first else 1 if first[m] == payload else 2] += 1
        first.setdefault(m, payload)
    sums = spark.read.parquet(out).groupBy("memory_id").agg(*[F.sum(c).alias(c) for c in ("accepted", "retries", "conflicts")])
    assert {r.memory_id: [r.accepted, r.retries, r.conflicts] for r in sums.collect()} == expected


def test_rules_call_the_state_once_a_bucket(spark, tmp_path, monkeypatch):
    rows = [(i, f"m{i}", f"m{(i * 7) % 90}" if i % 3 else None) for i in range(120)]
    out, called = calls(spark, tmp_path, monkeypatch, ls.rule_changes, rows[::-1], LOG)
    assert called <= 7
    whole = mem.replay_violations(spark.createDataFrame(rows, LOG))
    assert sorted(map(tuple, ls.read_violations(spark, out).collect())) == sorted(map(tuple, whole.collect()))
