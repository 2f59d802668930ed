import random

from pyspark.sql import functions as F

import pytest

from ledgerkeep.operators import checks
from ledgerkeep.operators import memory as mem
from ledgerkeep.sources import logs

LOG = "seq long, memory_id string, supersedes string"


def sequential(rows):
    admitted, replaced, out = {}, set(), {}
    for seq, mid, target in sorted(rows):
        ok = mid not in admitted and (target is None or (target in admitted and target not in replaced))
        if ok:
            admitted[mid] = seq
            if target:
                replaced.add(target)
        out[seq] = ok
    return out


def test_batch_admission_equals_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [(i, f"m{rng.randrange(60)}", rng.choice([None, f"m{rng.randrange(60)}"])) for i in range(200)]
    got = {r.seq: r.admitted for r in mem.admit_batch(spark.createDataFrame(rows, LOG)).collect()}
    assert got == sequential(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_admission_with_much_contention(spark, seed):
    rng = random.Random(seed)
    names = 15 * seed
    rows = [(i * 3, f"m{rng.randrange(names)}", rng.choice([None, f"m{rng.randrange(names)}", f"m{rng.randrange(names)}"])) for i in range(90)]
    got = {r.seq: r.admitted for r in mem.admit_batch(spark.createDataFrame(rows, LOG)).collect()}
    assert got == sequential(rows)


def test_a_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    rows = [(i, f"m{i}", f"m{i - 1}" if i else None) for i in range(10_000)]
    rows += [(20_000, "m0", None), (20_001, "late", "m9999"), (20_002, "later", "m9999"), (20_003, "x", "nobody"), (20_004, "y", "x"), (20_005, "z", "y")]
    calls = []
    monkeypatch.setattr(mem, "cut", lambda df, cut=mem.cut: calls.append(1) or cut(df))
    got = {r.seq: r.admitted for r in mem.admit_batch(spark.createDataFrame(rows, LOG).repartition(4)).collect()}
    assert got == sequential(rows)
    assert len(calls) <= 14 + 14


def test_rounds_of_batch_admission_write_undecided_rows_only(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, f"m{i if rng.random() < 0.8 else i // 2}", f"m{i + 1}" if rng.random() < 0.2 else f"m{max(0, i - rng.randrange(1, 40))}" if i > 20 else None) for i in rng.sample(range(1000), 1000)]
    rows = [(seq, mid, target) for seq, (_, mid, target) in enumerate(rows)]
    written = []

    def counted(df, cut=mem.cut):
        table = cut(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(mem, "cut", counted)
    got = {r.seq: r.admitted for r in mem.admit_batch(spark.createDataFrame(rows, LOG)).collect()}
    assert got == sequential(rows)
    assert sum(written) <= 8 * len(rows)


def test_batch_admission_with_groups_of_any_size_and_odd_rows(spark):
    wide = [(2**62 + 5 * i, "a" if i < 3 else "b" if i < 9 else f"c{i}", [None, "b", "a", "q"][i % 4]) for i in range(40)]
    odd = [(-7, "q", "q"), (-6, "b", "nobody"), (-5, "s", None), (-4, "t", "s"), (-3, "u", "s"), (-2, "t", None), (-1, "u", "t"), (0, "e", None), (1, "v", "e"), (2, "w", "e")]
    got = {r.seq: r.admitted for r in mem.admit_batch(spark.createDataFrame(wide + odd, LOG)).collect()}
    assert got == sequential(wide + odd)
    assert mem.admit_batch(spark.createDataFrame([], LOG)).collect() == []


def test_supersession(spark):
    log = spark.createDataFrame([(1, "old", None), (2, "new", "old")], LOG)
    assert [r.memory_id for r in mem.active_view(log).collect()] == ["new"]
    assert mem.history_view(log).count() == 2
    again = log.union(spark.createDataFrame([(3, "x", "old"), (4, "y", "nobody"), (5, "new", None)], LOG))
    bad = {(r.seq, r.reason) for r in mem.replay_violations(again).collect()}
    assert bad == {(3, "already_replaced"), (4, "unknown_or_later_target"), (5, "duplicate_id")}
    assert mem.first_violation(mem.replay_violations(again)).first().seq == 3


def test_retry_and_conflict(spark):
    writes = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y")], "seq long, memory_id string, payload string")
    got = {(r.first_seq, r.accepted, r.retries, r.conflicts) for r in mem.classify_writes(writes).collect()}
    assert got == {(1, 1, 1, 0), (3, 0, 0, 1)}


def test_consolidation_is_order_independent(spark):
    rows = [("A", "city", "a", "a", "Currently, A lives in Rome.", 1), ("A", "city", "b", "b", "Currently, A lives in Perth.", 2)]
    schema = "subject string, relation string, memory_id string, canonical_id string, content string, event_order long"
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema)
        r = mem.consolidate(df).first()
        assert (r.content, r.canonical_id, r.source_count) == ("A lives in Perth.", "b", 2)
        assert {x.source_id for x in mem.provenance(df, mem.consolidate(df)).collect()} == {"a", "b"}
        assert mem.consolidate(df, keep_cue=True).first().content == "Currently, A lives in Perth."


def test_capture(spark):
    turns = [("c", 1, "user", "one"), ("c", 2, "assistant", "two"), ("c", 3, "user", "abcdefghij"), ("c", 4, "assistant", "four")]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    pick = lambda **k: [(r.turn, r.text) for r in mem.capture(df, **k).orderBy("turn").collect()]
    assert [t for t, _ in pick(strategy="last_turn", limit=99)] == [3, 4]
    assert [t for t, _ in pick(strategy="full_session", limit=99)] == [1, 2, 3, 4]
    assert pick(strategy="full_session", limit=5, include_assistant=False) == [(1, "one"), (3, "abcde...")]


def test_log_lines_and_torn_tail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"x":1}\ninvalid\n\n{"torn"')
    (tmp_path / "b.jsonl").write_bytes(b'{"x":1}\n')
    lines = logs.read_lines(spark, str(tmp_path))
    a = {r.line_number: (r.line, r.terminated) for r in lines.where(F.col("file").endswith("a.jsonl")).collect()}
    assert a == {1: ('{"x":1}', True), 2: ("invalid", True), 3: ("", True), 4: ('{"torn"', False)}
    assert logs.torn_tails(lines).count() == 1
    bad = logs.strict_line_violations(lines.where("terminated"))
    assert {(r.line_number, r.reason) for r in bad.collect()} == {(2, "not_an_object"), (3, "blank")}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f"line {i}\n" for i in range(1, 4001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines = logs.read_lines(spark, str(tmp_path))
        assert lines.select("file").rdd.getNumPartitions() >= 1
        wrong = lines.where(F.col("line") != F.concat(F.lit("line "), F.col("line_number").cast("string")))
        assert lines.count() == 4000 and wrong.count() == 0 and lines.where("not terminated").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_corrupt_line_is_named(spark):
    rows = [(1, '{"schema_version":1,"type":"memory_written","memory":{"memory_id":"a"}}'), (2, "invalid-json")]
    parsed = logs.parse_events(spark.createDataFrame(rows, "seq long, line string"))
    assert [r.seq for r in logs.corrupt_lines(parsed).collect()] == [2]
    with pytest.raises(ValueError, match="line 2"):
        logs.require_sound(parsed)


def test_invalid_records(spark):
    good = ("a", "text", "2024-01-01T00:00:00+00:00", 0.5, "user", "v", None, "{}")
    rows = [good, ("b", *good[1:3], -1.0, *good[4:]), ("c", *good[1:3], float("nan"), *good[4:]), ("d", "text", "2024-01-01T00:00:00", *good[3:]), ("e", *good[1:7], "[1]"), ("f", " ", *good[2:])]
    schema = "memory_id string, content string, timestamp string, importance double, source string, embedding_version string, supersedes string, metadata string"
    got = {r.memory_id: r.reasons for r in checks.record_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"b": "importance", "c": "importance", "d": "timestamp", "e": "metadata", "f": "blank_content"}


def test_table_diff_tolerance(spark):
    schema = "id long, v double, n long"
    a = spark.createDataFrame([(1, 1.0, 1), (2, float("nan"), 1), (3, 1.0, 2), (4, None, 1)], schema)
    b = spark.createDataFrame([(1, 1.0 + 5e-11, 1), (2, float("nan"), 1), (3, 1.0, 1), (4, None, 1), (5, 1.0, 1)], schema)
    got = {(r.id, r["column"]) for r in checks.table_diff(a, b, ["id"]).collect()}
    assert got == {(2, "v"), (3, "n"), (5, "missing_row")}


@pytest.mark.parametrize(("damage", "rule"), [
    ("time", "memory_time"), ("split", "split"), ("support", "support"), ("duplicate", "duplicate_memory"), ("order", "future_order"), (None, None),
])
def test_snapshot_damage_is_named(spark, damage, rule):
    snaps = spark.createDataFrame([("s", "other" if damage == "split" else "train", 10)], "snapshot_id string, split string, event_order long")
    ids = ["a", "a"] if damage == "duplicate" else ["a", "b"]
    memories = spark.createDataFrame([("s", i, 10 if damage == "time" else 1) for i in ids], "snapshot_id string, memory_id string, event_order long")
    history = spark.createDataFrame([("s", "h", 5)], "snapshot_id string, query_id string, event_order long")
    support = [["z"]] if damage == "support" else [["a"]]
    future = spark.createDataFrame(
        [("s", "q1", 13 if damage == "order" else 11, 0, "x", support), ("s", "q2", 12, 1, "x", [["a"]])],
        "snapshot_id string, query_id string, event_order long, position int, gold_answer string, supports array<array<string>>",
    )
    rules = {r.rule for r in checks.snapshot_violations(snaps, memories, history, future).collect()}
    assert rules == ({rule} if rule else set())
