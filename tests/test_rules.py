"""Literal cases of rules that went wrong once."""

import gzip
import hashlib
import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerkeep.functions import text as tx
from ledgerkeep.functions.hashing import DIMENSION, bag_of_words, dense_vectors
from ledgerkeep.operators import checks
from ledgerkeep.operators import memory as mem
from ledgerkeep.operators import retrieval as ret
from ledgerkeep.operators import selection as sel
from ledgerkeep.operators import similarity as sim
from ledgerkeep.operators.live import log_violations, search_active_log
from ledgerkeep.sources import logs


def test_context_takes_every_hit_the_caller_asked_for(spark):
    hits = spark.createDataFrame([("q", i, i, 1) for i in range(1, 151)], "query_id string, memory_id long, rank long, cost long")
    row = ret.budgeted_context(hits, ["query_id"], 10_000).first()
    assert len(row.context_ids) == 150 and row.memory_tokens == 150 + 149


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"b": 5, "a": "5"}', '{"a":"5","b":5}'), ('{"z": {"y": [1, {"d": null, "c": true}], "x": 1.5}}', '{"z":{"x":1.5,"y":[1,{"c":true,"d":null}]}}'),
        ("{}", "{}"), ('{"a": NaN}', None), ("[1]", None), ("no json", None), (None, None),
    ],
)
def test_canonical_metadata_keeps_types_at_every_level(spark, text, expected):
    df = spark.createDataFrame([(text,)], "m string")
    assert df.select(tx.canonical_json(F.col("m")).alias("c")).first().c == expected


def test_condition_and_modality_names(spark):
    names = {
        "consolidated": "consolidation_strip_temporal_cue", "merged_keep_current": "consolidation_keep_temporal_cue", "merged_strip_current": "consolidation_strip_temporal_cue",
        "relevant": "relevant", "retrieved:recency:k5": "retrieved:recency:k5", "empty": None, "Relevant": None, None: None,
    }
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["name"]: r.name_name for r in checks.apply_aliases(df, "name").collect()} == names
    kinds = spark.createDataFrame([("pdf",), ("ocr",), ("visual",), ("Pdf",)], "kind string")
    assert {r.kind: r.kind_name for r in checks.modality_names(kinds, "kind").collect()} == {"pdf": "native_text", "ocr": "ocr_text", "visual": "visual", "Pdf": None}


def test_equal_zero_vectors_stand_for_themselves(spark):
    rows = [("g", i, i, [0.0, 0.0]) for i in range(3)] + [("g", i, i, [1.0, 0.0]) for i in range(3, 6)]
    df = spark.createDataFrame(rows, "g string, memory_id long, event_order long, vector array<double>")
    got = {r.memory_id: r.representative_id for r in sim.greedy_representatives(df, ["g"], 0.9).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 5, 4: 5, 5: 5}


def test_compressed_logs_are_refused_and_plain_ones_read(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    with pytest.raises(ValueError, match="compressed"):
        logs.read_lines(spark, str(tmp_path / "a.log.gz"))
    (tmp_path / "b.log").write_text('{"a": 1}\n{"a": 2')
    assert [r.line for r in logs.torn_tails(logs.read_lines(spark, str(tmp_path / "b.log"))).collect()] == ['{"a": 2']


def test_a_case_without_distractor_keeps_its_other_conditions(spark):
    m = "struct<memory_id:string,content:string,event_order:long>"
    cases = spark.createDataFrame([(1, "r", ("n", "new", 2), ("o", "old", 1), True), (2, "s", ("n", "new", 2), ("o", "old", 1), False)], f"case_id long, relation string, current {m}, old {m}, swap boolean")
    distractors = spark.createDataFrame([("r", "d", "other", 0)], "relation string, memory_id string, content string, event_order long")
    rows = mem.explode_conditions(mem.assemble_conditions(cases, distractors)).collect()
    assert Counter(r.case_id for r in rows) == {1: 6, 2: 5}
    assert not [r for r in rows if r.case_id == 2 and r.condition == "irrelevant"]


def test_a_plan_that_keeps_nothing_still_counts_its_queries(spark):
    scored = spark.createDataFrame([("full", "q", "t", "f", 1.0)], "policy string, query_id string, memory_id string, canonical_id string, score double")
    queries = spark.createDataFrame([("q", "t", "f", "x")], "query_id string, target_memory_id string, target_canonical_id string, superseded_memory_id string")
    groups = spark.createDataFrame([("full",), ("none",)], "policy string")
    rows = {r.policy: r for r in ret.target_ranks(scored, queries, ["policy"], groups).collect()}
    assert rows["full"].exact_rank == 1
    assert rows["none"].exact_rank is None and rows["none"].fact_rank is None and rows["none"].old_first is False


def test_hashed_bag_equals_a_plain_count(spark):
    texts = {1: "a b a c", 2: "", 3: None, 4: "word " * 500 + "other", 5: "!!"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")

    def plain(text):
        counts = Counter(int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "big") % DIMENSION for t in re.findall(r"[a-z0-9]+", (text or "").lower()))
        norm = math.sqrt(sum(n * n for n in counts.values()))
        return {b: n / norm for b, n in counts.items()}

    got = {}
    for r in bag_of_words(df, "id", "text").collect():
        got.setdefault(r.id, {})[r.bucket] = r.weight
    dense = {r.id: r.vector for r in dense_vectors(df, "id", "text").collect()}
    for i, text in texts.items():
        assert got.get(i, {}) == pytest.approx(plain(text))
        assert dense[i] == pytest.approx([plain(text).get(b, 0.0) for b in range(DIMENSION)])


def event(seq, memory_id, content, supersedes=None, **more):
    memory = {
        "memory_id": memory_id, "content": content, "timestamp": "2024-01-01T00:00:00+00:00", "importance": 0.5, "source": "user",
        "embedding_version": "v", "supersedes": supersedes, "metadata": {}, **more,
    }
    return seq, json.dumps({"schema_version": 1, "type": "memory_written", "memory": memory})


def live(spark, *events):
    lines = spark.createDataFrame(list(events), "seq long, line string")
    queries = dense_vectors(spark.createDataFrame([("q", "blue door")], "query_id string, text string"), "query_id", "text")
    none = spark.createDataFrame([], "memory_id string, embedding_version string, vector array<double>")
    return lines, none, queries


def test_search_never_finds_a_superseded_record(spark):
    lines, none, queries = live(spark, event(1, "a", "the blue door"), event(2, "b", "a red door", "a"), event(3, "c", "something else"))
    hits = search_active_log(lines, none, queries, 10, "v").orderBy("rank").collect()
    assert [h.memory_id for h in hits] == ["b", "c"] and hits[0].content == "a red door"


def test_an_invalid_log_names_its_first_bad_line(spark):
    lines, none, queries = live(
        spark, event(1, "a", "x"), event(2, "b", " "), event(3, "a", "again"), event(4, "d", "y", "later"), (5, "{"), event(6, "e", "z", importance=7.0), event(7, "f", "t", timestamp="2024-01-01T00:00:00")
    )
    with pytest.raises(ValueError, match="line 2"):
        search_active_log(lines, none, queries, 3, "v")
    found = sorted((r.seq, r.reason) for r in log_violations(logs.parse_events(lines)).collect())
    assert found == [(2, "blank_content"), (3, "duplicate_id"), (4, "unknown_or_later_target"), (5, "not_an_event"), (6, "importance"), (7, "timestamp")]


@pytest.mark.parametrize(("cost", "score"), [(0, 1.0), (-1, 1.0), (1, float("nan")), (1, float("inf")), (1, None)])
def test_selectors_refuse_invalid_rows(spark, cost, score):
    df = spark.createDataFrame([("g", 1, cost, score, 5)], "g string, memory_id long, cost long, score double, budget long")
    with pytest.raises(Exception, match="must be"):
        sel.greedy_select(df, ["g"]).collect()


def test_spellings_of_a_field_are_type_checked(spark):
    df = spark.createDataFrame([(None, 2, "3", True)], "a double, b long, c string, d boolean")
    assert df.select(checks.first_present(df, [F.col("a"), F.col("b")], "number").alias("x")).first().x == 2.0
    for bad in ("c", "d"):
        with pytest.raises(ValueError, match="number"):
            checks.first_present(df, [F.col("a"), F.col(bad)], "number")


def test_the_second_tolerance_rule_and_ignored_columns(spark):
    expected = spark.createDataFrame([(1, 100.0, "a"), (2, 0.0, "b")], "id long, x double, note string")
    actual = spark.createDataFrame([(1, 100.9, "z"), (2, 0.4, "b")], "id long, x double, note string")
    assert checks.table_diff(actual, expected, ["id"], rtol=0.005, atol=0.5, rule="sum", ignored=["note"]).collect() == []
    assert [(r.id, r.column) for r in checks.table_diff(actual, expected, ["id"], rtol=0.005, atol=0.5, ignored=["note"]).collect()] == [(1, "x")]


def test_dense_vectors_equal_the_hashed_bag(spark, monkeypatch):
    from ledgerkeep.functions import hashing as hs

    texts = [(i, t) for i, t in enumerate(["K9 İx 中文a1", "鿿ꀀ䷿ \U0001f600b", "Straße ΣAΣ", "a" * 500 + " b-b", None, "", "é å"])]
    texts.append((99, "word w2 中 " * 90_000))
    df = spark.createDataFrame(texts, "id long, text string")
    sparse = {}
    for r in bag_of_words(df, "id", "text").collect():
        sparse.setdefault(r.id, {})[r.bucket] = r.weight
    dense = {r.id: r.vector for r in dense_vectors(df, "id", "text").collect()}
    assert dense == {i: [sparse.get(i, {}).get(b, 0.0) for b in range(DIMENSION)] for i, _ in texts}
    assert len(texts[-1][1].encode()) > hs.LONG_TEXT
    plan = dense_vectors(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
