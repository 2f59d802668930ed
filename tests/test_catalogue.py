"""Registered queries against their SQL on the smallest tables. LEDGERKEEP_ALL=1 runs every one."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "a2_corrupt_lines", "a3_torn_tail", "b9_coverage_audit", "c3_replay_violations", "c4_active_view", "d6_answer_scores", "e1_vector_top_k",
    "f1_available_memories", "f3_historical_similarity", "g9_greedy_select", "g11_semantic_representatives", "g13_plan_table", "h15_plan_summary",
    "h27_pairwise_interaction", "i2_median_imputation", "n3_stream_active_view",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("LEDGERKEEP_ALL") else QUICK)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == expected
