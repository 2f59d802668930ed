"""The pipeline's stages on small driver tables, each against brute force on what it was given."""

from pathlib import Path

import pytest

import corpus_pipeline as cp
from ledgerkeep.llm import quality
from ledgerkeep.session import staging_path

from .test_decontaminate import brute as leaks
from .test_simhash import brute_components, brute_fingerprint
from .test_token_blocks import brute as token_rows

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver tables are not here")


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        path = staging_path(spark, name)
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns(results):
    assert all(r.columns == results[0].columns for r in results[:-1])
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "domain_mixing", "token_output"]


def test_quality_keeps_what_the_model_accepts(spark, results):
    scores = quality.quality_scores(results[0], spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    assert sorted(ids(results[1])) == sorted(r.doc_id for r in scores if r.predicted)
    told = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = set(ids(results[1]))
    assert sum((i in kept) == (q == 1) for i, q in told.items()) >= 0.95 * len(told)


def test_one_of_each_group_stays(results):
    rows = sorted((r.doc_id, r.text) for r in results[1].collect())
    groups = brute_components([brute_fingerprint(t, 5) for _, t in rows], 3)
    assert sorted(ids(results[2])) == sorted({rows[g][0] for g in groups})


def test_leaks_go(spark, results):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = leaks([(r.doc_id, r.text) for r in results[2].collect()], items)
    assert sorted(ids(results[3])) == sorted(set(ids(results[2])) - {d for d, _ in found})


def test_mixing_loses_none_and_meets_the_shares(results):
    words = {r.doc_id: (len(r.text.split()), r.lang) for r in results[3].collect()}
    mixed = ids(results[4])
    assert set(mixed) == set(words)
    total = sum(words[i][0] for i in mixed)
    for lang, share in cp.TARGETS.items():
        assert abs(sum(words[i][0] for i in mixed if words[i][1] == lang) / total - share) < 0.12  # whole copies of few documents


def test_tokens_of_all_documents(results):
    rows = sorted((r.doc_id, r.text) for r in results[4].collect())
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in results[5].collect()), key=lambda r: r[1]) == token_rows(rows)
