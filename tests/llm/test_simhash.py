import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerkeep.llm import simhash as sh
from ledgerkeep.llm.graph import components


def brute_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(fps, radius):
    a = np.array(fps, dtype=np.int64).view(np.uint64)
    label = list(range(len(a)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            x, y = find(i), find(int(j))
            label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def planted(seed, groups=12, members=25, flips=(0, 6)):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(members):
            x = base
            for b in rng.sample(range(64), rng.randint(*flips)):
                x ^= 1 << b
            out.append(x - (1 << 64) if x >> 63 else x)
    return list(dict.fromkeys(out))


def test_fingerprints_and_their_edges(spark):
    texts = ["One two THREE four five", "one", "", None, " \t\n\x0b", "É É é a b", "a b c " * 3000, "a b c", "a b"]
    df = spark.createDataFrame([(i, t, "fp") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    for size in (3, 5):
        got = {r.doc_id: r.fp for r in sh.fingerprints(df.drop("fp"), size, "doc_id").collect()}
        assert got == {i: brute_fingerprint(t, size) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("radius", "segments", "block"), [(3, 8, 2048), (3, 8, 5), (3, 4, 7), (5, 8, 2048), (0, 8, 2048)])
def test_components_equal_brute_force(spark, monkeypatch, radius, segments, block):
    monkeypatch.setattr(sh, "BLOCK", block)
    fps = sorted(planted(radius * 10 + segments))
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    named = {r.fp: r.root for r in sh.roots(df, radius, segments).collect()}
    expected = brute_components(fps, radius)
    assert [named.get(x, x) for x in fps] == [fps[i] for i in expected]


def union_find(n, edges):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_forests_of_a_task_equal_union_find():
    rng = random.Random(3)
    cases = [(4, [(0, 2), (2, 3), (1, 3)])]
    for n in (4, 10, 30, 200):
        for _ in range(40):
            names = rng.sample(range(n), n)
            cases.append((n, [(names[i], names[i + 1]) for i in range(n - 1)]))  # paths
            cases.append((n, [(names[i], names[rng.randrange(i)]) for i in range(1, n)]))  # trees
            cases.append((n, [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]))
    for n, edges in cases:
        at, to = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        assert sh._forest(n, at, to).tolist() == union_find(n, edges), edges


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}}


def test_near_duplicates_with_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text), (3, text.upper()), (None, text), (9, "other words here are these"), (9, "other words here are these"), (7, None), (8, ""), (None, "alone with no id at all")]
    df = spark.createDataFrame([(d, t, 1, "c", 2.0) for d, t in rows], "doc_id long, text string, fp int, root string, component_id double")
    got = sorted(((r.doc_id, r.component_id) for r in sh.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 9), (9, 9), (7, 7), (8, 7), (None, None)], key=str)
    kept = sh.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 9, 7, None], key=str)
    empty = df.where(F.lit(False))
    assert sh.near_duplicates(empty).collect() == [] and sh.one_of_each(empty).collect() == []
