import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from ledgerkeep.llm import cover_codes as cc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, v int"


def brute(rows, parts=4, entries=256, rounds=4):
    """id, label, code, error, label_error and digest by plain loops; one length of vectors."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for c in cut:
                got[nearest(p, c[p])[1]].append(c[p])
            for k, xs in got.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for (i, _, lab), c in zip(kept, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        by[lab] += out[-1][3]
    return sorted(((*r, by[r[1]], sha) for r in out), key=repr)


def got(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = cc.codes(df, **settings)
    assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def rows(seed, n, dim, scale=1.0, clusters=6, steps=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = (centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 0.05) * scale
    x = np.round(x * steps) / steps if steps else x
    return [(int(i), [float(a) for a in v], None if i % 5 == 0 else int(i % 3)) for i, v in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("given", [dict(seed=1, n=300, dim=8), dict(seed=2, n=200, dim=4, steps=2), dict(seed=3, n=90, dim=8, scale=3e6)])
def test_codes_equal_brute_force(spark, given):
    some = rows(**given)
    assert got(spark, some, entries=16) == brute(some, entries=16)


def test_whole_setting_with_repeats_and_bad_rows(spark):
    some = rows(4, 400, 8)
    some += some[:20] + [(9001, None, 1), (9002, [1.0, None] * 4, 1), (9003, [math.nan] * 8, 1), (9004, [math.inf] + [0.0] * 7, None), (None, [0.5] * 8, 7)]
    assert got(spark, some) == brute(some)


def test_lengths_are_coded_apart_and_empty_tables_give_nothing(spark):
    eight, four = rows(5, 40, 8), [(i + 100, v, lab) for i, v, lab in rows(6, 30, 4)]
    found = got(spark, [*eight, *four, (500, [1.0, 2.0, 3.0], 1), (501, [], 9)], entries=8)
    assert {(r[0], r[2], r[3], r[5]) for r in found if r[0] != 501} == {(r[0], r[2], r[3], r[5]) for x in (eight, four) for r in brute(x, entries=8)}
    assert [r[1:5] for r in found if r[0] == 501] == [(9, "00000000", 0, 0)]
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []


def test_whole_subtrees_are_assigned_and_trees_survive_packing():
    rng = np.random.default_rng(7)
    points = np.repeat(rng.integers(-900, 900, size=(10, 4)), 100, axis=0) + rng.integers(-5, 6, size=(1000, 4))
    entries = points[::97][:8]
    for tree in (cc.Tree(points), cc._unpack(cc._pack(points, 1), 1)[0]):
        label, sums, counts, single = tree.assign(entries)
        exact = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (label == exact).all() and single < 300
        assert (counts == np.bincount(exact, minlength=8)).all() and (sums == np.array([points[exact == k].sum(axis=0) for k in range(8)])).all()
