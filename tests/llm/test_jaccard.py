import random
import re

import numpy as np
import pytest

from ledgerkeep.llm import jaccard as jc


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, size=4, share=85):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= share * (len(x) + len(sets[j]) - both):
                label[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), low.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def got(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, n string, row int, token int").repartition(3)
    return sorted(map(tuple, jc.near_duplicates(df, **settings).collect()), key=repr)


def corpus(seed, groups=8, members=9, alone=25, passage=40):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    shared = [word() for _ in range(passage)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 8, 30, 80, 200]))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [word()] * rng.randrange(2)
            out.append(w)
    for _ in range(alone):
        w = [word() for _ in range(rng.randrange(60))]
        out.append(w[: len(w) // 2] + shared + w[len(w) // 2 :] if rng.random() < 0.6 else w)
    texts = [rng.choice([" ", "\n", "\t  "]).join(w).title() if rng.random() < 0.3 else " ".join(w) for w in out]
    rng.shuffle(texts)
    return [(i * 3 % 1000, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, monkeypatch, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_small_blocks_no_common_shingles_and_other_settings(spark, monkeypatch):
    rows = corpus(3)
    for name, value in (("BLOCK", 3), ("MEMBERS", 2), ("SIDES", 2), ("COMMON", 2)):
        monkeypatch.setattr(jc, name, value)
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, size=2, share=60) == brute(rows, size=2, share=60)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two three"), (5, "ONE two\tthree"), (5, "one two three"), (None, "one two three"), (None, "alone"), (7, "one"), (8, "É é"), (9, "é é")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_pieces_of_long_texts_give_the_same_set():
    rng = random.Random(4)
    text = (" ".join("w%d" % rng.randrange(50) for _ in range(3000)) + " \n " + "x" * 500).encode()
    whole = jc.shingle_sets([text], 4)[0]
    for limit in (1, 50, 1000, 1 << 20):
        assert (jc.shingle_set(text, 4, limit) == whole).all()
    assert (jc.shingle_set(b"a " + b"b" * 99, 4, 10) == jc.shingle_sets([b"A\tB" + b"b" * 98], 4)[0]).all()
    assert len(jc.shingle_set(b"", 4)) == 0


def test_filters_lose_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(4, 2000))
        x = set(rng.integers(0, 1 << 60, size=n).tolist())
        y = set(list(x)[: int(len(x) * rng.uniform(0.8, 1))]) | set(rng.integers(0, 1 << 60, size=int(rng.integers(0, 1 + n // 8))).tolist())
        both = len(x & y)
        if 100 * both >= 85 * (len(x) + len(y) - both):
            wide = [jc.parities(np.array(sorted(z), dtype=np.uint64)) for z in (x, y)]
            for bits in {512, 64 * min(map(len, wide))}:
                a, b = (jc.folded(w, bits)[None] for w in wide)
                assert jc._apart(a, b)[0] <= len(x ^ y) <= jc._most_apart(len(x), len(y), 85)


def test_shingle_rows_are_never_broadcast(spark, monkeypatch):
    """Spark sizes an exploded array by one entry, so it would take the shingles of a large table for a small one."""
    plans, staged = [], jc._staged

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString().splitlines())
        return staged(df, label)

    monkeypatch.setattr(jc, "_staged", seen)
    rows = corpus(5)
    assert got(spark, rows) == brute(rows)
    depth = lambda line: len(line) - len(line.lstrip(" :|+-*"))
    shingles = 0
    for lines in plans:
        above = []  # exchanges on the way to a line; a shuffle's real size is known before what reads it is planned anew
        for line in lines:
            above = [x for x in above if x[0] < depth(line)]
            if "Exchange" in line:
                above.append((depth(line), line))
            if "Generate explode(arrays_zip" in line:
                shingles += 1
                assert above and "Broadcast" not in above[-1][1], "\n".join(lines)
    assert shingles >= 4
