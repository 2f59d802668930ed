import re
from collections import Counter

import numpy as np
import pytest

from ledgerkeep.llm import collocations as co
from ledgerkeep.llm import rolling


def brute(rows, words=3, least=10, keep=2000, share=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, words + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    out = {}
    for (lang, p), a in cands.items():
        inside = any(
            k[0] == lang and len(k[1]) > len(p) and 100 * b >= share * a and any(k[1][i : i + len(p)] == p for i in range(len(k[1]) - len(p) + 1))
            for k, b in cands.items()
        )
        if not inside:
            best = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            l, r = f[lang, p[: best[1]]], f[lang, p[best[1] :]]
            out.setdefault(lang, []).append((-best[0], -a, " ".join(p).encode(), l, r))
    return {
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:keep])
    }


def got(spark, rows, **settings):
    df = spark.createDataFrame([(t, x, 1, "c") for t, x in rows], "text string, lang string, key long, c string")
    return {tuple(r) for r in co.collocations(df, **settings).collect()}


def corpus(seed, rows=60, size=120, alphabet=14):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rows):
        w = [("w%d" if rng.random() < 0.9 else "É%d") % x for x in rng.zipf(1.4, size) % alphabet]
        seps = rng.choice([" ", "  ", "\t", ". ", ", ", "\n", " ! "], size, p=[0.7, 0.05, 0.05, 0.08, 0.06, 0.03, 0.03])
        out.append(("".join(a + b for a, b in zip(w, seps)), [None, "und", "en", "de", "en"][int(rng.integers(5))]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_result_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows, least=4) == brute(rows, least=4)
    assert got(spark, rows, least=4, keep=3) == brute(rows, least=4, keep=3)


def test_longer_phrases_and_other_share(spark):
    rows = corpus(3, rows=40)
    assert got(spark, rows, words=4, least=3, share=30) == brute(rows, words=4, least=3, share=30)


def test_edges(spark):
    rows = [(None, "en"), ("", None), (" \t\n", "en"), (".,;", "de")] + [("New York City. new york", None)] * 10 + [("a b", "und")] * 9
    assert got(spark, rows) == brute(rows) and len(got(spark, rows)) > 0
    assert got(spark, []) == set()
    assert got(spark, [("a a a a a a a a a a a a a", "en")]) == brute([("a a a a a a a a a a a a a", "en")])


def test_long_texts_are_cut_between_words(spark):
    text = "one two three four, five six\n" * 40
    whole = brute([(text, "en")])
    for limit in (1, 7, 64, 1000):
        pieces = list(rolling.cuts(text.encode(), 3, co.BLANKS + co.BREAKS, limit))
        assert b"".join(p[:own] for p, own in pieces) == text.encode()
        counted = Counter()
        for piece, own in pieces:
            w = rolling.Words(piece + b"\n", co.BLANKS, co.BREAKS)
            for n in (1, 2, 3):
                counted.update(w.text(int(i), n) for i in w.grams(n)[0] if w.begin[i] < own)
        assert counted["one two three"] == 40 and counted["four five"] == 0 and counted["five six"] == 40 and counted["six"] == 40
    assert got(spark, [(text, "en")]) == whole


def test_colliding_fingerprints_are_verified_against_the_text(spark):
    rows = corpus(5, rows=30)
    found = rolling.Words(b"one two three two one five\n", co.BLANKS, co.BREAKS)
    found.fp[:] = 7  # all words collide
    ids = co._word_ids(found)
    assert len(set(ids.tolist())) == 4 and ids[0] == ids[4] and ids[1] == ids[3]

    class Narrow(rolling.Words):
        def grams(self, n):
            at, fp = super().grams(n)
            return at, fp & np.uint64(7)

    docs = [(t.encode(), x or "und") for t, x in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in docs], "lang": [x for _, x in docs]})
    counted = Counter()
    old, co.Words = co.Words, Narrow
    try:
        class Whole:
            value = b"\xff" * (1 << (rolling.TABLE_BITS - 3))

        class Docs:
            def mapInArrow(self, run, schema):
                return list(run(iter([batch])))

        for b in co._materialise(Docs(), 3, [Whole] * 3):
            for r in b.to_pylist():
                counted[r["lang"], r["phrase"]] += r["c"] if r["words"] else 0
    finally:
        co.Words = old
    expected = Counter()
    for t, x in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.decode()):
            w = piece.split()
            expected.update((x, " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert {k: v for k, v in counted.items() if v} == dict(expected)
