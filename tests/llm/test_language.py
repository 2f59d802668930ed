import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerkeep.llm import language as lg


def brute_bits(trains, text, order=lg.ORDER):
    """Code length by a plain walk over dictionaries."""
    follow = defaultdict(Counter)
    for t in trains:
        for i in range(len(t)):
            for k in range(order + 1):
                if i >= k:
                    follow[t[i - k : i]][t[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            seen = follow.get(text[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits -= math.log2(seen[text[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def tree(trains):
    counts = []
    for k in range(lg.ORDER + 1):
        keys, seen = np.unique(np.concatenate([lg.grams(np.frombuffer(t, dtype=np.uint8), k + 1) for t in trains]), return_counts=True)
        counts.append((keys, seen))
    return lg.Tree.of(counts)


def test_code_lengths_equal_a_plain_walk():
    trains = {"x": [b"the cat sat on the mat", b"then"], "y": ["été déjà là-bas".encode(), b"e"]}
    texts = [b"the", b"t", b"", b"the mat is \xff\x00 new", "été".encode() * 40, b"abcde"]
    got = lg.lengths(texts, [tree(trains["x"]), tree(trains["y"])])
    for i, text in enumerate(texts):
        for j, name in enumerate("xy"):
            assert abs(got[i, j] - brute_bits(trains[name], text)) < 1e-8


def test_languages_with_edges(spark):
    rng = np.random.default_rng(0)
    letters = {"aa": list("abcde"), "bb": list("defghé")}
    rows = [(i, " ".join("".join(rng.choice(letters[lang], 5)) for _ in range(30)), lang, "x") for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    odd = [(900, None, "aa", "x"), (901, "12 34 ...", "bb", "x"), (902, "", None, "x"), (903, "abcab " * 30_000, None, "x"), (None, "gggg hhhh fgfg", None, "x"), (0, rows[0][1], "aa", "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    got = lg.languages(df).collect()
    assert len(got) == len(rows) + len(odd)
    named = {r.doc_id: r for r in got}
    assert [named[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(named[i].lang_pred == ("aa", "bb")[i % 2] for i in range(80))
    assert {r.lang_pred for r in lg.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lg.languages(df.where(F.lit(False))).collect() == []


def test_the_training_bound_holds(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * 20, "aa") for i in range(400)], "doc_id long, text string, lang string")
    few = lg.count(df, bound=20_000)["aa"]
    assert few.followed[0][1].sum() < 40_000 < lg.count(df)["aa"].followed[0][1].sum()
