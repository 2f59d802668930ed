import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerkeep.llm import decontaminate as dc


def words(text):
    return [w for w in re.split(r"[^0-9a-zéß]+", (text or "").lower()) if w]


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items, threshold=0.8):
    out = {}
    for doc_id, text in docs:
        w = words(text)
        s = shingles(w)
        for item_id, item in items:
            v = words(item)
            c, n = Counter(shingles(v)), len(v)
            best = 0.0
            if not c.keys() & set(s):
                continue
            for at in range(max(1, len(w) - n + 1)):
                part = Counter(s[at : at + max(0, min(n, len(w)) - 4)])
                both = sum((part & c).values())
                if both:
                    best = max(best, both / (sum(part.values()) + sum(c.values()) - both))
            if best >= threshold:
                out[doc_id, item_id] = round(best, 9)
    return out


def cases():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, text(rng.randint(20, 90))) for i in range(12)] + [(100, ["ha"] * 30), (101, text(3)), (102, [])]
    docs = [(i, text(rng.randint(5, 300))) for i in range(30)]
    for i in range(12):
        item = list(items[i][1])
        if i % 3 == 1:
            item[len(item) // 2] = "changed"
        if i % 3 == 2:
            item.insert(2, "added")
        docs.append((50 + i, text(rng.randint(0, 60)) + item + text(rng.randint(0, 60))))
        docs.append((80 + i, item[: len(item) // 2]))
    docs.append((200, text(20) + ["ha"] * 45 + text(4)))
    docs.append((201, items[0][1][:-2]))
    return [(d, " ".join(t).upper() + ".") for d, t in docs], [(i, ", ".join(t)) for i, t in items]


def test_pairs_equal_brute_force(spark, monkeypatch):
    docs, items = cases()
    expected = brute(docs, items)
    assert len(expected) >= 10
    d = spark.createDataFrame([(*x, "y", 1) for x in docs], "doc_id long, text string, size string, start int")
    i = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    for rows in (1_000_000, 100):  # also with several passes over the documents
        monkeypatch.setattr(dc, "SHINGLE_ROWS", rows)
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.contaminated(d, i).collect()}
        assert got == expected
    left = dc.clean(d, i)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {x[0] for x in docs} - {k[0] for k in expected}


def test_items_in_another_order_are_found(spark):
    rng = random.Random(2)
    docs, items = [], []
    for i, n in enumerate((59, 60, 70, 84, 90)):
        item = [f"i{i}w{j}" for j in range(n)]
        half = n // 2
        around = [[f"d{rng.randrange(10**6)}" for _ in range(rng.randint(60, 90))] for _ in range(2)]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(around[0] + item[half:] + item[:half] + around[1])))  # swapped halves
        docs.append((50 + i, " ".join(item[half:] + item[:half])))
        docs.append((100 + i, " ".join(around[0] + item[half:] + around[1])))  # one half is not enough
    expected = brute(docs, items)
    assert {k[0] for k in expected} == {x + i for i in range(5) for x in (0, 50)}
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.contaminated(d, i).collect()} == expected


def test_similarity_counts_repeats(spark):
    row = spark.createDataFrame([([1, 1, 1, 2, 3], [1, 1, 2, 2, 4])], "a array<long>, b array<long>").select(dc.similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert row.s == 3 / 7


def test_nulls_repeats_and_empty_tables(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item), (1, None), (1, item), (1, item), (1, "other text"), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) == (1, 7) for r in dc.contaminated(docs, items).collect())
    assert len(got) == 4  # two ids (null and 1) by two item ids (7 and null)
    assert sorted((r.doc_id, r.text or "") for r in dc.clean(docs, items).collect()) == [(1, ""), (1, "other text"), (2, "")]
    assert dc.contaminated(docs, items.where(F.lit(False))).collect() == []
    assert dc.clean(docs, items.where(F.lit(False))).count() == 6
    assert dc.contaminated(docs.where(F.lit(False)), items).collect() == []
