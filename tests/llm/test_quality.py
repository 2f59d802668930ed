import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerkeep.llm import quality
from ledgerkeep.sources.tables import table


def corpus(spark, n=240):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(rng.integers(20, 80))]
        good = i % 5 != 0
        rows.append((i, " ".join(words) if good else " | ".join(words).upper() + "!!", "s", 0.5))
        if i % 2:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, known string, score double"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 240
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.predicted == (r.doc_id % 5 != 0) for r in rows if r.held_out]
    assert sum(held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_have_no_influence(spark):
    docs, labels = corpus(spark, 90)
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: round(r.score, 6) for r in quality.quality_scores(docs, labels).collect()}
    b = {r.doc_id: round(r.score, 6) for r in quality.quality_scores(docs, turned).collect()}
    assert a == b


def test_risk_falls_and_stays_nonnegative(spark):
    docs, labels = corpus(spark)
    rows = quality.with_labels(quality.extract(docs, "doc_id"), labels)
    model = quality.train(rows)
    assert model.risks[-1] < 0.2 * model.risks[0] and min(model.risks) >= 0
    assert abs(model.prior - 0.8) < 0.15


def test_edges(spark):
    docs, labels = corpus(spark, 30)
    odd = spark.createDataFrame([(500, None, "a", 1.0), (501, "", "a", 1.0), (None, "abc def", "a", 1.0), (1, "abc " * 50_000, "a", 1.0), (1, "x", "a", 1.0)], docs.schema)
    more = labels.union(spark.createDataFrame([(None, 1), (1, None), (1, 0), (3, 1), (3, 0)], labels.schema))
    rows = quality.quality_scores(docs.union(odd), more).collect()
    assert len(rows) == 35 and all(r.score is not None for r in rows)
    kept = quality.good(docs.union(odd), more)
    assert kept.columns == docs.columns and kept.count() <= 35
    none = docs.where(F.lit(False))
    assert quality.quality_scores(none, labels).collect() == []
    assert {r.score for r in quality.quality_scores(docs, labels.where(F.lit(False))).collect()} == {0.5}
    assert quality.good(none, labels).collect() == []


def test_query_on_the_driver_tables(spark):
    from ledgerkeep.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    found = QUERIES["op6_quality_classifier"](spark, folder).join(table(spark, folder, "labels", "doc_id", "quality"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)


def brute_features(text):
    """The measures of a text by plain loops."""
    raw = (text or "").encode()
    out = [0.0] * quality.DIMENSIONS
    if not raw:
        return out
    for c in range(128):
        out[c] = math.sqrt(sum(b == c for b in raw) / len(raw))
    out[128] = math.sqrt(sum(b > 127 for b in raw) / len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    letters = max(1, sum(chr(b).isalpha() for b in raw if b < 128))
    upper = sum(65 <= b <= 90 for b in raw)
    top = max((words.count(w) for w in words), default=0)
    out[129:] = [
        math.log(1 + len(raw)), math.log(1 + n), len(raw) / n / 10, len(set(words)) / n, top / n,
        sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n, len(set(lines)) / len(lines), upper / letters, math.log(1 + len(lines)),
    ]
    return out


def test_features_equal_plain_loops():
    rng = np.random.default_rng(8)
    for text in [None, "", " ", "\n\n", "É é É", "a a a\nb\nb", "Of. of. OF!!"] + ["".join(rng.choice(list("abAB .\n!é|"), 80)) for _ in range(40)]:
        assert np.allclose(quality.features((text or "").encode()), brute_features(text), atol=1e-6)


def test_training_equals_a_plain_fit_with_numerical_gradients(spark):
    """The same steps on a risk written out row by row, its gradient taken by differences."""
    docs, labels = corpus(spark, 60)
    rows = quality.with_labels(quality.extract(docs, "doc_id"), labels).repartition(3)
    model = quality.train(rows, steps=6)
    told = [(np.frombuffer(r["__x"], dtype="<f4").astype(float), r["known"]) for r in rows.collect()]
    x, known = np.array([t[0] for t in told]), [t[1] for t in told]
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-4] = 1.0
    marked = [k for k in known if k is not None]
    q = sum(marked) / len(marked)
    z = [[*np.clip((row - mean) / scale, -8, 8), 1.0] for row in x]
    used = [k for k in range(len(z[0])) if any(abs(row[k]) > 0 for row in z)]

    def loss(s):
        return math.log(1 + math.exp(-s)) if s > -30 else -s

    def risks(w):
        s = [sum(row[k] * w[k] for k in used) for row in z]
        positive = [v for v, k in zip(s, known) if k == 1]
        trusted = q * sum(map(loss, positive)) / len(positive)
        return trusted, sum(loss(-v) for v in s) / len(s) - q * sum(loss(-v) for v in positive) / len(positive)

    w = np.zeros(quality.DIMENSIONS + 1)
    w[-1] = math.log(q / (1 - q))
    velocity, square = np.zeros_like(w), np.zeros_like(w)
    seen = []
    for step in range(1, 7):
        trusted, negative = risks(w)
        seen.append(trusted + max(0.0, negative))
        grad = np.zeros_like(w)
        for k in used:
            up, down = w.copy(), w.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            a, b = risks(up), risks(down)
            grad[k] = (a[0] - b[0] + a[1] - b[1]) / 2e-5 if negative >= 0 else -(a[1] - b[1]) / 2e-5
        grad[:-1] += quality.RIDGE * w[:-1]
        velocity, square = 0.9 * velocity + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w = w - quality.STEP_SIZE * min(1.0, 2 - 2 * step / 7) * (velocity / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    assert np.allclose(model.risks, seen, atol=1e-3) and abs(model.prior - q) < 1e-12
    own = [1 / (1 + math.exp(-sum(a * b for a, b in zip(row, w)))) for row in z]
    assert np.allclose(model.score(x), own, atol=0.02)
