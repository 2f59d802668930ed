"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled 1; all other training texts count as unlabelled web text. With class prior q, logistic
loss l and a linear score s the risk is

    q * mean_P l(s)  +  max(0, mean_U l(-s) - q * mean_P l(-s))  +  ridge

The second term estimates the risk on negatives; where it turns negative the model fits noise, and the step goes
against that term's gradient instead, as the non-negative estimator asks. Risks and gradients are sums over all
training rows: each step is one pass over the written features, in which a task emits one partial sum per dimension.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkeep.llm.common import binary, slices, stage

#: Byte classes: each ASCII byte, and one for all others; then the measures of ``features``.
CLASSES = 129
MEASURES = 9
DIMENSIONS = CLASSES + MEASURES
STEPS = 40
STEP_SIZE = 0.1
RIDGE = 1e-2

_CLASS = np.minimum(np.arange(256), 128)


def features(text: bytes) -> np.ndarray:
    """Shape of a whole text: root frequencies of its byte classes, length, word and line repetition."""
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=CLASSES) / len(text)
    out[:CLASSES] = np.sqrt(share)
    words = text.split()
    n = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    twice = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split(b"\n")
    letters = max(1, counts[65:91].sum() + counts[97:123].sum())
    top = max(seen.values(), default=0)
    out[CLASSES:] = (
        math.log1p(len(text)), math.log1p(n), len(text) / n / 10, len(seen) / n, top / n, twice / n,
        len(set(lines)) / len(lines), counts[65:91].sum() / letters, math.log1p(len(lines)),
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float
    risks: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: a third, by the checksum of the id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def extract(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``__x``, the features of the whole text as little-endian 32-bit floats."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["__x binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [features(t).tobytes() for t in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.binary())], [*names, "__x"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("__x").to_pylist()), dtype="<f4").reshape(-1, DIMENSIONS).astype(np.float64)


def _sums(rows: DataFrame, size: int, part) -> np.ndarray:
    """Sum over all rows of the vectors that ``part`` makes of a batch: one row per task and dimension, added by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    each = rows.mapInArrow(run, "i int, v double")
    out = np.zeros(size)
    for r in each.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def train(labelled: DataFrame, prior: float | None = None, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Fit on ``labelled``: ``__x``, ``known`` (1 trusted positive, 0 labelled otherwise, null unlabelled).

    Only the positives' labels enter the risk. Without ``prior`` the class prior is the share of 1 among labelled
    rows, which estimates it if rows are labelled at random. Without positives, or without rows, every score is the
    prior (one half if unknown).
    """
    d = DIMENSIONS

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        known = batch.column("known").to_pandas().to_numpy(dtype=float)
        return np.concatenate([x.sum(0), (x * x).sum(0), [len(x), np.nansum(known), np.isfinite(known).sum()]])

    sums = _sums(labelled, 2 * d + 3, moments)
    n, positive, marked = sums[2 * d :]
    mean = sums[:d] / max(n, 1)
    scale = np.sqrt(np.maximum(sums[d : 2 * d] / max(n, 1) - mean**2, 0))
    scale[scale < 1e-4] = 1.0
    q = prior if prior is not None else (positive / marked if marked else 0.5)
    start = math.log(q / (1 - q)) if 0 < q < 1 else 0.0
    model = Model(mean, scale, np.zeros(d), start, q)
    if not positive or n == positive or not 0 < q < 1:
        return model

    def gradients(w: np.ndarray):
        def part(batch: pa.RecordBatch) -> np.ndarray:
            x = np.hstack([np.clip((_matrix(batch) - mean) / scale, -8, 8), np.ones((batch.num_rows, 1))])
            p = batch.column("known").to_pandas().to_numpy(dtype=float) == 1
            s = x @ w
            up, sig = np.logaddexp(0, s), 1 / (1 + np.exp(-np.clip(s, -60, 60)))
            return np.concatenate([
                x[p].T @ (sig[p] - 1), x[p].T @ sig[p], x.T @ sig,  # gradients of l(s) and l(-s) on P, of l(-s) on all
                [(up[p] - s[p]).sum(), up[p].sum(), up.sum()],
            ])

        return part

    w = np.append(np.zeros(d), start)
    keep = np.append(np.full(d, ridge), 0.0)
    velocity, square, rate = np.zeros(d + 1), np.zeros(d + 1), STEP_SIZE
    for step in range(1, steps + 1):
        g = _sums(labelled, 3 * d + 6, gradients(w))
        parts = [g[k * (d + 1) : (k + 1) * (d + 1)] for k in range(3)]
        lp, lpn, lun = g[3 * (d + 1) :]
        negative = lun / n - q * lpn / positive
        slope = parts[2] / n - q * parts[1] / positive
        grad = q * parts[0] / positive + slope if negative >= 0 else -slope
        grad = grad + keep * w
        model.risks.append(q * lp / positive + max(0.0, negative))
        velocity = 0.9 * velocity + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        size = rate * min(1.0, 2.0 - 2.0 * step / (steps + 1))
        w = w - size * (velocity / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model.weight, model.bias = w[:d], float(w[d])
    return model


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (``__x``, ``known``) of features ``rows`` (doc_id, __x) and ``labels`` (doc_id, quality).

    Held-out rows take no part at all. A document with several labels counts as positive if one of them is 1.
    """
    told = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("known"))
    return rows.where(~held_out(F.col("doc_id"))).join(told, "doc_id", "left").select("__x", "known")


def scored(rows: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """The columns ``keep`` of feature rows, and their score as column ``name``."""
    fields = [f for f in rows.schema.fields if f.name in keep]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], [*names, name])

    return rows.select(*names, "__x").mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text), learned with ``labels``.

    Null and empty texts have the all-zero features and get a score like any other. Repeated rows get equal scores.
    """
    rows = stage(extract(docs, "doc_id"), "features")
    model = train(stage(with_labels(rows, labels), "training"), prior)
    found = scored(rows, model, "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """The rows of ``docs`` that score at least one half, with the columns of ``docs``.

    Features are read from the texts twice, so that no second copy of the texts is written.
    """
    rows = stage(extract(docs.select("doc_id", "text"), "doc_id"), "features")
    model = train(stage(with_labels(rows, labels), "training"), prior)
    return scored(extract(docs, *docs.columns), model, *docs.columns, name="__score").where("__score >= 0.5").select(*docs.columns)
