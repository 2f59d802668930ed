"""Soft-membership mixing of documents to target domain weights.

A naive Bayes classifier over hashed words, fitted on a labelled table, gives each document a posterior over the
domains. A document of t words and posterior p adds r * t * p[k] expected words to domain k at rate r. The rates
minimise the squared distance between the expected totals and the targets by projected gradient steps, with the
totals' distance weighted by the inverse of sum(t * p * p'), which makes the unit step safe and the steps few.

A step needs only the K residuals: ``rate = greatest(least, rate - p . g)``. So each round is one aggregate over the
written posteriors and rates, with the latest steps as one generated expression; K numbers a round reach the driver.
The rates are written anew after every ``DEPTH`` steps, so expressions stay small and a lost executor costs a re-read.
Only DataFrame functions are used.
"""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkeep.llm.common import lower_ascii, stage

#: Word buckets of the classifier.
BUCKETS = 4096
#: About so many labelled rows fit the classifier; more are thinned by the hash of their id.
LABELLED = 20_000
#: Words' evidence beyond this many is scaled down: neighbouring words are not independent, and memberships stay soft.
EVIDENCE = 32
#: Of all words: how near the totals must come to the targets.
TOLERANCE = 1e-5
ROUNDS = 40
#: Steps in one generated expression before the rates are written.
DEPTH = 6
#: Added to the smallest total under a least rate, because documents that share in two domains leave less room.
HEADROOM = 0.05


def _buckets(text: Column) -> Column:
    split = F.split(F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")), " ")
    return F.transform(F.array_remove(split, ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit(labelled: DataFrame, domains: list[str], rows: int = LABELLED) -> tuple[list[float], list[list[float]]]:
    """Log priors and log word-bucket probabilities per domain, from ``labelled`` (doc_id, text, domain).

    Rows of other domains, or of none, are not used. A domain without rows gets the smoothed uniform distribution. At
    most BUCKETS counts per domain reach the driver.
    """
    known = labelled.where(F.col("domain").isin(domains))
    share = rows / max(rows, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = known.select("domain", _buckets(F.col("text")).alias("ids")).select("domain", F.explode_outer("ids").alias("id")).where("id is not null").groupBy("domain", "id").count()
    sizes = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    table = {d: np.ones(BUCKETS) for d in domains}
    for r in counts.collect():
        table[r.domain][r.id] += r["count"]
    total = sum(sizes.values())
    priors = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    return priors, [np.log(table[d] / table[d].sum()).tolist() for d in domains]


def posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``__tokens`` (words), ``__draw`` in [0, 1) and one posterior ``__p<k>`` per domain."""
    priors, logs = model
    low = F.xxhash64("doc_id", "text", F.lit("draw"))
    ids = docs.select(*keep, (F.pmod(low, F.lit(1 << 30)) / (1 << 30)).alias("__draw"), _buckets(F.col("text")).alias("__ids"))
    tables = [F.from_json(F.lit(json.dumps(x)), "array<double>") for x in logs]

    def total(table: Column) -> Column:
        return F.aggregate("__ids", F.lit(0.0), lambda a, i: a + F.get(table, i))

    sums = [total(t) for t in tables]
    scale = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.size("__ids"), F.lit(1)))
    scored = ids.select(*keep, "__draw", F.size("__ids").cast("long").alias("__tokens"), *((F.lit(b) + s * scale).alias(f"__s{k}") for k, (b, s) in enumerate(zip(priors, sums))))
    names = [f"__s{k}" for k in range(len(priors))]
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    risen = scored.select(*keep, "__draw", "__tokens", *(F.exp(F.col(n) - top).alias(n) for n in names))
    whole = reduce(lambda a, b: a + b, (F.col(n) for n in names))
    return risen.select(*keep, "__draw", "__tokens", *((F.col(n) / whole).alias(f"__p{k}") for k, n in enumerate(names)))


def _rate(steps: list[np.ndarray], least: float) -> Column:
    rate = F.col("__rate")
    for g in steps:
        move = reduce(lambda a, b: a + b, (F.col(f"__p{k}") * float(x) for k, x in enumerate(g)))
        rate = F.greatest(F.lit(float(least)), rate - move)
    return rate


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    least: float = 0.0,
    total: float | None = None,
    keep: list[str] | None = None,
    rounds: int = ROUNDS,
    prefix: str = "",
) -> DataFrame:
    """Rates and copies of every row of ``docs`` such that expected domain totals meet ``weights``.

    ``docs`` has doc_id and text; ``labelled`` has doc_id, text and domain; ``weights`` maps domains to shares. Rates
    are at least ``least``. ``total`` is the words to reach; by default the present total, or with ``least`` a little
    (HEADROOM) over the smallest at which rates of ``least`` leave no domain above its target. ``keep`` names the columns carried along (default: all).
    Adds ``tokens``, ``p_<domain>``, ``rate`` and ``copies`` (rate rounded up or down by a draw from the row's hash, so
    that it holds on average), each name after ``prefix``; a carried column of such a name gives way to it. If the targets cannot be met, the rates are the least-squares ones.

    A null or empty text has the prior as posterior and adds no words. Repeated rows get equal rates. Empty tables give
    an empty result.
    """
    domains = sorted(weights)
    made = {prefix + n for n in ("tokens", "rate", "copies", *(f"p_{d}" for d in domains))}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    share = np.array([weights[d] for d in domains], dtype=float)
    if not domains or (share < 0).any() or share.sum() <= 0:
        raise ValueError("weights must be nonnegative and not all zero")
    share = share / share.sum()
    model = fit(labelled, domains)
    whole = posteriors(docs, model, keep)
    # texts are not written a second time: with them among the carried columns, posteriors are computed twice instead
    scored = stage(whole if "text" not in keep else posteriors(docs, model, []), "posteriors")
    whole = whole if "text" in keep else scored
    size = len(domains)
    p = [F.col(f"__p{k}") for k in range(size)]
    t = F.col("__tokens")
    first = scored.agg(*(F.sum(t * p[k]) for k in range(size)), *(F.sum(t * p[k] * p[j]) for k in range(size) for j in range(k, size))).first()
    mass = np.array([x or 0.0 for x in first[:size]], dtype=float)
    gram = np.zeros((size, size))
    for (k, j), x in zip(((k, j) for k in range(size) for j in range(k, size)), first[size:]):
        gram[k, j] = gram[j, k] = x or 0.0
    if total is None:
        lowest = max((least * m / s for m, s in zip(mass, share) if s > 0), default=0.0)
        total = float(lowest * (1 + HEADROOM)) if least > 0 else float(mass.sum())
    target, start = share * total, F.lit(max(1.0, least)).alias("__rate")
    steps: list[np.ndarray] = []
    if mass.sum() > 0:
        inverse = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
        reached = mass * max(1.0, least)
        narrow, waiting = scored.select("__tokens", *(f"__p{k}" for k in range(size)), start), []
        for _ in range(rounds):
            if np.abs(reached - target).max() <= TOLERANCE * max(total, 1.0):
                break
            steps.append(inverse @ (reached - target))
            waiting.append(steps[-1])
            moved = narrow.withColumn("__rate", _rate(waiting, least))
            if len(waiting) == DEPTH:
                narrow = moved = stage(moved, "rates")
                waiting = []
            sums = moved.agg(*(F.sum(F.col("__rate") * t * p[k]) for k in range(size))).first()
            before, reached = reached, np.array(sums, dtype=float)
            if np.abs(reached - before).max() <= TOLERANCE * 0.1 * max(total, 1.0):
                break  # no rate moves any more: the least-squares point
    rate = _rate(steps, least)
    named = whole.select("*", start).select(*keep, "__draw", t.alias(f"{prefix}tokens"), *(p[k].alias(f"{prefix}p_{d}") for k, d in enumerate(domains)), rate.alias(f"{prefix}rate"))
    # the row number, times zero, keeps filters on the copies above this step: below it they would repeat the classifier
    same = F.lit(0).cast("long") * F.monotonically_increasing_id()
    return named.withColumn(f"{prefix}copies", F.floor(F.col(f"{prefix}rate") + F.col("__draw")).cast("long") + same).drop("__draw")


def repeat(mixed: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """Each row as often as its ``copies`` say, with ``columns`` only."""
    n = F.col(copies).cast("int")
    return mixed.where(n > 0).select(*columns, F.explode(F.sequence(F.lit(1), n)).alias("__n")).select(*columns)
