"""Portable hashes: bucket of a token, seeded draws, content ids, the hashed bag of words."""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkeep.functions.text import tokens

# Fixed values of the lexical test vectors.
DIMENSION = 256
MIN_NORM = 1e-12
ID_PREFIX = "mem_"
ID_HEX = 32


def token_bucket(token: Column) -> Column:
    """First four bytes of sha256 modulo 256; 256 divides 2**32, so the fourth byte decides."""
    return F.conv(F.substring(F.sha2(token, 256), 7, 2), 16, 10).cast("int")


def seeded_unit(*parts: Column) -> Column:
    """A draw in [0, 1) from the md5 of the parts; the same in any SQL engine."""
    return draw32(*parts) / F.lit(4294967296.0)


def draw32(*parts: Column) -> Column:
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def content_id(canonical: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), F.substring(F.sha2(canonical, 256), 1, ID_HEX))


def bucket_weights(text: Column) -> Column:
    """Used buckets of a text in order with their weights, scaled to unit length: array of (bucket, weight).

    A text is one row anyway, so its tokens are counted inside the row, from the sorted buckets in one pass.
    """
    start = F.struct(F.array().cast("array<struct<bucket:int,hits:bigint>>").alias("done"), F.lit(-1).alias("bucket"), F.lit(0).cast("long").alias("hits"))

    def closed(run: Column) -> Column:
        return F.when(run.hits > 0, F.concat(run.done, F.array(F.struct(run.bucket.alias("bucket"), run.hits.alias("hits"))))).otherwise(run.done)

    def step(run: Column, bucket: Column) -> Column:
        same = bucket == run.bucket
        return F.struct(
            F.when(same, run.done).otherwise(closed(run)).alias("done"),
            bucket.alias("bucket"),
            F.when(same, run.hits + 1).otherwise(F.lit(1).cast("long")).alias("hits"),
        )

    counts = F.aggregate(F.array_sort(F.transform(tokens(text), token_bucket)), start, step, closed)
    # lambdas bind the counts and their norm, so that each is computed once
    with_norm = F.transform(
        F.array(counts),
        lambda c: F.struct(c.alias("c"), F.greatest(F.sqrt(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x.hits * x.hits)), F.lit(MIN_NORM)).alias("norm")),
    )
    scaled = F.transform(with_norm, lambda w: F.transform(w.c, lambda e: F.struct(e.bucket.alias("bucket"), (e.hits / w.norm).alias("weight"))))
    return F.element_at(scaled, 1)


def bag_of_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse hashed vectors: one row (key, bucket, weight) per used bucket. No shuffle: ``key`` is unique."""
    # outer, because Spark would put a filter below an inner explode and count every text twice
    rows = df.select(key, F.explode_outer(bucket_weights(F.col(text))).alias("e"))
    return rows.where(F.col("e").isNotNull()).select(key, F.col("e.bucket").alias("bucket"), F.col("e.weight").alias("weight"))


#: ``TOKEN_PATTERN`` on UTF-8 bytes. Tokens of a text taken at once from there on; tokens that a worker remembers.
_TOKENS = re.compile(rb"[a-z0-9]+|\xe4[\xb8-\xbf][\x80-\xbf]|[\xe5-\xe9][\x80-\xbf]{2}")
LONG_TEXT, TOKENS_AT_ONCE, REMEMBERED = 1 << 20, 1 << 16, 1 << 19


class _Buckets(dict):
    """``token_bucket`` of the tokens seen so far."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = bucket = hashlib.sha256(token).digest()[3]
        return bucket


_buckets = _Buckets()


def _hits(lowered: bytes | None) -> np.ndarray:
    """How many tokens fall on each bucket; a long text is taken piece by piece."""
    lowered = lowered or b""
    if len(lowered) <= LONG_TEXT:
        found = bytes(map(_buckets.__getitem__, _TOKENS.findall(lowered)))
        return np.bincount(np.frombuffer(found, dtype=np.uint8), minlength=DIMENSION)
    hits, tokens_left = np.zeros(DIMENSION, dtype=np.int64), _TOKENS.finditer(lowered)
    while found := bytes(_buckets[m[0]] for m in islice(tokens_left, TOKENS_AT_ONCE)):
        hits += np.bincount(np.frombuffer(found, dtype=np.uint8), minlength=DIMENSION)
    return hits


def dense_vector(text: Column) -> Column:
    """Dense unit vector of a text; without tokens the zero vector. A worker hashes each token once and remembers it."""

    @F.arrow_udf("array<double>")
    def run(lowered: pa.Array) -> pa.Array:
        hits = [_hits(x) for x in lowered.cast(pa.large_binary()).to_pylist()]
        counts = np.array(hits, dtype=np.int64).reshape(-1, DIMENSION)
        norms = np.maximum(np.sqrt((counts * counts).sum(axis=1)), MIN_NORM)
        flat = pa.array((counts / norms[:, None]).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * DIMENSION), flat)

    return run(F.lower(text))


def dense_vectors(df: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """Dense unit vectors (key, vector), after the key the columns ``others``."""
    return df.select(key, *others, dense_vector(F.col(text)).alias("vector"))
