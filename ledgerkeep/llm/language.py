"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of order ``ORDER``: for every context of up to that many bytes, how often each byte
followed it. The code length of a byte under frozen statistics is exact: in a context of n followers, d of them
distinct, a byte seen c times costs -log2(c / (n + d)); else the escape costs -log2(d / (n + d)) and the next shorter
context is asked; a context never seen passes on for free, and below the empty context every byte costs 8 bits. A text
belongs to the language that codes it shortest.

The trees are counted from a sample of labelled texts whose bytes are bounded by ``TRAIN_BYTES`` over all languages, so
that the model has a bound too. Whole texts are scored: a task costs each distinct string of ORDER + 1 bytes of a batch
once per language, then adds the costs up per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkeep.llm.common import binary, slices
from ledgerkeep.llm.quality import held_out

ORDER = 4
#: Bytes of training text over all languages.
TRAIN_BYTES = 6 << 20
UNKNOWN = "und"
#: Bytes scored at once.
SLICE = 2 << 20


def grams(text: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each position, as integers with the last byte lowest; only full ones."""
    n = len(text) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.int64)
    for i in range(size):
        out = (out << 8) | text[i : i + n]
    return out


@dataclass
class Tree:
    """Sorted contexts and followers of each order: keys, and their counts."""

    followed: list[tuple[np.ndarray, np.ndarray]]  # by order: context + byte, times seen
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by order: context, followers, distinct followers

    @classmethod
    def of(cls, counts: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
        followed, contexts = [], []
        for keys, seen in counts:
            order = np.argsort(keys)
            keys, seen = keys[order], seen[order]
            context, start = np.unique(keys >> 8, return_index=True)
            total = np.add.reduceat(seen, start) if len(seen) else seen
            followed.append((keys, seen))
            contexts.append((context, total, np.diff(np.append(start, len(keys)))))
        return cls(followed, contexts)

    def bits(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code length of the lowest byte of each key after its ``order`` bytes of context."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for k in range(order, -1, -1):
            if not len(left):
                break
            key = keys[left] & ((1 << (8 * (k + 1))) - 1)
            context, total, distinct = self.contexts[k]
            if not len(context):
                continue
            at = np.minimum(np.searchsorted(context, key >> 8), len(context) - 1)
            known = context[at] == key >> 8
            n, d = total[at], distinct[at]
            follow, seen = self.followed[k]
            to = np.minimum(np.searchsorted(follow, key), len(follow) - 1)
            hit = known & (follow[to] == key)
            out[left[hit]] -= np.log2(seen[to[hit]] / (n[hit] + d[hit]))
            escape = known & ~hit
            out[left[escape]] -= np.log2(d[escape] / (n[escape] + d[escape]))
            left = left[~hit]
        out[left] += 8.0
        return out


def count(labelled: DataFrame, bound: int = TRAIN_BYTES) -> dict[str, Tree]:
    """Context trees of each language of ``labelled`` (doc_id, text, lang), from about ``bound`` bytes of whole texts.

    Each language has an equal share of the bound; where it has more text, rows are taken by the hash of their id and
    text. Rows without language or text are not used.
    """
    known = labelled.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not sizes:
        return {}
    share = {lang: min(1.0, bound / len(sizes) / max(1, n)) for lang, n in sizes.items()}
    limit = F.element_at(F.create_map(*(F.lit(x) for lang, s in share.items() for x in (lang, int(s * (1 << 30))))), F.col("lang"))
    some = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), binary(batch, "text")):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for k in range(ORDER + 1):
                    parts = [grams(np.frombuffer(t, dtype=np.uint8), k + 1) for t in texts]
                    keys, seen = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), k), pa.int32()), pa.array(keys), pa.array(seen.astype(np.int64))],
                        ["lang", "k", "gram", "n"],
                    )

    counted = some.select("lang", "text").mapInArrow(run, "lang string, k int, gram long, n long")
    table = counted.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas()
    trees = {}
    for lang in sorted(sizes):
        own = table[table["lang"] == lang]
        trees[lang] = Tree.of([(own["gram"].to_numpy()[own["k"] == k], own["n"].to_numpy()[own["k"] == k]) for k in range(ORDER + 1)])
    return trees


def lengths(texts: list[bytes], trees: list[Tree]) -> np.ndarray:
    """Code lengths in bits, texts x languages."""
    out = np.zeros((len(texts), len(trees)))
    sizes = np.array([len(t) for t in texts])
    body, owner = [], []
    for i, t in enumerate(texts):
        raw = np.frombuffer(t, dtype=np.uint8)
        for k in range(min(ORDER, len(raw))):  # the first bytes have shorter contexts
            head = grams(raw[: k + 1], k + 1)
            out[i] += [tree.bits(head, k)[0] for tree in trees]
        body.append(grams(raw, ORDER + 1))
    counts = np.maximum(sizes - ORDER, 0)
    if not counts.any():
        return out
    keys, back = np.unique(np.concatenate(body), return_inverse=True)
    owner = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[owner]
    for j, tree in enumerate(trees):
        out[owner, j] += np.add.reduceat(tree.bits(keys, ORDER)[back], starts)
    return out


def identify(docs: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text).

    The score is the posterior of the shortest coding language, all languages being as likely beforehand; ties go to
    the first in order. A text that is null or holds no letter is ``und`` with score zero, as is any text if no
    language was learned. Repeated rows stay.
    """
    names = sorted(trees)
    models = docs.sparkSession.sparkContext.broadcast([trees[n] for n in names])  # bounded by TRAIN_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            texts = binary(batch, "text")
            letters = np.array([any(map(str.isalpha, t.decode("utf-8"))) for t in texts], dtype=bool)
            best, score = np.zeros(len(texts), dtype=int), np.zeros(len(texts))
            rows = np.flatnonzero(letters) if names else np.zeros(0, dtype=int)
            if len(rows):
                bits = lengths([texts[i] for i in rows], models.value)
                best[rows] = bits.argmin(1)
                score[rows] = 1.0 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
            told = [names[b] if ok and names else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(told, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, bound: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score of ``docs`` (doc_id, text, lang), learned from the rows not held out."""
    trees = count(docs.where(~held_out(F.col("doc_id"))), bound)
    found = identify(docs, trees)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
