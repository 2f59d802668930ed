"""Phrase collocations from Rabin-Karp fingerprints.

Every run of words gets a fingerprint from numpy prefix polynomials (``rolling``). The shuffle adds up counts by
fingerprint, level by level: a run is counted only if both runs one word shorter may be frequent, which a bit table of
fixed size tells (it errs on the side of counting). Runs whose fingerprint is frequent keep a pointer to an occurrence in
the task's buffer; the other occurrences are verified against its text word by word, and only these phrases become
strings. Counts are then added by language and text, so neither colliding fingerprints nor the bit table change them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerkeep.llm.common import binary, freed, slices, stage
from ledgerkeep.llm.rolling import Words, bit_table, cuts, holds, mixed, opened

BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bytes of text that are hashed at once (a longer text is cut between words), and fingerprints that a task adds up before it hands them on.
BUFFER, HELD = 2 << 20, 1 << 21
#: Salts of the first of two rankings, so that no task holds all phrases of a language.
SALTS = 64


def _buffers(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[Words, int, np.ndarray, list[str]]]:
    """Words of a buffer, how many bytes of it are its own, the language number of each word, and the languages."""
    for batch in slices(batches, "text", BUFFER):
        texts = binary(batch, "text")
        langs = [x if x is not None else "und" for x in batch.column("lang").to_pylist()]
        if len(texts) == 1:
            parts = [(piece + b"\n", own) for piece, own in cuts(texts[0], words, BLANKS + BREAKS, BUFFER)]
        else:
            joined = b"\n".join(texts) + b"\n"
            parts = [(joined, len(joined))]
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs], dtype=np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        for buffer, own in parts:
            found = Words(buffer, BLANKS, BREAKS)
            of = np.zeros(len(found.fp), dtype=np.int64) + number[0] if len(texts) == 1 else number[np.searchsorted(ends, found.begin, "right")]
            yield found, own, of, names


def _places(found: Words, own: int, of: np.ndarray, names: list[str], tables: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys (fingerprints with the language) of the runs of n words whose shorter runs may be frequent."""
    salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in names], dtype=np.uint64)
    fine = None
    for size in range(1, n + 1):
        at, fp = found.grams(size)
        if fine is not None:
            keep = fine[at] & fine[at + 1]
            at, fp = at[keep], fp[keep]
        keys = mixed(fp ^ salt[of[at]])
        if size < n:
            fine = np.zeros(len(found.fp) + 1, dtype=bool)
            fine[at] = holds(tables[size - 1], keys)
    mine = found.begin[at] < own
    return at[mine], keys[mine]


def _count(docs: DataFrame, n: int, words: int, given: list[Broadcast]) -> DataFrame:
    """key, c: occurrences of each fingerprint of n words in a buffer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = opened(given)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> Iterator[pa.RecordBatch]:
            keys, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            counts = np.add.reduceat(counts, first) if len(first) else counts
            keys = keys[first]
            for i in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 17)].view(np.int64)), pa.array(counts[i : i + (1 << 17)])], ["key", "c"])

        for found, own, of, names in _buffers(batches, words):
            held.append(np.unique(_places(found, own, of, names, tables, n)[1], return_counts=True))
            if sum(len(h[0]) for h in held) >= HELD:
                yield from summed()
        if held:
            yield from summed()

    return docs.mapInArrow(run, "key long, c long")


def _bytes(found: Words, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes of the ranges [first, first + length), one after the other."""
    ends = np.cumsum(lengths)
    return found.bytes[np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _word_ids(found: Words) -> np.ndarray:
    """A number for each distinct word of a buffer: by fingerprint, verified against the text of its first place."""
    _, first, ids = np.unique(found.fp, return_index=True, return_inverse=True)
    lengths = found.end - found.begin
    pointed = first[ids]
    same = lengths == lengths[pointed]
    here = np.flatnonzero(same)
    differ = _bytes(found, found.begin[here], lengths[here]) != _bytes(found, found.begin[pointed[here]], lengths[here])
    if differ.any():
        same[here[np.repeat(np.arange(len(here)), lengths[here])[differ]]] = False
    other: dict[str, int] = {}
    for i in np.flatnonzero(~same):  # colliding fingerprints: these words are numbered by their text
        ids[i] = other.setdefault(found.text(int(i), 1), len(first) + len(other))
    return ids


def _phrases(found: Words, places: np.ndarray, n: int) -> pa.Array:
    """Texts of runs of n words, joined by single spaces."""
    at = (places[:, None] + np.arange(n)).ravel()
    lengths = found.end[at] - found.begin[at]
    blank = np.tile(np.arange(n) < n - 1, len(places))
    text = _bytes(found, found.begin[at], lengths + blank)
    text[np.cumsum(lengths + blank)[blank] - 1] = 32
    offsets = np.concatenate([[0], np.cumsum((lengths + blank).reshape(-1, n).sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(text.tobytes()))


def _materialise(docs: DataFrame, words: int, given: list[Broadcast]) -> DataFrame:
    """lang, words, phrase, c: counts in a buffer of the runs whose fingerprint may be frequent, by their text.
    A row with zero words has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = opened(given)
        for found, own, of, names in _buffers(batches, words):
            ids = _word_ids(found)
            mine = np.bincount(of[found.begin < own], minlength=len(names))
            yield batch(names, 0, [""] * len(names), mine)
            for n in range(1, words + 1):
                at, keys = _places(found, own, of, names, tables, n)
                keep = holds(tables[n - 1], keys)
                at, keys = at[keep], keys[keep]
                _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                pointer = at[first][inverse]
                wrong = of[at] != of[pointer]
                for k in range(n):
                    wrong |= ids[at + k] != ids[pointer + k]
                if wrong.any():  # other texts than that of the pointer leave its count and are counted by text
                    counts = np.bincount(inverse[~wrong], minlength=len(first))
                    rest = Counter((names[of[i]], found.text(int(i), n)) for i in at[wrong])
                    yield batch([k[0] for k in rest], n, [k[1] for k in rest], list(rest.values()))
                for i in range(0, len(first), 1 << 18):
                    places = at[first[i : i + (1 << 18)]]
                    langs = pa.DictionaryArray.from_arrays(of[places].astype(np.int32), names).cast(pa.string())
                    yield batch(langs, n, _phrases(found, places, n), counts[i : i + (1 << 18)])

    def batch(langs, n: int, phrases, counts) -> pa.RecordBatch:
        sizes = pa.array(np.full(len(counts), n, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), sizes, pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], ["lang", "words", "phrase", "c"])

    return docs.mapInArrow(run, "lang string, words int, phrase string, c long")


def phrase_counts(docs: DataFrame, words: int = 3, least: int = 10) -> DataFrame:
    """lang, words, phrase, f of all runs of up to ``words`` words that occur at least ``least`` times in a language;
    rows with zero words have the number of all words of a language (any number of them)."""
    texts = docs.select("text", "lang")
    given: list[Broadcast] = []
    for n in range(1, words + 1):
        frequent = _count(texts, n, words, given).groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
        given.append(bit_table(frequent))
    counted = _materialise(texts, words, given).groupBy("lang", "words", "phrase").agg(F.sum("c").alias("f"))
    return counted.where(f"words = 0 or f >= {int(least)}")


def _parts(begin: int, size: int) -> Column:
    return F.array_join(F.slice("w", begin + 1, size), " ")


def collocations(docs: DataFrame, words: int = 3, least: int = 10, keep: int = 2000, share: int = 50) -> DataFrame:
    """The ``keep`` phrases of 2 to ``words`` words of each language that score highest: lang, rank, phrase, a, l, r, n, score.

    Only ``text`` and ``lang`` are read. A null text is empty, a null language is ``und`` (and one with an 'und' of the
    table). Repeated rows count each time. Pieces end at punctuation and line feeds; A-Z are lower-cased. The score is the
    least floor(10^6 a^2 / (l r)) over the cuts of a phrase, the smallest cut on ties. A phrase goes if a longer
    candidate holds it with at least ``share`` per cent of its count. Order: score and a descending, phrase ascending in
    UTF-8 byte order. A language without candidates, or an empty table, gives no row.
    """
    with freed(docs.sparkSession):
        counts = stage(phrase_counts(docs, words, least), "phrase-counts")
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.where("words >= 1").select("lang", "words", "phrase", "f")
    found = phrases.where("words >= 2").withColumn("w", F.split("phrase", " "))
    first = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", "words", F.col("f").alias("a"), "k", _parts(0, F.col("k")).alias("head"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("tail"))
    wide = [F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")]
    score = F.expr("cast(1000000 as decimal(38,0)) * a0 * a0 div (l0 * r0)")
    scored = cut.join(first, ["lang", "head"]).join(rest, ["lang", "tail"])
    scored = scored.withColumns(dict(zip(("a0", "l0", "r0"), wide))).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda begin: F.array_join(F.slice("w", begin, size), " ")),
    ))
    held = found.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(held, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {int(share)} * a")
    flat = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = flat.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for group in (["lang", "salt"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    sums = total.groupBy("lang").agg(F.sum("n").alias("n"))
    return salted.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
