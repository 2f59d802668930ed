"""Substring dedup by hashing of normalised units: lines, or the sentences of lines.

A text is cut into units that follow one another without gaps, so a unit is known by its offsets in the original text.
Units are compared with A-Z lower-cased and white space collapsed. Of equal units in all texts the earliest stays, by
(doc_id, row, offset); the others are removed. Units of fewer than ``least_words`` words always stay: short sentences
recur by chance. ``passages`` compares lines and their sentences together, and what stands between two long sentences.

The digest groups are aggregates of one smallest rank and a count; the units meet them in a join that adaptive
execution splits where one unit occurs very often. No group is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkeep.llm.common import stage

#: Each pattern covers every character of a text once.
UNITS = {"line": r"[^\n]*\n+|[^\n]+", "sentence": r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"}
LEAST_WORDS = 6


def normalised(unit: str) -> bytes:
    return b" ".join(unit.encode("utf-8").lower().split())  # bytes: A-Z and ASCII white space only


def units(docs: DataFrame, unit: str = "sentence", least_words: int = LEAST_WORDS) -> DataFrame:
    """Units of at least ``least_words`` words of ``docs`` (row, doc_id, text): row, doc_id, begin, end, digest.

    Offsets count characters; ``end`` is exclusive. The digest is the 128-bit XXH3 of the normalised unit.
    """
    pattern = re.compile(UNITS[unit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                for m in pattern.finditer(text.as_py() or ""):
                    plain = normalised(m.group())
                    if plain.count(b" ") + bool(plain) >= least_words:
                        for c, v in zip(out, (row, doc_id, m.start(), m.end(), xxhash.xxh3_128_digest(plain))):
                            c.append(v)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES)], NAMES)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES)], NAMES)

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, begin int, end int, digest binary")


NAMES = ["row", "doc_id", "begin", "end", "digest"]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def repeats(docs: DataFrame, unit: str = "sentence", least_words: int = LEAST_WORDS) -> DataFrame:
    """Units of ``docs`` (row, doc_id, text) to remove: row, doc_id, begin, end, kept_doc_id, kept_begin.

    ``row`` is unique and orders rows of one doc_id; it is written with the units, so numbers made on the fly are safe. Null doc_ids rank last. Null and empty texts have no units.
    """
    return _later(units(docs, unit, least_words))


def _later(pieces: DataFrame) -> DataFrame:
    """All but the earliest of the pieces of each digest."""
    found = stage(pieces, "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "begin")
    groups = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(rank).alias("kept")).where("n > 1")
    joined = found.join(groups.select("digest", "kept"), "digest")
    later = joined.where((F.col("row") != F.col("kept.row")) | (F.col("begin") != F.col("kept.begin")))
    return later.select("row", "doc_id", "begin", "end", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.begin").alias("kept_begin"))


def _pieces(text: str, least_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, what is compared) of the lines and sentences of enough words, and of the gaps between long sentences.

    The words of a line count together, however short its sentences are. A gap is a run of short sentences between two
    long ones and is compared with both, so it repeats only where the whole run does.
    """
    before: tuple[int, bytes] | None = None  # the last long sentence: where it ends, its words
    short: list[bytes] = []
    for line in re.finditer(UNITS["line"], text):
        whole = normalised(line.group())
        if whole.count(b" ") + bool(whole) < least_words:
            short += [whole] if whole else []
            continue
        yield line.start(), line.end(), whole
        for m in re.finditer(UNITS["sentence"], line.group()):
            begin, end, plain = line.start() + m.start(), line.start() + m.end(), normalised(m.group())
            if plain.count(b" ") + bool(plain) < least_words:
                short += [plain] if plain else []
                continue
            if (begin, end) != line.span():
                yield begin, end, plain
            if before and short:
                yield before[0], begin, b"\n".join([before[1], b" ".join(short), plain])  # line feeds: equals no unit
            before, short = (end, plain), []


def passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Spans of ``docs`` (row, doc_id, text) to remove, as ``repeats`` gives them: repeated lines, repeated sentences, and
    repeated runs of short sentences between two long ones. A sentence's span can lie inside its line's.

    A line that goes has an earlier copy, which holds its sentences too; so the first of equal sentences never goes with
    its line, and one rank over lines and sentences is enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                for begin, end, plain in _pieces(text.as_py() or "", least_words):
                    for c, v in zip(out, (row, doc_id, begin, end, xxhash.xxh3_128_digest(plain))):
                        c.append(v)
                    if len(out[0]) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES)], NAMES)
                        out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES)], NAMES)

    return _later(docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, begin int, end int, digest binary"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``row``, written so that the numbers stay the same in every later job."""
    return stage(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def deduplicate(docs: DataFrame, unit: str = "sentence", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` (doc_id, text) with repeated units cut out of ``text``, and ``removed``: their original offsets in order."""
    rows = numbered(docs.select("doc_id", "text"))
    spans = repeats(rows, unit, least_words).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("removed"))
    joined = rows.join(spans, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<begin:int,end:int>>")))
    kept = F.aggregate(
        "removed",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, s["begin"] - a["at"])).alias("out"), s["end"].alias("at")),
        lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    return joined.select("doc_id", F.when(F.size("removed") > 0, kept).otherwise(F.col("text")).alias("text"), "removed")
