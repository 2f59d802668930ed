"""License scans: an exact set-similarity join of text blocks with license templates, and whole-phrase places.

Words are runs of digits, letters and non-ASCII characters, with A-Z lower-cased. A block is a window of words, across
line feeds, of at most the template's length divided by ``threshold``; a template matches it if the block holds at least
``threshold`` of the template's distinct words (containment). A text whose words as one set do not reach a template has
no such window; that first join is exact:

- words are ordered by their frequency in all documents, rarest first, with ties by the word;
- length filter: a set must have at least ``need = ceil(threshold * n)`` of a template's n words;
- prefix filter: then one of the first ``n - need + 1`` words of the template is in it, so an index of those finds all;
- positional filter: a first shared word at place i of the template leaves at most ``n - i`` words in common.

Only words of templates can count, so the frequency table is as large as the templates' vocabulary. Frequencies are
counted over all documents.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkeep.llm.common import binary, slices

THRESHOLD = 0.8
#: Phrases whose places are counted, and their labels: fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Widely used license notices and lines, by label.
TEMPLATES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-line": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution International License",
    "all-rights-reserved": "All rights reserved.",
}
_KEEP = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_WORDS = bytes(c if c in _KEEP else 0x20 for c in bytes(range(256)).lower())
_LINES = bytes(c if c in _KEEP or c == 0x0A else 0x20 for c in bytes(range(256)).lower())

COUNTS = "word binary, n long"
FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,line:int,containment:double>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences of the vocabulary's words in all texts; one row per word and task is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in slices(batches, "text"):
            for text in binary(batch, "text"):
                total.update(w for w in words(text) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


class Index:
    """Templates with their words in global order, and the prefix index over them."""

    def __init__(self, templates: dict[str, str], seen: dict[bytes, int], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above zero and at most one")
        self.labels = sorted(templates)
        self.order: list[list[bytes]] = []
        self.sets: list[set[bytes]] = []
        self.need: list[int] = []
        self.span: list[int] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for label in self.labels:
            sequence = words(templates[label].encode("utf-8"))
            distinct = sorted(set(sequence), key=lambda w: (seen.get(w, 0), w))
            if not distinct:
                raise ValueError(f"template {label} has no words")
            need = math.ceil(threshold * len(distinct) - 1e-9)
            self.order.append(distinct)
            self.sets.append(set(distinct))
            self.need.append(need)
            self.span.append(math.ceil(len(sequence) / threshold - 1e-9))
            for place, word in enumerate(distinct[: len(distinct) - need + 1]):
                self.prefix.setdefault(word, []).append((len(self.order) - 1, place))

    def matches(self, block: set[bytes]) -> list[tuple[str, float]]:
        """Labels and containments of all templates that the block's words reach."""
        first: dict[int, int] = {}
        for word in block & self.prefix.keys():
            for t, place in self.prefix[word]:
                first[t] = min(place, first.get(t, place))
        out = []
        for t, place in sorted(first.items()):
            n = len(self.order[t])
            if len(block) < self.need[t] or n - place < self.need[t]:
                continue
            common = len(block & self.sets[t])
            if common >= self.need[t]:
                out.append((self.labels[t], common / n))
        return out

    def windows(self, sequence: list[bytes]) -> list[tuple[int, str, float]]:
        """(word index, label, containment) of the best of overlapping windows of ``sequence`` that reach a template."""
        out = []
        for label, _ in self.matches(set(sequence)):
            t = self.labels.index(label)
            wanted, need, span, n = self.sets[t], self.need[t], self.span[t], len(self.order[t])
            hits = [(i, w) for i, w in enumerate(sequence) if w in wanted]
            held: dict[bytes, int] = {}
            left = 0
            best: tuple[int, int, int] | None = None  # words in common, first and last place
            for right, word in hits:
                held[word] = held.get(word, 0) + 1
                while hits[left][0] <= right - span or held[hits[left][1]] > 1:  # too far off, or there again later
                    held[hits[left][1]] -= 1
                    if not held[hits[left][1]]:
                        del held[hits[left][1]]
                    left += 1
                if len(held) < need:
                    continue
                if best and hits[left][0] > best[2]:
                    out.append((best[1], label, best[0] / n))
                    best = None
                if not best or len(held) > best[0]:
                    best = (len(held), hits[left][0], right)
            if best:
                out.append((best[1], label, best[0] / n))
        return sorted(out)


def phrase_places(sequence: list[bytes], phrases: dict[bytes, tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(word index, label) of every place where a phrase's words stand one after another."""
    joined = b" " + b" ".join(sequence) + b" "
    out = []
    for phrase, (_, label) in phrases.items():
        sought = b" " + phrase + b" "
        at = joined.find(sought)
        before = count = 0
        while at >= 0:
            count += joined.count(b" ", before, at)
            before = at
            out.append((count, label))
            at = joined.find(sought, at + 1)
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) its phrase places, template matches, labels and score. A match has the line where
    its window begins.

    The score is one if a phrase is found, else the greatest containment of a matching block, else zero. Null and empty
    texts have no words; repeated rows stay.
    """
    vocabulary = {w for t in templates.values() for w in words(t.encode("utf-8"))}
    index = Index(templates, frequencies(docs, vocabulary), threshold)
    sought = {p.encode("utf-8"): (p.encode("utf-8").split(), label) for p, label in phrases.items()}
    names = [f.split()[0] for f in FOUND.split(", ")[:8]] + ["blocks"]
    block_type = pa.list_(pa.struct([("label", pa.string()), ("line", pa.int32()), ("containment", pa.float64())]))
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), block_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary(batch, "text")):
                sequence = words(text)
                places = phrase_places(sequence, sought)
                blocks = []
                if found := index.windows(sequence):
                    ends = list(accumulate(len(part.split()) for part in text.translate(_LINES).split(b"\n")))
                    blocks = [{"label": label, "line": bisect_right(ends, i), "containment": c} for i, label, c in found]
                base = sorted({label for _, label in places})
                every = sorted({*base, *(b["label"] for b in blocks)})
                at = [i for i, _ in places]
                score = 1.0 if places else max((b["containment"] for b in blocks), default=0.0)
                out.append((doc_id, len(sequence), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every), score, blocks))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)
