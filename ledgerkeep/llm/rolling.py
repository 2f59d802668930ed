"""Rabin-Karp fingerprints of word n-grams over a buffer of many texts, by numpy prefix polynomials.

A buffer is the concatenation of texts with a line feed after each. The prefix polynomial of its bytes gives the
fingerprint of any word by one subtraction and one multiplication, and the prefix polynomial of these gives that of any
run of words. Arithmetic is modulo 2^64 with an odd base, which has an inverse; words are mixed before they become
coefficients, and bytes are looked up in a table of odd random numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkeep.llm.common import freed

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOL = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the longest table asked for stays in the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        have = _powers[base] = np.cumprod(table)
    return have[:n]


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Values of the polynomial with these coefficients, for each prefix (the empty one first)."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * powers(BASE, len(symbols)), out=out[1:])
    return out


def between(prefixes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs [begin, end), equal wherever a run stands."""
    return (prefixes[end] - prefixes[begin]) * powers(_INVERSE, len(prefixes))[begin]


class Words:
    """The words of a buffer: byte ranges, the piece each stands in, and fingerprints.

    Pieces end at the bytes of ``breaks``, or at the given places ``ends`` (each must be a blank or a break)."""

    def __init__(self, buffer: bytes, blanks: bytes, breaks: bytes = b"", ends: np.ndarray | None = None):
        self.bytes = _LOWER[np.frombuffer(buffer, dtype=np.uint8)]
        kind = np.zeros(256, dtype=np.uint8)
        kind[list(blanks)] = 1
        kind[list(breaks)] = 2
        kinds = kind[self.bytes]
        inside = np.zeros(len(kinds) + 2, dtype=np.int8)
        inside[1:-1] = kinds == 0
        edge = np.diff(inside)
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.searchsorted(np.flatnonzero(kinds == 2) if ends is None else ends, self.begin)
        self.fp = mixed(between(prefix(_SYMBOL[self.bytes]), self.begin, self.end))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (first words) and fingerprints of all runs of n words inside one piece."""
        count = len(self.fp) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.piece[n - 1 :] == self.piece[:count])
        if n == 1:
            return at, self.fp
        return at, mixed(between(prefix(self.fp), at, at + n) + np.uint64(n))

    def text(self, place: int, n: int) -> str:
        """The words of one run, joined by single spaces."""
        return " ".join(self.bytes[self.begin[i] : self.end[i]].tobytes().decode("utf-8", "replace") for i in range(place, place + n))


def cuts(text: bytes, words: int, separators: bytes, limit: int) -> Iterator[tuple[bytes, int]]:
    """A text in pieces of about ``limit`` bytes that begin and end between words: (bytes, how many are its own).
    After its own bytes a piece shows the next ``words`` - 1 words, so that runs across a cut are seen once."""
    of = re.escape(separators)
    separator, ahead = re.compile(rb"[%s]" % of), re.compile(rb"(?:[%s]+[^%s]+){0,%d}" % (of, of, words - 1))
    begin = 0
    while begin < len(text):
        found = separator.search(text, begin + limit)
        end = found.start() if found else len(text)
        yield text[begin : ahead.match(text, end).end()], end - begin
        begin = end


#: Bits of a table of fingerprints (2^27: 16 MB, whatever the corpus).
TABLE_BITS = 27


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a bit table may hold the keys: yes for all that it was made from, and for some others."""
    bit = keys & np.uint64((1 << TABLE_BITS) - 1)
    return (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_table(keys: DataFrame) -> Broadcast:
    """The bit table of the column ``key``, of fixed size, for all tasks."""
    bit = F.col("key").bitwiseAND(F.lit((1 << TABLE_BITS) - 1)) + 1
    with freed(keys.sparkSession):
        rows = keys.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    table = bytearray(1 << (TABLE_BITS - 3))
    for part, bits in rows:
        begin = (part - 1) * 4096
        table[begin : begin + len(bits)] = bits
    return keys.sparkSession.sparkContext.broadcast(bytes(table))


def opened(tables: list[Broadcast]) -> list[np.ndarray]:
    return [np.frombuffer(t.value, dtype=np.uint8) for t in tables]
