"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is cut into ``segments`` pieces on a ring. If two fingerprints differ in at most ``radius`` bits,
some piece starts a chain whose first k pieces differ in at most k * radius / segments bits, for every k up to the
whole ring. With 8 pieces and radius 3 the first two pieces of that chain agree, and the next three differ in one bit
at most, so one half of those three agrees too: that agreement (28 bits here, 16 rows per fingerprint) is the bucket
key. Inside a bucket the chain budgets prune pairs step by step before the full Hamming distance is taken.

Only distinct fingerprints are compared. A bucket of any size is cut into blocks by hash, and every pair of blocks is a
unit of work of bounded memory; of the links found in a unit only a spanning forest leaves the task, so a group of near
copies costs a row per member, not one per pair. Components are the same as with all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkeep.llm.common import binary, slices, stage
from ledgerkeep.llm.graph import components

SEED = 42
#: Distinct fingerprints of a bucket that are compared in one unit of work.
BLOCK = 2048
#: Shingles whose bits are summed at once.
CHUNK = 1 << 15


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; fewer words: of the whole sequence; none: empty."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-size] + 1]).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.fromiter((digest(view[b:e], SEED) for b, e in zip(begins, ends[size - 1 :].tolist())), dtype=np.uint64, count=len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed long; zero if there are none."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        some = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int, *keep: str, name: str = "fp") -> DataFrame:
    """The columns ``keep`` of each row and its fingerprint ``name`` (long). A null text is empty: fingerprint zero."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{name}` long"])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(shingle_hashes(t, size)) for t in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.int64())], [*names, name])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class Ring:
    """Budgets and bucket keys of the chains for one radius and number of segments."""

    def __init__(self, radius: int, segments: int):
        if 64 % segments or not 0 <= radius < segments:
            raise ValueError("segments must divide 64 and exceed the radius")
        self.segments, self.width = segments, 64 // segments
        self.budget = [k * radius // segments for k in range(segments + 1)]
        self.exact = max(k for k in range(1, segments + 1) if self.budget[k] == 0)
        last = max(k for k in range(1, segments + 1) if self.budget[k] <= 1)
        self.tail = (last - self.exact) * self.width

    def keys(self, fp: Column) -> Column:
        """One long per bucket of a fingerprint: chain start, half of the tail, and the bits that must agree."""
        head, out = self.exact * self.width, []
        cuts = [0, self.tail // 2, self.tail] if self.tail else [0, 0]
        for start in range(self.segments):
            turn = start * self.width
            turned = fp if not turn else F.shiftrightunsigned(fp, turn).bitwiseOR(F.shiftleft(fp, 64 - turn))
            low = turned.bitwiseAND(F.lit((1 << head) - 1)) if head < 64 else turned
            for half, (a, b) in enumerate(zip(cuts, cuts[1:])):
                part = F.shiftrightunsigned(turned, head + a).bitwiseAND(F.lit((1 << (b - a)) - 1)) if b > a else F.lit(0)
                out.append(F.struct(F.lit(start * 2 + half).alias("chain"), low.alias("head"), part.cast("long").alias("tail")))
        return F.array(*out)

    def linked(self, chain: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of candidate pairs (x[at], y[to]) of one bucket each, those within the radius; ``chain`` is the start of each pair."""
        differ = x[at] ^ y[to]
        turn = (chain * self.width).astype(np.uint64)
        differ = (differ >> turn) | (differ << ((np.uint64(64) - turn) & np.uint64(63)))
        for k in range(self.exact + 1, self.segments + 1):
            if k < self.segments and self.budget[k] == self.budget[k + 1]:
                continue  # the next chain length has the same budget and covers more bits
            mask = np.uint64((1 << (k * self.width)) - 1)
            keep = np.bitwise_count(differ & mask) <= self.budget[k]
            differ, at, to = differ[keep], at[keep], to[keep]
        return at, to


def _forest(n: int, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The smallest row connected to each of n rows, by hooking roots on smaller roots."""
    label = np.arange(n)
    while len(at):
        at, to = label[at], label[to]  # roots, because labels are followed to their end below
        apart = at != to
        at, to = at[apart], to[apart]
        np.minimum.at(label, np.maximum(at, to), np.minimum(at, to))
        while (label != label[label]).any():
            label = label[label]
    return label


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole units (runs of equal chain, head, tail, a, b in sorted rows), several at a time."""
    names = ["chain", "head", "tail", "a", "b", "block", "fp"]
    held: list[np.ndarray] = []

    def table() -> dict[str, np.ndarray]:
        return {n: np.concatenate([h[i] for h in held]) for i, n in enumerate(names)}

    for batch in batches:
        now = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        held.append(now)
        whole = table()
        last = np.ones(len(whole["fp"]), dtype=bool)
        for n in names[:5]:
            last &= whole[n] == whole[n][-1]
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield {n: c[:cut] for n, c in whole.items()}
        held = [[c[cut:] for c in whole.values()]]
    if held:
        yield table()


def links(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` whose components are those of all pairs within the radius."""
    ring = Ring(radius, segments)
    keys = fps.select("fp", F.explode(ring.keys(F.col("fp"))).alias("k")).select("k.chain", "k.head", "k.tail", "fp")
    bucket = ["chain", "head", "tail"]
    full = keys.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    pairs = (
        keys.join(full, bucket)
        .withColumn("blocks", blocks)
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*bucket, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "fp")
    )
    unit = [*bucket, "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            fp = rows["fp"].astype(np.int64).view(np.uint64)
            change = np.zeros(len(fp), dtype=bool)
            for n in unit:
                change[1:] |= rows[n][1:] != rows[n][:-1]
            starts = np.append(np.flatnonzero(change | (np.arange(len(fp)) == 0)), len(fp))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            small: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0

            def check(some: list[tuple[np.ndarray, np.ndarray]]) -> None:
                at, to = np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])
                found.append(ring.linked(rows["chain"][at] // 2, fp, fp, at, to))

            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                block = rows["block"][s:e]
                if rows["a"][s] == rows["b"][s]:
                    at, to = np.triu_indices(e - s, 1)
                else:
                    left, right = np.flatnonzero(block == rows["a"][s]), np.flatnonzero(block == rows["b"][s])
                    at, to = np.repeat(left, len(right)), np.tile(right, len(left))
                for i in range(0, len(at), 1 << 20):
                    small.append((at[i : i + (1 << 20)] + s, to[i : i + (1 << 20)] + s))
                    held += len(small[-1][0])
                    if held >= 1 << 20:
                        check(small)
                        small, held = [], 0
                if len(found) > 8:  # keep the survivors of a dense bucket small
                    label = _forest(len(fp), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                    node = np.flatnonzero(label != np.arange(len(fp)))
                    found = [(node, label[node])]
            if small:
                check(small)
            if found:
                label = _forest(len(fp), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                node = np.flatnonzero(label != np.arange(len(fp)))
                signed = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[node]), pa.array(signed[label[node]])], ["u", "v"])

    placed = pairs.repartition(*unit).sortWithinPartitions(*unit)
    return placed.mapInArrow(run, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def roots(fps: DataFrame, radius: int = 3, segments: int = 8) -> DataFrame:
    """(fp, root) for distinct fingerprints that link to a smaller one."""
    return components(links(fps, radius, segments)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, size: int = 5, radius: int = 3, segments: int = 8) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row of ``docs``.

    Null texts and texts without words have fingerprint zero and link like any other. Repeated rows stay. A null doc_id
    stays null and names a component only if no other row of it has an id.
    """
    signed = stage(fingerprints(docs, size, "doc_id"), "fingerprints")
    distinct = stage(signed.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    named = stage(roots(distinct.select("fp"), radius, segments), "roots")
    root = F.coalesce(F.col("root"), F.col("fp"))
    placed = distinct.join(named, "fp", "left").select("fp", root.alias("root"), "low")
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = placed.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return signed.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, radius: int = 3, segments: int = 8) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id (null last; equal ids: the first row written).

    Returns the columns of ``docs``. Rows are numbered in a written copy, so repeated rows are told apart safely.
    """
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    signed = stage(fingerprints(numbered, size, *numbered.columns, name="__fp"), "signed")
    narrow = signed.select("__row", "doc_id", F.col("__fp").alias("fp"))
    named = stage(roots(narrow.select("fp").distinct(), radius, segments), "roots")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    first = (
        narrow.groupBy("fp").agg(F.min(order).alias("first"))
        .join(named, "fp", "left")
        .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
        .select(F.col("first.row").alias("__row"))
    )
    return signed.join(first, "__row", "left_semi").select(*docs.columns)
