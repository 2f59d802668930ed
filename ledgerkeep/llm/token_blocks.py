"""Token-ID output: patched frame-of-reference blocks in ascending document order.

A segment is a self-contained byte string (little-endian):

    4 bytes  magic ``PFB1``
    u32      ids in the segment
    u32      blocks
    u32 x b  start of each block in the body
    body     per block: u32 minimum, u8 width, u8 exceptions, packed low bits of (id - minimum) at that width
             (``BLOCK * width / 8`` bytes), u8 positions of the exceptions, u32 their whole (id - minimum)

The width of a block is the bit length that ``percentile`` of its differences fit into; the others are exceptions.
The block starts give random access: ``read_ids`` decodes only the blocks that a range touches.

A token table is a Parquet folder with one row per segment: ``part`` and ``seq`` order the segments, ``first`` counts
the ids of its part before it, ``doc_ids`` and ``doc_lens`` index the documents in it. A document never spans two
segments, so each segment decodes alone. Parquet is the container because Spark then commits, retries and reads the
files on any file system.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerkeep.llm.common import binary, slices

MAGIC = b"PFB1"
BLOCK = 128
#: A segment is closed once it holds this many ids.
SEGMENT_IDS = 1 << 16
PERCENTILE = 0.9
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
#: Words and pieces of words, each, that a worker remembers with their ids.
REMEMBERED = 500_000

SEGMENTS = "part int, seq int, first long, n_ids int, doc_ids array<long>, doc_lens array<int>, payload binary"
DOCUMENTS = "part int, first long, doc_id long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Encode unsigned 32-bit ids as one segment."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = MAGIC + struct.pack("<II", n, blocks)
    if not n:
        return head
    grid = np.empty(blocks * BLOCK, dtype=np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    bits = np.frexp(diff.astype(np.float64))[1].astype(np.uint8)
    place = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(bits, place, axis=1)[:, place]
    odd = bits > width[:, None]
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        values = np.where(odd[rows], 0, diff[rows]).astype("<u2" if w <= 16 else "<u4")
        bits_of = np.unpackbits(values.view(np.uint8).reshape(len(rows), BLOCK, -1), axis=2, count=int(w), bitorder="little")
        body = np.packbits(bits_of.reshape(len(rows), -1), axis=1, bitorder="little")
        for r, b in zip(rows.tolist(), body):
            packed[r] = b.tobytes()
    counts = odd.sum(axis=1)
    where = np.nonzero(odd)[1].astype(np.uint8).tobytes()
    values = diff[odd].astype("<u4").tobytes()
    parts, starts, at, seen = [], [], 0, 0
    for m, w, c, body in zip(low.tolist(), width.tolist(), counts.tolist(), packed):
        block = struct.pack("<IBB", m, w, c) + body + where[seen : seen + c] + values[4 * seen : 4 * (seen + c)]
        starts.append(at)
        parts.append(block)
        at += len(block)
        seen += c
    return head + np.array(starts, dtype="<u4").tobytes() + b"".join(parts)


def _unpack(payload: bytes, first: int, last: int) -> np.ndarray:
    """The blocks ``first`` to ``last`` (exclusive) of a segment, padding included."""
    raw = np.frombuffer(payload, dtype=np.uint8)
    blocks = struct.unpack_from("<I", payload, 8)[0]
    body = 12 + 4 * blocks
    starts = np.frombuffer(payload, dtype="<u4", count=blocks, offset=12)[first:last].astype(np.int64) + body
    low = raw[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, counts = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    out = np.zeros((last - first, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        packed = raw[(starts[rows] + 6)[:, None] + np.arange(BLOCK * w // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        value = np.zeros((len(rows), BLOCK), dtype=np.uint32)
        for b in range(w):
            value |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
        out[rows] = value
    if counts.any():
        rows = np.repeat(np.arange(last - first), counts)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (starts + 6 + BLOCK * width // 8)[rows]
        values = raw[(at + counts[rows] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[rows, raw[at + nth]] = values
    return (out + low[:, None]).reshape(-1)


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a segment."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, blocks = struct.unpack_from("<II", payload, 4)
    return _unpack(payload, 0, blocks)[:n] if n else np.zeros(0, dtype=np.uint32)


def read_ids(payload: bytes, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` (exclusive) of a segment, through the block starts."""
    n = struct.unpack_from("<I", payload, 4)[0]
    end = min(end, n)
    if begin >= end:
        return np.zeros(0, dtype=np.uint32)
    first = begin // BLOCK
    return _unpack(payload, first, -(-end // BLOCK))[begin - first * BLOCK : end - first * BLOCK]


class Remembered:
    """Names and their ids as Arrow arrays, most recently met first; beyond ``REMEMBERED`` the longest unseen go."""

    def __init__(self) -> None:
        self.names, self.ids = pa.array([], pa.large_string()), _lists([])

    def recall(self, names: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of distinct names, a list each: known, or learnt from an array of the new ones."""
        at = pc.index_in(names, value_set=self.names)
        new = names.filter(at.is_null())
        known = pa.concat_arrays([self.ids, learn(new)]) if len(new) else self.ids
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        unseen = np.ones(len(self.names), dtype=bool)
        unseen[place[place >= 0]] = False
        place[place < 0] = np.arange(len(self.names), len(known))
        ids = known.take(pa.array(place))
        rest = np.flatnonzero(unseen)[: max(0, REMEMBERED - len(names))]
        self.names = pa.concat_arrays([names[:REMEMBERED], self.names.take(pa.array(rest))])
        self.ids = pa.concat_arrays([ids[:REMEMBERED], self.ids.take(pa.array(rest))])
        return ids


class WordTokenizer:
    """Encodes whole texts as the tokenizer does, once per distinct word and piece of a word.

    Right for tokenizers that drop white space and never join across it, as word-end BPE does: the ids of a text are
    then the ids of its words one after another. A word is cut further at the vocabulary's own pieces (contractions, letter
    runs, single digits, other runs), in lower case, where that is safe: only characters that NFC leaves alone and whose
    lower case is one character. All other words are encoded whole. Words are told apart, remembered and put together as
    Arrow arrays, so that neither a place in a text nor a remembered word is a Python object.
    """

    #: Fixed values of the vocabulary: its pieces, and the mark at the end of each piece's last id.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORD_END = "</w>"
    #: Characters that are safe to cut and to lower, as the inside of a character class.
    PLAIN = "!-~\u00a1-\u012f\u0131-\u017f"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words, self.pieces = Remembered(), Remembered()
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, dtype=bool)
        for token, i in self.model.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(self.WORD_END)
        special = regex.escape("".join(sorted({t.content[:1] for t in self.model.get_added_tokens_decoder().values()})))
        self.whole = regex.compile(rf"^.*(?:[^\n{self.PLAIN}]|[{special}]).*$" if special else rf"^.*[^\n{self.PLAIN}].*$", regex.M)
        self.cut = regex.compile(self.PIECES + r"|\n")

    def _learn_pieces(self, new: pa.Array) -> pa.Array:
        """The ids of single pieces, and none for a line feed. ASCII stands for itself in the vocabulary and goes to the
        model; the others are encoded in one text that is cut after each id with the mark."""
        names = new.to_pylist()
        found = [b"" if p == "\n" else None for p in names]
        tokenize = self.model.model.tokenize
        others = []
        for i, p in enumerate(names):
            if not p.isascii():
                others.append(i)
            elif p != "\n":
                ids = [t.id for t in tokenize(p)]
                found[i] = struct.pack(f"<{len(ids)}I", *ids)
        for i in range(0, len(others), 4096):
            some = others[i : i + 4096]
            ids = np.array(self.model.encode_batch_fast([" ".join([names[k] for k in some])], add_special_tokens=False)[0].ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(some):
                raise ValueError("the vocabulary cuts a piece")
            for k, part in zip(some, np.split(ids, last[:-1])):
                found[k] = part.tobytes()
        return _lists(found)

    def _cut(self, words: list[str]) -> pa.Array:
        """The ids of words that are safe to cut, a list each."""
        pieces = pa.array(self.cut.findall("\n".join([*words, ""]).lower()), pa.large_string()).dictionary_encode()
        ids = self.pieces.recall(pieces.dictionary, self._learn_pieces).take(pieces.indices)
        mark = pc.index(pieces.dictionary, "\n").as_py()
        ends = np.flatnonzero(pieces.indices.to_numpy() == mark)
        return pa.LargeListArray.from_arrays(ids.offsets.take(pa.array(np.concatenate([[0], ends]))), ids.values)

    def _learn_words(self, new: pa.Array) -> pa.Array:
        """The ids of words, a list each."""
        names = new.to_pylist()
        whole = list(dict.fromkeys(self.whole.findall("\n".join(names))))
        if not whole:
            return self._cut(names)
        place = dict(zip(whole, range(len(whole))))
        plain = [w for w in names if w not in place]
        place.update(zip(plain, range(len(whole), len(names))))
        encoded = []
        for i in range(0, len(whole), 4096):
            encoded += [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(whole[i : i + 4096], add_special_tokens=False)]
        lists = [_lists(encoded), *([self._cut(plain)] if plain else [])]
        return pa.concat_arrays(lists).take(pa.array([place[w] for w in names], pa.int64()))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        ids = self.words.recall(words.dictionary, self._learn_words).take(words.indices)
        ends = ids.offsets.to_numpy()[split.offsets.to_numpy()].tolist()
        raw = ids.values.to_numpy().astype("<u4", copy=False).tobytes()
        return [raw[4 * b : 4 * e] for b, e in zip(ends, ends[1:])]


def _lists(raw: list[bytes]) -> pa.Array:
    """Little-endian unsigned 32-bit integers as Arrow lists."""
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
    values = np.frombuffer(b"".join(raw), dtype="<u4")
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), pa.array(values, pa.uint32()))


_workers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The tokenizer of a file; a worker that Spark uses again keeps what its earlier tasks have learnt."""
    if path not in _workers:
        _workers.clear()
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int, percentile: float = PERCENTILE) -> DataFrame:
    """Segments of all ``docs`` (doc_id, text) in ascending doc_id order.

    Nulls: a null text is empty, so its document holds the end id only; null doc_ids come first. Repeated rows stay,
    one document each. Rows of one doc_id are spread by their text's hash, so no id can fill a task by different texts.
    """
    tie = F.xxhash64("text")
    ordered = (
        docs.select("doc_id", "text", tie.alias("tie"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
        .select("doc_id", "text")
    )
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        words = tokenizer_of(tokenizer)
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(ids), dtype="<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([len(whole)], pa.int32()),
                    pa.array([names], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int32())), pa.array([pack(whole, percentile)], pa.binary()),
                ],
                ["part", "seq", "first", "n_ids", "doc_ids", "doc_lens", "payload"],
            )

        for batch in slices(batches, "text", SLICE):
            for name, got in zip(batch.column("doc_id").to_pylist(), words.encode(binary(batch, "text"))):
                ids.append(got + end)
                names.append(name)
                held += len(got) // 4 + 1
                if held >= SEGMENT_IDS:
                    yield close()
                    first, seq, held, ids, names = first + held, seq + 1, 0, [], []
        if ids:
            yield close()

    return ordered.mapInArrow(run, SEGMENTS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, percentile: float = PERCENTILE) -> None:
    """Write the token table of ``docs`` to ``path``."""
    encode(docs, tokenizer, end_id, percentile).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token table: doc_id, start, n_tokens, ids_crc32, decoded from its segments.

    Starts come from a running sum over the ids of each part: one small row per written file.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack(row["payload"]).astype("<u4").tobytes()
                lens = np.array(row["doc_lens"], dtype=np.int64)
                ends = np.cumsum(lens)
                begins = ends - lens
                crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(lens), row["part"]), pa.int32()), pa.array(begins + row["first"], pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(lens, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    ["part", "first", "doc_id", "n_tokens", "ids_crc32"],
                )

    found = segments.select("part", "first", "doc_ids", "doc_lens", "payload").mapInArrow(run, DOCUMENTS)
    return found.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
