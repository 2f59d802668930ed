"""Exact Jaccard join of word shingles by grouped prefixes.

Shingles have one global order: rare ones before those that many documents share. Two sets that are similar enough share
a shingle among their first ones (the prefix). Documents with equal sets are one member; members with the same prefix and
size are one group, and groups meet under each shingle of their prefix. A pair of groups is filtered by sizes and by
the places of the shingle; what is left is expanded to members, which must agree in a 512-bit parity sketch (it can only
understate how many shingles differ) and are then verified by their whole sets.

Shingles that one document has alone meet nothing and are left out by a bit table of fixed size. Members are first linked
to a few pivots under each shingle; after that only pairs of different components are looked at, so a group of near copies
costs a few pairs per member. Before whole sets are fetched, a pair must also agree in parity sketches with a bit for each
shingle. Long lists are cut into blocks, and each pair of blocks is a unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkeep.llm.common import binary, freed, slices, stage
from ledgerkeep.llm.graph import components
from ledgerkeep.llm.rolling import Words, between, bit_table, cuts, holds, mixed, opened, prefix

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that are hashed at once; a longer text is cut between words.
BUFFER = 1 << 20
#: Shingles whose hash is below this share of all hashes are counted; they come first if no more than COMMON documents have them.
COUNTED, COMMON = 0.3, 64
#: Groups of a block, members of a row of a group, and members that are verified against one in a unit.
BLOCK, MEMBERS, SIDES = 512, 64, 256
SKETCH = 512
#: Shingles of a group that are at hand to tell whether a pair has met under an earlier one.
HEADS = 12


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the distinct shingles of all texts, sorted within each text, and where each text begins in them.

    A text of fewer than ``size`` words has its whole sequence as one shingle; without words its set is empty."""
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    words = Words(b"\n".join(texts) + b"\n", SPACES, ends=ends)
    at, fp = words.grams(size)
    doc = words.piece[at]
    count = np.bincount(words.piece, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(words.piece, short)
        whole = mixed(between(prefix(words.fp), first, first + count[short]) + count[short].astype(np.uint64))
        doc, fp = np.concatenate([doc, short]), np.concatenate([fp, whole])
    order = np.lexsort((fp, doc))
    doc, fp = doc[order], fp[order]
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
    return fp[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def shingle_set(text: bytes, size: int, limit: int = BUFFER) -> np.ndarray:
    """The set of one text of any length, in pieces."""
    found, count = [], 0
    for piece, own in cuts(text, size, SPACES, limit):
        words = Words(piece + b"\n", SPACES)
        at, fp = words.grams(size)
        found.append(np.unique(fp[words.begin[at] < own]))
        count += int((words.begin < own).sum())
    if 0 < count < size:  # few words, some of them huge
        return shingle_sets([b" ".join(text.split())], size)[0]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in slices(batches, "text", BUFFER):
        texts = binary(batch, "text")
        if len(texts) == 1 and len(texts[0]) > BUFFER:
            fp = shingle_set(texts[0], size)
            yield batch, fp, np.array([0, len(fp)])
        else:
            yield batch, *shingle_sets(texts, size)


def _counts(docs: DataFrame, size: int) -> DataFrame:
    """key, c: in how many documents each counted shingle occurs."""
    below = np.uint64(int(COUNTED * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, fp, _ in _sets(batches, size):
            key, c = np.unique(fp[fp < below], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c)], ["key", "c"])

    return docs.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where("c > 1")


def _profiles(docs: DataFrame, size: int, share: int, shared: Broadcast, common: Broadcast) -> DataFrame:
    """row, doc_id, n, digest of each document, and for those that may meet others: the digest ``gid`` of size and prefix,
    shingles and places of the prefix that may be shared, and sketches of 512 bits and of a bit or two for each shingle."""
    below = np.uint64(int(COUNTED * (1 << 64)))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, n long, digest binary, gid binary, tokens array<long>, places array<int>, sketch binary, wide binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, often = opened([shared, common])
        for batch, fp, begin in _sets(batches, size):
            n = np.diff(begin)
            doc = np.repeat(np.arange(len(n)), n)
            counted = fp < below
            rank = np.where(counted, np.where(holds(often, fp), 2, 0), 1).astype(np.int8)
            order = np.lexsort((fp, rank, doc))  # a global order: rare, not counted, common; then by hash
            place = np.arange(len(fp)) - begin[doc]
            inside = place < (n - -(-share * n // 100) + 1)[doc]
            heads, head_doc, head_place = fp[order][inside], doc[inside], place[inside]
            use = (heads >= below) | holds(some, heads)
            cut = np.searchsorted(head_doc, np.arange(len(n) + 1))
            rows = []
            for i in range(len(n)):
                whole = fp[begin[i] : begin[i + 1]]
                row = {"n": int(n[i]), "digest": xxhash.xxh128_digest(whole.tobytes()) if n[i] else None}
                kept = slice(cut[i], cut[i + 1])
                if use[kept].any():
                    wide = parities(whole)
                    row |= {
                        "gid": xxhash.xxh128_digest(n[i : i + 1].tobytes() + heads[kept].tobytes()),
                        "tokens": heads[kept][use[kept]].view(np.int64).tolist(), "places": head_place[kept][use[kept]].tolist(),
                        "sketch": folded(wide, SKETCH).tobytes(), "wide": wide.tobytes(),
                    }
                rows.append(row)
            kinds = {"n": pa.int64(), "digest": pa.binary(), "gid": pa.binary(), "tokens": pa.list_(pa.int64()), "places": pa.list_(pa.int32()), "sketch": pa.binary(), "wide": pa.binary()}
            arrays = [pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *arrays], ["row", "doc_id", *kinds])

    return docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def parities(fp: np.ndarray) -> np.ndarray:
    """How many shingles fall on each bit, modulo two: at least as many bits as shingles, a power of two."""
    bits = max(SKETCH, 1 << int(len(fp) - 1).bit_length())
    return np.packbits(np.bincount((fp & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, bits: int) -> np.ndarray:
    """The sketch of the same shingles with fewer bits."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, bits // 64), axis=0)


def _most_apart(m: np.ndarray, n: np.ndarray, share: int) -> np.ndarray:
    """How many shingles two sets of these sizes may differ in, at most."""
    return m + n - 2 * -(-share * (m + n) // (100 + share))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint64).reshape(-1, SKETCH // 64)


def _sieved(pairs: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """The pairs whose sizes and wide sketches allow the similarity."""
    size = members.select("row", F.col("n").cast("long").alias("n"), "wide")
    both = pairs.join(size.toDF("u", "m", "s"), "u").join(size.toDF("v", "n", "t"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n = b.column("m").to_numpy(), b.column("n").to_numpy()
            fits = 100 * np.minimum(m, n) >= share * np.maximum(m, n)
            most = np.where(fits, _most_apart(m, n, share), -1)
            near = []
            for x, y, d in zip(b.column("s").to_pylist(), b.column("t").to_pylist(), most.tolist()):
                bits = 8 * min(len(x), len(y))
                x, y = (folded(np.frombuffer(z, dtype=np.uint64), bits) for z in (x, y))
                near.append(int(np.bitwise_count(x ^ y).sum()) <= d)
            yield b.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return both.select("u", "v", "m", "n", "s", "t").mapInArrow(run, "u long, v long").distinct()


def _tokens(members: DataFrame, *columns: str) -> DataFrame:
    """A row for each shingle of a member's prefix: these columns, token and place. Spark sizes it by the file and one entry
    an array, far too low, and would broadcast it; so joins of it are told to merge."""
    return members.select(*columns, F.explode(F.arrays_zip("tokens", "places")).alias("t")).select(*columns, F.col("t.tokens").alias("token"), F.col("t.places").alias("place")).hint("merge")


def _pivots(members: DataFrame, share: int) -> DataFrame:
    """Pairs (u, v) of the pivots of each shingle and its other members. Pivots are the member whose prefix holds the
    fewest shingles of its own, as the text does that others were copied from, and two by hash."""
    size = F.col("n") - F.ceil(F.col("n") * share / 100) + 1
    ranked = _tokens(members.withColumn("alone", size - F.size("tokens")), "row", "alone").withColumns({"h1": F.xxhash64("row"), "h2": F.xxhash64("row", F.lit(1))})
    first = [F.min(F.struct(*order, "row")).row.alias(f"p{i}") for i, order in enumerate((("alone", "h1"), ("h1",), ("h2",)))]
    pivots = ranked.groupBy("token").agg(F.count("*").alias("c"), *first).where("c > 1").select("token", F.array_distinct(F.array("p0", "p1", "p2")).alias("p"))
    met = _tokens(members, "row").join(pivots, "token").select(F.explode("p").alias("u"), F.col("row").alias("v")).where("u <> v")
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _wholes(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """digest, whole: the sets of the documents whose digest is among ``wanted``. They are made anew from the texts, because
    few of them are ever needed; a bit table of fixed size tells which, and some others."""
    key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    given = bit_table(wanted.select(key.alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = opened([given])[0], set()
        for _, fp, begin in _sets(batches, size):
            sets = [fp[b:e].tobytes() for b, e in zip(begin, begin[1:]) if e > b]
            digests = [xxhash.xxh128_digest(x) for x in sets]
            keys = np.array([_key(d) for d in digests], dtype=np.int64).view(np.uint64)
            found = [(d, x) for d, x, use in zip(digests, sets, holds(table, keys)) if use and d not in seen]
            seen.update(d for d, _ in found)  # copies in a task: once
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["digest", "whole"])

    made = docs.select("text").mapInArrow(run, "digest binary, whole binary")
    return made.groupBy("digest").agg(F.first("whole").alias("whole"))


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, size: int, share: int) -> DataFrame:
    """The pairs whose whole sets are similar enough. The sets of ``v`` come to that of ``u``, SIDES of them in a unit."""
    ids = members.select("row", "digest")
    pairs = _staged(pairs.join(ids.toDF("u", "du"), "u").join(ids.toDF("v", "dv"), "v"), "pairs")
    sets = _wholes(docs, size, pairs.select(F.col("du").alias("digest")).union(pairs.select("dv")))
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / SIDES).cast("int").alias("units"))
    dealt = pairs.join(many, "u").withColumn("unit", F.pmod(F.xxhash64("v"), F.col("units")).cast("int"))
    heads = dealt.select("u", "unit", F.col("du").alias("digest")).distinct().join(sets, "digest").select("u", "unit", F.lit(None).cast("long").alias("v"), "whole")
    sides = dealt.select("u", "unit", "v", F.col("dv").alias("digest")).join(sets, "digest").select("u", "unit", "v", "whole")
    placed = heads.union(sides).repartition("u", "unit").sortWithinPartitions("u", "unit", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            found = []
            for u, v, whole in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("whole").to_pylist()):
                now = np.frombuffer(whole, dtype=np.uint64)
                if v is None:
                    head = now
                    continue
                at = np.searchsorted(head, now)
                at[at == len(head)] = 0
                both = int((head[at] == now).sum())
                if 100 * both >= share * (len(head) + len(now) - both):
                    found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return placed.mapInArrow(run, "u long, v long")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end with a unit (equal token, a, b)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in ("token", "a", "b"):
            x = batch.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
            if held:
                change[0] |= x[0] != held[-1].column(c)[-1].as_py()
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held and change.any():
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif change.any():
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut) if change.any() else batch)
    if held:
        yield pa.Table.from_batches(held)


def _near_pairs(table: pa.Table, share: int) -> Iterator[np.ndarray]:
    """Pairs of members (2 x pairs) of the units of a table that pass all filters."""
    rows = table.combine_chunks().to_batches()[0]
    token, a, b, block, place, n = (rows.column(c).to_numpy() for c in ("token", "a", "b", "block", "place", "n"))
    gid = np.array([x[:8] for x in rows.column("gid").to_pylist()], dtype="S8")
    members = rows.column("members")
    begin = members.offsets.to_numpy() - members.offsets[0].as_py()
    inside = members.flatten()
    sid, root = inside.field("row").to_numpy(), inside.field("root").to_numpy()
    sketch = _matrix(inside.field("sketch"))
    given = rows.column("heads")
    many = np.diff(given.offsets.to_numpy())
    some = np.arange(HEADS) < many[:, None]
    heads = np.zeros((len(token), HEADS), dtype=np.int64)
    heads[some] = given.flatten().to_numpy()
    here = (heads == token[:, None]) & some
    upto = np.where(here.any(axis=1), here.argmax(axis=1), many)  # heads that come before this shingle
    unit = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))

    def expanded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Member pairs of group pairs in different components, by their sketches."""
        wide, tall = begin[x + 1] - begin[x], begin[y + 1] - begin[y]
        each = wide * tall
        of = np.repeat(np.arange(len(x)), each)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        u, v = begin[x][of] + nth // tall[of], begin[y][of] + nth % tall[of]
        apart = root[u] != root[v]
        u, v, of = u[apart], v[apart], of[apart]
        near = _apart(sketch[u], sketch[v]) <= _most_apart(n[x][of], n[y][of], share)
        u, v = sid[u[near]], sid[v[near]]
        return np.stack([np.maximum(u, v), np.minimum(u, v)])

    left = np.arange(len(unit))
    k = 0
    while len(left):
        y = left + k
        good = (n[left] * 100 >= n[y] * share) & (n[y] * 100 >= n[left] * share)
        need = -(-share * (n[left] + n[y]) // (100 + share))
        good &= 1 + np.minimum(n[left] - place[left] - 1, n[y] - place[y] - 1) >= need
        good &= (a[left] == b[left]) | (block[left] != block[y])
        same = gid[left] == gid[y]
        good &= ~same | ((place[left] == 0) & (a[left] == b[left]) | (place[left] == 0) & (block[left] != block[y]))
        x, y = left[good], y[good]
        fresh = np.ones(len(x), dtype=bool)
        for i in range(0, len(x), 1 << 16):  # a pair that shares an earlier shingle has met there
            p, q = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
            before = (np.arange(HEADS) < upto[p][:, None])[:, :, None] & some[q][:, None, :]
            fresh[i : i + (1 << 16)] = ~((heads[p][:, :, None] == heads[q][:, None, :]) & before).any(axis=(1, 2))
        x, y = x[fresh], y[fresh]
        each = np.cumsum((begin[x + 1] - begin[x]) * (begin[y + 1] - begin[y]))
        step = 0
        while step < len(x):  # about a million member pairs at once
            end = max(step + 1, int(np.searchsorted(each, (each[step - 1] if step else 0) + (1 << 20), "right")))
            yield expanded(x[step:end], y[step:end])
            step = end
        k += 1
        left = left[left + k < len(unit)]
        left = left[unit[left] == unit[left + k]]


def _candidates(members: DataFrame, roots: DataFrame, share: int) -> DataFrame:
    """Pairs (u, v) of members of different components that pass the filters."""
    named = members.join(roots.toDF("row", "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    mixed_lists = _tokens(named, "root").groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    wanted = _tokens(members, "row").join(mixed_lists, "token").select("row", "token", "place")
    size = members.groupBy("gid").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("subs"))
    sub = named.join(size, "gid").withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    groups = sub.groupBy("gid", "sub").agg(F.first("n").alias("n"), F.first(F.slice("tokens", 1, HEADS)).alias("heads"), F.collect_list(F.struct("row", "root", "sketch")).alias("members"))
    of = wanted.join(members.select("row", "gid"), "row").select("token", "place", "gid").distinct()
    index = of.join(groups, "gid").withColumn("h", F.xxhash64("gid", "sub"))
    full = of.join(groups.select("gid", "sub"), "gid").groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = (
        index.join(full, "token")
        .withColumn("block", F.pmod("h", F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "place", "n", "gid", "heads", "members")
        .repartition("token", "a", "b")
        .sortWithinPartitions("token", "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for table in _units(batches):
            for pairs in _near_pairs(table, share):
                held.append(pairs)
                if sum(p.shape[1] for p in held) > 1 << 20:
                    held = [np.unique(np.concatenate(held, axis=1), axis=1)]
                    if held[0].shape[1] > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], ["u", "v"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(held, axis=1), axis=1)], ["u", "v"])

    return placed.mapInArrow(run, "u long, v long").distinct()


def _staged(df: DataFrame, label: str) -> DataFrame:
    with freed(df.sparkSession):
        return stage(df, label)


def near_duplicates(docs: DataFrame, size: int = 4, share: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) of every row of ``docs``.

    Words are A-Z lower-cased runs without ASCII white space; a set holds the distinct shingles of ``size`` words, or the
    whole sequence if there are fewer. Rows link if 100 * intersection >= ``share`` * union. Null texts and texts
    without words have no set and link with nothing: their component is their own doc_id. Equal sets link; repeated rows
    stay. A null doc_id stays null and names a component only if no other row of it has an id. Shingles are compared by
    64-bit fingerprints, equal sets by 128 bits. An empty table gives no rows; other columns are not read.
    """
    counts = _staged(_counts(docs, size), "shared-shingles")
    profiles = _staged(_profiles(docs, size, share, bit_table(counts), bit_table(counts.where(F.col("c") > COMMON))), "profiles")
    first = profiles.where("n > 0").groupBy("digest").agg(F.min("row").alias("sid"))
    copies = _staged(profiles.where("n > 0").select("row", "doc_id", "digest").join(first, "digest").select("row", "doc_id", "sid"), "copies")
    firsts = copies.where("row = sid").select("row")
    columns = ["row", "n", "digest", "gid", "tokens", "places", "sketch", "wide"]
    members = _staged(profiles.where("gid is not null").select(*columns).join(firsts, "row", "left_semi"), "members")
    links = _staged(_verified(_sieved(_pivots(members, share), members, share), members, docs, size, share), "links")
    roots = components(links)
    near = _candidates(members.select("row", "n", "gid", "tokens", "places", "sketch"), roots, share)
    more = _staged(_verified(_sieved(near, members, share), members, docs, size, share), "more-links")
    merged = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    classed = copies.join(merged.toDF("sid", "root"), "sid", "left").select("row", "doc_id", F.coalesce("root", "sid").alias("root"))
    lowest = classed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = classed.join(lowest, "root").select("row", "component_id")
    out = profiles.select("row", "doc_id", F.col("n").alias("n_shingles")).join(named, "row", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
