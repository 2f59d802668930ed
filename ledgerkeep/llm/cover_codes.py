"""Vector code compression: product codes whose codebooks come from Lloyd rounds over cover trees.

Each task turns blocks of its rows into cover trees, one per part of the vectors, and writes them once. A round walks
down the trees: if the entry nearest to a node's centre is nearer than any other by more than twice the node's radius,
the triangle inequality gives that entry to the whole subtree, whose sum is a difference of cumulative sums; only
ambiguous nodes go on to their children, and the members of ambiguous leaves are compared exactly. A task hands on one
sum per entry; the driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerkeep.llm.common import stage
from ledgerkeep.operators.sizing import broadcast_if_small
from ledgerkeep.sources.tables import spread

#: Rows of a block, components of a block, and members of a leaf, at most.
ROWS, COMPONENTS, LEAF = 4096, 1 << 19, 12
#: Components beyond this size in either direction count as this size.
LARGEST = 10**12
_LONG = (1 << 63) - 1
#: Slack on both sides of a comparison of square roots.
_SLACK = 1e-9


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x entries: products of doubles where all sums stay below 2^53, else Python integers."""
    width = points.shape[1]
    most = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    if 4 * width * most * most < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None]
    out = np.empty((len(points), len(entries)), dtype=object)
    for k, entry in enumerate(entries.astype(object)):
        out[:, k] = ((points.astype(object) - entry) ** 2).sum(axis=1)
    return out


class Tree:
    """A cover tree over the rows of an integer matrix. Nodes are numbered level by level; node i holds the rows
    order[begin[i]:end[i]], all within radius[i] of the row centre[i], and has the nodes child[i]..child[i] + children[i]."""

    FIELDS = ("order", "centre", "radius", "begin", "end", "child", "children")

    def __init__(self, points: np.ndarray, stored: dict[str, np.ndarray] | None = None):
        self.points = points
        if stored is None:
            stored = self._built()
        for name in self.FIELDS:
            setattr(self, name, stored[name])
        self.sums = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
        np.cumsum(points[self.order], axis=0, out=self.sums[1:])

    def _built(self) -> dict[str, np.ndarray]:
        order = np.arange(len(self.points))
        nodes: list[list] = []  # centre, radius, begin, end, child, children

        def node(begin: int, end: int) -> None:
            """The first row of the range is the centre."""
            away = squared(self.points[order[begin : begin + 1]], self.points[order[begin:end]])[0]
            nodes.append([order[begin], float(np.sqrt(float(away.max()))), begin, end, 0, 0])

        if len(order):
            node(0, len(order))
        at = 0
        while at < len(nodes):
            _, radius, begin, end, _, _ = nodes[at]
            if radius > 0 and end - begin > LEAF:
                nodes[at][4] = len(nodes)
                rest = order[begin:end].copy()
                while len(rest):  # greedy cover at half the radius: no two centres are closer than that
                    away = squared(self.points[rest[:1]], self.points[rest])[0].astype(np.float64)
                    near = np.sqrt(away) <= radius / 2
                    size = int(near.sum())
                    order[begin : begin + size], rest = rest[near], rest[~near]
                    node(begin, begin + size)
                    begin += size
                nodes[at][5] = len(nodes) - nodes[at][4]
            at += 1
        columns = list(zip(*nodes)) or [[]] * 6
        return {"order": order} | {n: np.array(c, dtype=np.float64 if n == "radius" else np.int64) for n, c in zip(self.FIELDS[1:], columns)}

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest entry of each row (ties: the lower), sums and counts by entry, and how many rows were compared one by one."""
        label = np.zeros(len(self.points), dtype=np.int64)
        sums, counts = np.zeros(entries.shape, dtype=np.int64), np.zeros(len(entries), dtype=np.int64)
        single = 0
        front = np.arange(min(1, len(self.centre)))
        while len(front):
            away = squared(self.points[self.centre[front]], entries)
            best = away.argmin(axis=1)
            rows = np.arange(len(front))
            roots = np.sqrt(away.astype(np.float64))
            first = roots[rows, best]
            roots[rows, best] = np.inf
            radius = self.radius[front]
            sure = (radius == 0) | ((first + 2 * radius) * (1 + _SLACK) < roots.min(axis=1) * (1 - _SLACK))
            for i in np.flatnonzero(sure):
                label[self.order[self.begin[front[i]] : self.end[front[i]]]] = best[i]
            done = front[sure]
            np.add.at(sums, best[sure], self.sums[self.end[done]] - self.sums[self.begin[done]])
            np.add.at(counts, best[sure], self.end[done] - self.begin[done])
            open_ = front[~sure]
            inner = open_[self.children[open_] > 0]
            leaves = open_[self.children[open_] == 0]
            members = [self.order[b:e] for b, e in zip(self.begin[leaves], self.end[leaves])]
            if members:
                member = np.concatenate(members)
                nearest = squared(self.points[member], entries).argmin(axis=1)
                label[member] = nearest
                np.add.at(sums, nearest, self.points[member])
                np.add.at(counts, nearest, 1)
                single += len(member)
            front = np.concatenate([np.arange(c, c + n) for c, n in zip(self.child[inner], self.children[inner])]) if len(inner) else inner
        return label, sums, counts, single


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(1024 * np.clip(vectors, -LARGEST, LARGEST)).astype(np.int64)


def _pack(points: np.ndarray, parts: int) -> bytes:
    file = io.BytesIO()
    width = points.shape[1] // parts
    trees = {f"{n}{p}": getattr(tree, n) for p in range(parts) for tree in [Tree(points[:, p * width : (p + 1) * width])] for n in Tree.FIELDS}
    np.savez(file, points=points, **trees)
    return file.getvalue()


def _unpack(blob: bytes, parts: int) -> list[Tree]:
    stored = np.load(io.BytesIO(blob), allow_pickle=False)
    points = stored["points"]
    width = points.shape[1] // parts
    return [Tree(points[:, p * width : (p + 1) * width], {n: stored[f"{n}{p}"] for n in Tree.FIELDS}) for p in range(parts)]


def _blocks(kept: DataFrame, parts: int) -> DataFrame:
    """dim, ids, labels, trees: blocks of rows of one length, with their trees."""
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0

        def block(dim: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            step = max(1, min(ROWS, COMPONENTS // max(1, dim)))
            for i in range(0, rows.num_rows, step):
                some = rows.slice(i, step).combine_chunks().to_batches()[0]
                points = integers(some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, dim))
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *lists, pa.array([_pack(points, parts)], pa.binary())], ["dim", "ids", "labels", "trees"])

        for batch in batches:
            dims = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                held.setdefault(int(dim), []).append(batch.filter(pa.array(dims == dim)))
            size += batch.num_rows * (1 + int(dims.max(initial=0)))
            if size >= COMPONENTS:
                for dim in list(held):
                    yield from block(dim, pa.Table.from_batches(held.pop(dim)))
                size = 0
        for dim, some in held.items():
            yield from block(dim, pa.Table.from_batches(some))

    return kept.mapInArrow(run, f"dim int, ids array<{fields['id']}>, labels array<{fields['label']}>, trees binary")


def _sums(blocks: DataFrame, given, parts: int) -> DataFrame:
    """dim, part, entry, n, place, s: what a task adds up for the entries that got rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}  # (dim, part): sums, counts, bound of the sums

        def rows(dim: int, part: int) -> pa.RecordBatch:
            sums, counts, _ = totals.pop((dim, part))
            entry = np.flatnonzero(counts)
            k = len(entry)
            of = [pa.array(np.full(k, x, dtype=np.int32)) for x in (dim, part)]
            return pa.RecordBatch.from_arrays([*of, pa.array(entry.astype(np.int32)), pa.array(counts[entry]), pa.array(sums[entry].tolist(), pa.list_(pa.int64()))], ["dim", "part", "entry", "n", "s"])

        for batch in batches:
            for dim, blob in zip(batch.column("dim").to_pylist(), batch.column("trees")):
                for part, tree in enumerate(_unpack(blob.as_buffer(), parts)):
                    _, sums, counts, _ = tree.assign(given.value[dim][part])
                    bound = len(tree.points) * int(np.abs(tree.points).max()) if tree.points.size else 0
                    if (dim, part) in totals and totals[dim, part][2] + bound > _LONG:
                        yield rows(dim, part)
                    old = totals.setdefault((dim, part), [0, 0, 0])
                    totals[dim, part] = [old[0] + sums, old[1] + counts, old[2] + bound]
        for dim, part in list(totals):
            yield rows(dim, part)

    found = blocks.select("dim", "trees").mapInArrow(run, "dim int, part int, entry int, n long, s array<long>")
    flat = found.select("dim", "part", "entry", "n", F.posexplode("s").alias("place", "s"))
    return flat.groupBy("dim", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def digest(codebook: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebook.ravel().tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, code, error, label_error, codebooks_sha256 of every kept row.

    Rows whose vector is null or holds null or non-finite components go, and so do lengths that ``parts`` does not
    divide. Each other length has codebooks of its own, so any mix of lengths is coded; an empty vector has error zero. The
    first codebook takes the rows of smallest id, null ids last, equal ids by their components; fewer rows give fewer
    entries. Repeated rows count each time. Components are floor(1024 x), those beyond 10^12 count as that; errors beyond a
    long count as the largest long. label_error adds up the errors of equal labels, nulls together. Other columns are not
    read. The driver holds the codebooks: entries x length numbers for each length. An empty table gives no rows.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = spread(vectors).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kept = named.where(v.isNotNull() & finite & (F.size(v) % parts == 0))
    blocks = stage(_blocks(kept, parts), "cover-trees")
    order = Window.partitionBy("dim").orderBy(F.col("id").asc_nulls_last(), F.col("whole"))
    whole = F.transform("v", lambda x: F.floor(1024 * F.greatest(F.least(x, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))
    seeds = kept.select("id", F.size("v").alias("dim"), whole.alias("whole")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= entries)
    books: dict[int, np.ndarray] = {}
    for dim, rows in _by_dim(seeds.orderBy("dim", "nth").select("dim", "whole").collect()).items():
        books[dim] = np.array(rows, dtype=np.int64).reshape(len(rows), parts, dim // parts).transpose(1, 0, 2).copy()
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds if books else 0):
        given = context.broadcast(books)
        sums = _sums(blocks, given, parts).collect()
        books = {dim: book.copy() for dim, book in books.items()}
        for dim, part, entry, place, n, s in sums:
            books[dim][part, entry, place] = int(s) // n
    final = context.broadcast({dim: (book, digest(book)) for dim, book in books.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                book, sha = final.value[dim]
                trees = _unpack(batch.column("trees")[i].as_buffer(), parts)
                found = [tree.assign(book[p])[0] for p, tree in enumerate(trees)]
                errors = sum(_errors(tree.points, book[p][found[p]]) for p, tree in enumerate(trees))
                code = ["".join(f"{int(x):02x}" for x in row) for row in zip(*found)]
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                error = pa.array([min(int(e), _LONG) for e in errors], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), error, pa.array([sha] * len(code), pa.string())], ["id", "label", "code", "error", "codebooks_sha256"])

    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    coded = stage(blocks.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string"), "codes")
    added = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(added.alias("label_error"))
    joined = coded.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label), "code", "error", "label_error", "codebooks_sha256")


def _errors(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to their entries."""
    apart = points - entries
    most = int(np.abs(apart).max()) if apart.size else 0
    return ((apart if apart.shape[1] * most * most <= _LONG else apart.astype(object)) ** 2).sum(axis=1).astype(object)


def _by_dim(rows) -> dict[int, list]:
    out: dict[int, list] = {}
    for dim, whole in rows:
        out.setdefault(dim, []).append(whole)
    return out
