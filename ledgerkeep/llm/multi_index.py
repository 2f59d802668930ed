"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centres, so the pairs of centres are the cells. Each half of an
entry gets one more component, the root of M^2 less its squared norm, M being the largest norm of that half; a query's halves
get a zero there. Then the sum of the two squared distances orders entries as the inner product does, whatever their norms.
A query walks the cells by the sum of its two squared distances, nearest first, with a heap over pairs, until the cells
seen hold ``SHARE`` of all distinct vectors. The entries of those cells are reranked by the exact inner product of the
original vectors. Repeats of a vector count once towards the share, so a cell of copies does not use it up.

Entries are dealt by the first centre and, where that list is long, by hash into pieces of about ``PIECE`` rows; a
query meets a piece only if it visits a cell of it. A task holds one piece and a batch of queries and hands on its best
rows per query, so no cell, query or list is ever whole in one place. The centres are fitted on a bounded sample.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerkeep.llm.common import stage

#: Centres of a half: the root of the entries over ROOT, between these.
CENTROIDS, ROOT, MOST = 32, 7, 256
#: About so many vectors, chosen by hash, fit the centres.
SAMPLE = 20_000
#: Of the distinct vectors, in the cells that a query visits. Random 64-dimensional vectors need this much for 0.95.
SHARE = 0.6
PIECE = 4096
QUERIES = 1024
ROUNDS = 12


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that can take part, one per vec_id (the least vector of a repeated id).

    Null ids, and vectors that are null, empty, zero or hold a null or non-finite component, take no part.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    known = vectors.select("vec_id", x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
    return known.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from evenly spread distinct rows."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = x[own == j].mean(0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows x centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres**2).sum(1), 0)


class Halves:
    """Centres of both halves, with the added component."""

    def __init__(self, half: int, most: tuple[float, float]):
        self.half, self.most = half, most
        self.first = self.second = np.zeros((0, 0))

    def entries(self, x: np.ndarray) -> list[np.ndarray]:
        parts = (x[:, : self.half], x[:, self.half :])
        return [np.hstack([p, np.sqrt(np.maximum(m - (p * p).sum(1), 0))[:, None]]) for p, m in zip(parts, self.most)]

    def queries(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.hstack([p, np.zeros((len(x), 1))]) for p in (x[:, : self.half], x[:, self.half :])]


def fit(entries: DataFrame, k: int, rows: int = SAMPLE) -> Halves:
    """Largest norms over all entries; centres from a sample of about ``rows`` vectors chosen by the hash of their id."""
    x = F.col("embedding")
    total, length = entries.agg(F.count("*"), F.max(F.size(x))).first()
    half = length // 2
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    most = entries.agg(F.max(square(F.slice(x, 1, half))), F.max(square(F.slice(x, half + 1, length - half)))).first()
    halves = Halves(half, (float(most[0]), float(most[1])))
    share = min(1.0, rows / max(1, total))
    some = entries.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("embedding").toArrow()
    sample = halves.entries(np.vstack([_matrix(c) for c in some.column("embedding").chunks if len(c)]))
    halves.first, halves.second = (_centres(h, k) for h in sample)
    return halves


def assign(entries: DataFrame, halves: Halves) -> DataFrame:
    """``entries`` with the centres ``a`` and ``b`` of their halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = halves.entries(_matrix(batch.column("embedding")))
            a, b = _nearest(first, halves.first), _nearest(second, halves.second)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["vec_id", "embedding", "a", "b"])

    return entries.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, a int, b int")


def walk(da: np.ndarray, db: np.ndarray, weight: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Cells (a, b) by ascending da[a] + db[b], until their weights add up to ``enough``; empty cells are left out."""
    ia, ib = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
    sa, sb = np.sort(da).tolist(), np.sort(db).tolist()
    heap, seen, out = [(sa[0] + sb[0], 0, 0)], 0.0, []
    while heap and seen < enough:
        _, i, j = heapq.heappop(heap)
        w = weight[ia[i], ib[j]]
        if w:
            out.append((ia[i], ib[j]))
            seen += w
        if j + 1 < len(sb):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):  # each pair has one way into the heap
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(vectors: DataFrame, queries: DataFrame, k: int, share: float = SHARE, centroids: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for each query, by largest inner product.

    ``vectors`` has vec_id and embedding; ``queries`` has vec_id, and those of them that are among the valid vectors
    are asked. A query's own id is no candidate, nor are vectors of another length: each length is searched by itself.
    Ties go to the smaller vec_id. Fewer candidates than ``k`` give all that there are. Without valid vectors the
    result is empty.
    """
    spark = vectors.sparkSession
    entries = stage(valid(vectors), "vectors")
    asked = stage(entries.join(queries.select("vec_id").distinct(), "vec_id", "left_semi"), "asked")
    lengths = sorted(r[0] for r in entries.select(F.size("embedding")).distinct().collect())
    found = [_search(*(d.where(F.size("embedding") == n) if len(lengths) > 1 else d for d in (entries, asked)), k, share, centroids) for n in lengths]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(entries: DataFrame, asked: DataFrame, k: int, share: float, centroids: int | None) -> DataFrame:
    """The same for valid vectors of one length."""
    spark = entries.sparkSession
    halves = fit(entries, centroids or int(min(MOST, max(CENTROIDS, entries.count() ** 0.5 / ROOT))))
    first, second = halves.first, halves.second
    placed = stage(assign(entries, halves), "multi-index")
    marks = placed.groupBy("a", "b", F.xxhash64("embedding").alias("mark")).agg(F.count("*").alias("n"))
    cells = marks.groupBy("a", "b").agg(F.count("*").alias("distinct"), F.sum("n").alias("rows")).collect()
    weight = np.zeros((len(first), len(second)))
    for c in cells:
        weight[c.a, c.b] = c.distinct
    lists = {a: sum(c["rows"] for c in cells if c.a == a) for a in {c.a for c in cells}}
    total = sum(c["rows"] for c in cells)
    # all cells, where even the share could hold too few rows
    enough = max(share * weight.sum(), float(min(k + 1, weight.sum()))) if total > 4 * k else float("inf")
    pieces = {a: -(-n // PIECE) for a, n in lists.items()}
    count = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{a}":{n}' for a, n in pieces.items()) + "}"), "map<string,int>"), F.col("a").cast("string"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"))
            da, db = (_distances(h, c) for h, c in zip(halves.queries(x), (first, second)))
            row, a, visited = [], [], []
            for i in range(len(x)):
                found: dict[int, list[int]] = {}
                for ca, cb in walk(da[i], db[i], weight, enough):
                    found.setdefault(ca, []).append(cb)
                for ca, cbs in found.items():
                    row.append(i)
                    a.append(ca)
                    visited.append(cbs)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(rows), batch.column("embedding").take(rows), pa.array(a, pa.int32()), pa.array(visited, pa.list_(pa.int32()))],
                ["vec_id", "embedding", "a", "visited"],
            )

    visits = asked.repartition(max(spark.sparkContext.defaultParallelism, 1)).mapInArrow(visit, "vec_id long, embedding array<double>, a int, visited array<int>")
    unit = ["a", "piece"]
    held = placed.select("a", F.pmod(F.xxhash64("vec_id", F.lit(7)), count).cast("int").alias("piece"), F.lit(0).alias("kind"), "vec_id", "embedding", F.array("b").alias("cells"))
    sought = visits.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1))).select("a", "piece", F.lit(1).alias("kind"), "vec_id", "embedding", F.col("visited").alias("cells"))
    dealt = held.union(sought).repartition(*unit).sortWithinPartitions(*unit, "kind")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        ids: list[np.ndarray] = []
        vecs: list[np.ndarray] = []
        cell: list[np.ndarray] = []
        ready: tuple | None = None

        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            own_ids, own, own_cell = ready
            q, qid, wanted = _matrix(part.column("embedding")), part.column("vec_id").to_numpy(), part.column("cells").to_pylist()
            starts = np.searchsorted(own_cell, np.arange(len(second) + 1))
            rough = q @ own.T
            out_q, out_v, out_s = [], [], []
            for i in range(len(q)):
                spans = [np.arange(starts[c], starts[c + 1]) for c in wanted[i]]
                rows = np.concatenate(spans) if spans else np.zeros(0, dtype=int)
                rows = rows[own_ids[rows] != qid[i]]
                if not len(rows):
                    continue
                near = rough[i, rows]
                if len(rows) > k:
                    least = np.partition(near, len(near) - k)[len(near) - k]
                    rows = rows[near >= least - 1e-9 * (1 + abs(least))]
                exact = (own[rows] * q[i]).sum(axis=1)  # the same order of additions for equal vectors, so ties stay ties
                top = _best(own_ids[rows], exact, k)
                out_q.append(np.full(len(top), qid[i]))
                out_v.append(own_ids[rows][top])
                out_s.append(exact[top])
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
            return pa.RecordBatch.from_arrays([pa.array(cat(out_q, np.int64)), pa.array(cat(out_v, np.int64)), pa.array(cat(out_s, np.float64))], ["query_id", "vec_id", "score"])

        for batch in batches:
            a, piece, kind = (batch.column(n).to_numpy() for n in ("a", "piece", "kind"))
            change = np.flatnonzero((a[1:] != a[:-1]) | (piece[1:] != piece[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if e == s:
                    continue
                if (a[s], piece[s]) != now:
                    now, ready, ids, vecs, cell = (a[s], piece[s]), None, [], [], []
                part = batch.slice(s, e - s)
                if kind[s] == 0:
                    ids.append(part.column("vec_id").to_numpy())
                    vecs.append(_matrix(part.column("embedding")))
                    cell.append(part.column("cells").flatten().to_numpy())
                elif ids:
                    if ready is None:
                        own_cell = np.concatenate(cell)
                        order = np.argsort(own_cell, kind="stable")
                        ready = (np.concatenate(ids)[order], np.ascontiguousarray(np.vstack(vecs)[order]), own_cell[order])
                    for i in range(0, e - s, QUERIES):
                        yield answer(part.slice(i, min(QUERIES, e - s - i)))

    found = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
