"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased; shingles are ``SHINGLE`` words. For an item of n words the windows
of a document are its runs of n words (the whole document, if it is shorter). Of these, all that hold enough places of
shingles known from items of n words are looked at: with m shingles in the item and k in the window, a similarity of t
takes t * (m + k) / (1 + t) shingles in common, so no other window can reach it.
Each window gets a 64-bit SimHash of its shingles, repeats counted. The fingerprint is cut into ``radius + 1`` blocks:
two fingerprints within the radius agree in one block at least, so a join on (size, block, value) finds them all. Pairs
within the radius are verified by weighted Jaccard similarity of the shingles, a shingle's weight being its count.

Only DataFrame functions are used. The benchmark's shingles are broadcast in blocks of at most ``SHINGLE_ROWS`` rows,
with one pass over the documents per block; nothing that grows with the documents is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkeep.llm.common import stage

SHINGLE = 5
SIMILARITY = 0.8
#: Of 64 bits. Shingle sets of similarity 0.8 differ in 10 bits on average, with a deviation of 3.
RADIUS = 15
#: Benchmark shingles broadcast at once (16 bytes each, and some overhead).
SHINGLE_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(df: DataFrame, column: str) -> DataFrame:
    """Replace the word array ``column`` by the hashes of its shingles (empty below SHINGLE words) and add ``n_words``."""
    w = F.col(column)
    hashed = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - SHINGLE),
        lambda i: F.xxhash64(*(F.get(w, i + F.lit(j)) for j in range(SHINGLE))),
    )
    sized = df.withColumn("n_words", F.size(w))
    return sized.withColumn("shingles", F.when(F.col("n_words") >= SHINGLE, hashed).otherwise(F.array().cast("array<bigint>"))).drop(column)


def simhash(hashes: str) -> Column:
    """Bits set in over half of the hashes in the array column ``hashes``.

    Two 32-bit counters share a long, so 32 sums give 64 counts.
    """
    return F.expr(
        f"""aggregate(
            transform(
                transform(sequence(0, 31), b -> aggregate({hashes}, 0L, (s, h) -> s + (shiftrightunsigned(h, b) & 4294967297L))),
                (c, b) -> if((c & 4294967295L) * 2 > size({hashes}), shiftleft(1L, b), 0L) | if(shiftrightunsigned(c, 32) * 2 > size({hashes}), shiftleft(1L, b + 32), 0L)),
            0L, (f, x) -> f | x)"""
    )


def _blocks(fp: str, radius: int) -> Column:
    """(block number, bits) of the ``radius + 1`` blocks of the fingerprint column ``fp``, as one small loop."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    places = ", ".join(f"struct({i} AS block, {a} AS low, {(1 << (b - a)) - 1 if b - a < 64 else -1}L AS mask)" for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return F.expr(f"transform(array({places}), p -> struct(p.block AS block, shiftrightunsigned({fp}, p.low) & p.mask AS bits))")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle arrays: sum of the lesser counts over sum of the greater ones."""

    def repeated(x: Column) -> Column:
        s = F.array_sort(x)
        return F.array_distinct(F.filter(s, lambda v, i: (i > 0) & (F.get(s, i - 1) == v)))

    def count(x: Column, v: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == v))

    more = F.aggregate(F.array_intersect(repeated(a), repeated(b)), F.lit(0), lambda s, v: s + F.least(count(a, v), count(b, v)) - 1)
    both = F.size(F.array_intersect(a, b)) + more
    # a lambda binds the overlap, so that it is computed once
    return F.element_at(F.transform(F.array(both), lambda n: n / (F.size(a) + F.size(b) - n)), 1)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, doc_key, item_id, start, similarity): the best window of each document row and benchmark item that reach
    ``threshold``; of equal ones the first.

    ``docs`` has doc_id and text, ``items`` has item_id and text. ``doc_key`` tells apart rows of one doc_id with
    different texts; repeated rows give one result. Null texts are empty. Documents and items below SHINGLE words have
    no shingle and match nothing. Null ids stay null.
    """
    listed = stage(
        _shingles(items.select("item_id", words(F.col("text")).alias("words")), "words").where(F.col("n_words") >= SHINGLE).distinct(), "items"
    )
    known = stage(listed.select(F.explode("shingles").alias("shingle"), F.col("n_words").alias("size")).distinct(), "item-shingles")
    passes = max(1, -(-known.count() // SHINGLE_ROWS))
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), words(F.col("text")).alias("words"))
    split = _shingles(texts, "words")
    # outer, because Spark would put a filter on the array below an inner one and compute the words there again
    placed = split.select("doc_id", "doc_key", "n_words", F.posexplode_outer("shingles").alias("at", "shingle"))

    def hits(part: int) -> DataFrame:
        some = known.where(F.pmod("shingle", F.lit(passes)) == part) if passes > 1 else known
        return placed.join(F.broadcast(some), "shingle").select("doc_id", "doc_key", "n_words", "size", "at")

    # places of one document row are as many as its words at most
    held = reduce(DataFrame.union, [hits(i) for i in range(passes)]).groupBy("doc_id", "doc_key", "n_words", "size").agg(F.collect_set("at").alias("places"))
    length = F.least("size", "n_words") - (SHINGLE - 1)
    common = F.ceil(threshold * (length + F.col("size") - (SHINGLE - 1)) / (1 + threshold) - 1e-9).cast("int")
    sized = held.select("doc_id", "doc_key", "size", length.alias("length"), F.greatest(F.lit(1), common).alias("need"), (F.col("n_words") - (SHINGLE - 1) - length).alias("last"), F.array_sort("places").alias("p"))
    # every run of ``need`` places that fits a window gives the starts of all windows around it
    starts = F.expr(
        """array_distinct(flatten(transform(
            filter(sequence(0, size(p) - need), i -> p[i + need - 1] - p[i] < length),
            i -> sequence(greatest(0, p[i + need - 1] - length + 1), least(p[i], last)))))"""
    )
    tried = stage(sized.where(F.size("p") >= F.col("need")).withColumn("starts", starts).where(F.size("starts") > 0).select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key"), "size", "length", "starts"), "window-starts")
    found = (
        split.join(tried, (F.col("doc_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
        .select("doc_id", "doc_key", "size", "length", "shingles", F.explode("starts").alias("start"))
        .select("doc_id", "doc_key", "size", "start", F.slice("shingles", F.col("start") + 1, F.col("length")).alias("window"))
    )
    once = found.groupBy("doc_id", "doc_key", "size", "start").agg(F.first("window").alias("window"))
    marked = stage(once.withColumn("fp", simhash("window")), "windows")
    sought = stage(
        listed.select("item_id", F.col("n_words").alias("size"), F.col("shingles").alias("item"), simhash("shingles").alias("item_fp")), "item-fingerprints"
    )
    bucket = ["size", "block", "bits"]
    left = marked.select("doc_id", "doc_key", "size", "start", "fp", F.explode(_blocks("fp", radius)).alias("b")).select("*", "b.*").drop("b")
    right = sought.select("item_id", "size", "item_fp", F.explode(_blocks("item_fp", radius)).alias("b")).select("*", "b.*").drop("b")
    pairs = (
        left.join(right, bucket)
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("doc_id", "doc_key", "size", "start", "item_id", "item_fp").distinct()
    )
    same_item = (pairs.item_id.eqNullSafe(sought.item_id)) & (pairs.size == sought.size) & (pairs.item_fp == sought.item_fp)
    with_item = pairs.join(sought, same_item).select(pairs.doc_id, "doc_key", pairs["size"], "start", pairs.item_id, "item")
    m = marked.select(F.col("doc_id").alias("d"), F.col("doc_key").alias("k"), F.col("size").alias("s"), F.col("start").alias("at"), "window")
    same_window = (F.col("doc_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("s")) & (F.col("start") == F.col("at"))
    scored = with_item.join(m, same_window).select("doc_id", "doc_key", "item_id", "start", similarity(F.col("window"), F.col("item")).alias("similarity"))
    best = scored.where(F.col("similarity") >= threshold).groupBy("doc_id", "doc_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "doc_key", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns of ``docs``."""
    bad = stage(contaminated(docs, items, threshold, radius).select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key")).distinct(), "contaminated")
    key = F.xxhash64(docs.doc_id, docs.text)
    return docs.join(bad, (key == bad["__key"]) & docs.doc_id.eqNullSafe(bad["__id"]), "left_anti")
