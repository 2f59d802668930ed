"""Where vectors of a threshold join meet: cells around pivots, with bounds on angles.

The angle between unit vectors is a metric. Large groups get pivots, and each vector belongs to the cell of its nearest
pivot. A vector x within the angle t of some member of cell c is at most t + (radius of c) from the pivot of c, and at most 2t
farther from it than from its own pivot; it visits the cells where both hold and no others. Cells and visitors are cut
into blocks, and a unit of work is a pair of blocks. Small groups are one cell.

Pivots of all groups together are at most about ``PIVOTS``, whatever the data; so is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkeep.operators.sizing import broadcast_if_small
from ledgerkeep.session import cut

PIVOTS = 4096
CELL_ROWS = 1024
MIN_NORM = 1e-12
#: Radians added to the angle of a threshold: more than rounding can move an angle.
SLACK = 1e-6


def unit(vectors) -> np.ndarray:
    m = np.asarray(np.stack(list(vectors)), dtype=np.float64) if len(vectors) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), MIN_NORM)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _pivots(rows: DataFrame, keys: list[str], cell_rows: int) -> dict[tuple, np.ndarray]:
    """Pivots of the groups of more than ``cell_rows`` rows (and 1/PIVOTS of all): rows chosen by the hash of their id."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where(F.col("n") > max(cell_rows, total // PIVOTS))
    many = F.least(F.ceil(F.col("n") / cell_rows), F.ceil(F.lit(PIVOTS) * F.col("n") / max(1, total)))
    drawn = F.pmod(F.xxhash64("memory_id", F.lit(17)), F.lit(1 << 30)) < F.col("many") / F.col("n") * (1 << 30)
    some = rows.join(F.broadcast(large.select(*keys, "n", many.alias("many"))), keys).where(drawn).select(*keys, "vector").collect()
    found: dict[tuple, list] = {}
    for r in some:
        found.setdefault(tuple(r[k] for k in keys), []).append(r["vector"])
    return {k: p[np.linalg.norm(p, axis=1) > 0.5] for k, v in found.items() for p in [np.unique(unit(v), axis=0)] if (np.linalg.norm(p, axis=1) > 0.5).any()}


def _by_group(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    for key, at in batch.groupby(keys, sort=False, dropna=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), at


def meetings(own: DataFrame, keys: list[str], threshold: float, guests: DataFrame | None = None, block_rows: int = 2048, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Units of work (keys, _cell, _inner, _i, _j) in which all pairs of cosine at least ``threshold`` meet, each pair once.

    Without ``guests`` the pairs are those inside ``own``; with them, pairs of an own row and a guest. Both have the
    keys, memory_id and vector; other columns of ``own`` are kept, guests get NULL there. ``_guest`` tells guests and visitors
    from own rows. Where ``_inner``, the rows of the blocks _i and _j of a cell meet (a block meets itself if they are
    equal); elsewhere own rows (block _i) meet visitors (block _j). ``_b`` is the block of a row.
    """
    keys = list(keys)
    extra = [c for c in own.columns if c not in (*keys, "memory_id", "vector")]
    shared = own.sparkSession.sparkContext.broadcast(_pivots(own, keys, cell_rows) if threshold > 0 else {})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, away = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch))
            for key, at in _by_group(batch, keys):
                if key in shared.value:
                    x = unit(batch["vector"].iloc[at])
                    angles = _angles(x, shared.value[key])
                    cell[at] = angles.argmin(axis=1)
                    away[at] = np.where(np.linalg.norm(x, axis=1) > 0.5, angles.min(axis=1), 0)
            yield batch.assign(_cell=cell, _away=away)

    def kinds(df: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def placed(df: DataFrame) -> DataFrame:
        if not shared.value:
            return df.withColumns({"_cell": F.lit(0), "_away": F.lit(0.0)})
        return cut(df.mapInPandas(place, f"{kinds(df)}, _cell int, _away double"))

    homes = placed(own.select(*keys, "memory_id", "vector", *extra))
    radii: dict[tuple, np.ndarray] = {}
    if shared.value:
        reach = [F.max("_away").alias("r"), F.count("*").alias("n")]
        large = homes.where("_away > 0").groupBy(*keys, "_cell").agg(*reach)
        radii = {k: np.full(len(p), 0.0) for k, p in shared.value.items()}
        for r in large.collect():  # as many as there are pivots
            radii[tuple(r[k] for k in keys)][r["_cell"]] = r["r"]
    known = own.sparkSession.sparkContext.broadcast(radii)
    angle = float(np.arccos(max(-1.0, min(1.0, threshold - 1e-9)))) + SLACK
    alone = guests is None

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            goes: list = [[] if alone else [0]] * len(batch)
            for key, at in _by_group(batch, keys):
                if key in shared.value:
                    x = unit(batch["vector"].iloc[at])
                    angles = _angles(x, shared.value[key])
                    near = angles <= np.minimum(angle + known.value[key], angles.min(axis=1, keepdims=True) + 2 * angle)
                    near &= (np.linalg.norm(x, axis=1) > 0.5)[:, None]
                    if alone:  # the member of the smaller cell visits
                        near &= np.arange(near.shape[1]) > batch["_cell"].to_numpy()[at][:, None]
                    for i, row in zip(at, near):
                        goes[i] = np.flatnonzero(row).tolist()
            yield batch[[*keys, "memory_id", "vector"]].assign(_goes=goes)

    source = homes if alone else guests.select(*keys, "memory_id", "vector").withColumn("_cell", F.lit(0))
    base = homes.select(*keys, "memory_id", "vector")
    if shared.value or not alone:
        went = source.select(*keys, "memory_id", "vector", "_cell").mapInPandas(visit, f"{kinds(base)}, _goes array<int>")
        visits = cut(went.withColumn("_cell", F.explode("_goes")).drop("_goes"))
    else:
        visits = base.withColumn("_cell", F.lit(0)).limit(0)
    block = lambda n: F.pmod(F.xxhash64("memory_id"), F.col(n)).cast("int")
    blocks = lambda df, n: df.groupBy(*keys, "_cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(n))
    counts = cut(blocks(homes, "_own").join(blocks(visits, "_vis"), [*keys, "_cell"], "left").fillna(0, ["_vis"]))
    wide = broadcast_if_small(counts)
    mine = homes.drop("_away").join(wide, [*keys, "_cell"]).withColumn("_b", block("_own"))
    theirs = visits.join(wide, [*keys, "_cell"]).withColumn("_b", block("_vis"))
    span = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    spot = lambda inner, i, j: F.struct(F.lit(inner).alias("_inner"), i.alias("_i"), j.alias("_j"))
    b = F.col("_b")
    inner = F.transform(span("_own"), lambda o: spot(True, F.least(b, o), F.greatest(b, o))) if alone else F.array().cast("array<struct<_inner:boolean,_i:int,_j:int>>")
    outer = F.transform(span("_vis"), lambda o: spot(False, b, o))
    columns = [*keys, "_cell", "memory_id", "vector", "_b", "_guest", *extra]
    types = dict(homes.dtypes)
    out = mine.withColumn("_guest", F.lit(False)).select(*columns, F.explode(F.concat(inner, outer)).alias("_u"))
    visiting = theirs.withColumns({"_guest": F.lit(True)} | {c: F.lit(None).cast(types[c]) for c in extra})
    back = visiting.select(*columns, F.explode(F.transform(span("_own"), lambda o: spot(False, o, b))).alias("_u"))
    return out.unionByName(back).select(*columns, "_u.*")


def compared(units: DataFrame, keys: list[str]) -> int:
    """How many pairs of rows meet in the units."""
    sides = units.groupBy(*keys, "_cell", "_inner", "_i", "_j").agg(
        F.count_if(~F.col("_guest") & (F.col("_b") == F.col("_i"))).alias("_x"), F.count_if(~F.col("_guest") & (F.col("_b") != F.col("_i"))).alias("_y"), F.count_if("_guest").alias("_z")
    )
    same = F.col("_inner") & (F.col("_i") == F.col("_j"))
    return int(sides.agg(F.sum(F.when(same, F.col("_x") * (F.col("_x") - 1) / 2).when(F.col("_inner"), F.col("_x") * F.col("_y")).otherwise(F.col("_x") * F.col("_z")))).first()[0] or 0)
