"""Vector joins with exact pruning by angles.

Unit vectors are dealt to the nearest of a bounded number of pivots; a cell
knows the largest angle of its vectors to its pivot.  Angles obey the triangle
inequality, so a vector can be within an angle of some vector of a cell only if
it is within that angle plus the cell's radius of the pivot; all other cells
never see it.  Large cells are cut into blocks by id, and each pair of blocks
that still has vectors on both sides is multiplied in one task.  There are less
than PIVOTS + BLOCKS blocks at any size, so what is shuffled grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import settle

#: Vectors of a block, blocks that the vectors are cut into at most (those of larger tables are larger), pivots at most, and candidates for pivots looked at.
BLOCK, BLOCKS, PIVOTS, CANDIDATES = 2048, 64, 32, 4096
#: Cells of a matrix of scores.
CELLS = 1 << 22
#: Allowance for rounding where angles are compared.
SLACK = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def codes(ids: pa.Array) -> np.ndarray:
    """A number for each different id."""
    if pa.types.is_nested(ids.type):
        ids = pa.array([repr(x) for x in ids.to_pylist()])
    return ids.dictionary_encode().indices.to_numpy()


def units(rows: DataFrame, key: str, col: str) -> DataFrame:
    """id, v: vectors of length 1; missing and zero vectors are left out."""
    return settle(rows.where(F.col(col).isNotNull()).select(F.col(key).alias("id"), unit(F.col(col)).alias("v")).where("v is not null"), "units")


def angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1, 1))


def choose_pivots(v: DataFrame, n: int) -> np.ndarray:
    """Vectors far from each other, among the first by hash: about one for each block, PIVOTS at most."""
    rows = v.orderBy(F.xxhash64("id"), "id").limit(CANDIDATES).collect()  # a bounded number of vectors
    pool = np.array([r.v for r in rows])
    chosen = [0]
    far = 1 - pool @ pool[0]
    while len(chosen) < min(PIVOTS, len(pool), max(1, -(-4 * n // BLOCK))) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - pool @ pool[chosen[-1]])
    return pool[chosen]


@dataclass
class Cells:
    """Vectors (id, v, cell, block) and what is known of their cells: a few numbers a pivot."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    @property
    def parts(self) -> np.ndarray:
        return -(-self.size // max(BLOCK, -(-int(self.size.sum()) // BLOCKS)))

    @property
    def base(self) -> np.ndarray:
        """Number of the first block of each cell."""
        return np.cumsum(self.parts) - self.parts


def cells_of(v: DataFrame) -> Cells | None:
    """Deal unit vectors (id, v) to cells; None where there are none."""
    n = v.count()
    if not n:
        return None
    pivots = choose_pivots(v, n)

    @F.pandas_udf("cell int, angle double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        a = angles(np.stack(x), pivots)
        cell = a.argmin(axis=1)
        return pd.DataFrame({"cell": cell, "angle": a[np.arange(len(a)), cell]})

    placed = settle(v.withColumn("c", nearest("v")).select("id", "v", "c.cell", "c.angle"), "cells")
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():  # a row a pivot
        radius[r.cell], size[r.cell] = r.r, r.n
    out = Cells(placed, pivots, radius, size)
    base, parts = (F.array(*map(F.lit, x.tolist())) for x in (out.base, out.parts))
    block = base[F.col("cell")] + F.pmod(F.xxhash64("id"), parts[F.col("cell")])
    out.rows = placed.select("id", "v", "cell", block.cast("int").alias("block"))
    return out


def visits(rows: DataFrame, cells: Cells, angle: Callable[[pd.DataFrame], np.ndarray | float]) -> DataFrame:
    """rows (with v) once for each block, as ``other``, whose cell may hold a vector within the angle of theirs.

    ``angle`` gives it from the rows' other columns.
    """
    pivots, radius, base, parts = cells.pivots, cells.radius, cells.base, cells.parts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                near = (angles(np.stack(f["v"]), pivots) <= np.reshape(angle(f), (-1, 1)) + radius + SLACK) & (parts > 0)
                row, cell = np.nonzero(near)
                for a in range(0, len(row), 50_000):
                    r, c = row[a : a + 50_000], cell[a : a + 50_000]
                    many = parts[c]
                    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    yield f.iloc[np.repeat(r, many)].assign(other=(np.repeat(base[c], many) + inside).astype("int32"))

    return rows.mapInPandas(run, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", other int")


def block_pairs(cells: Cells, t: float) -> DataFrame:
    """Vectors once for each pair of blocks (lo, hi) in which they may have a partner of cosine t or more."""
    theta = float(np.arccos(np.clip(t, -1, 1)))
    return visits(cells.rows.select("id", "v", "block"), cells, lambda f: theta).select("id", "v", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def pruning(cells: Cells, t: float) -> DataFrame:
    """vectors, blocks, pairs of blocks that meet, pairs there are, and copies of vectors that are shuffled."""
    met = block_pairs(cells, t).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.count_distinct("block").alias("sides"))
    own = met.agg(F.count_if((F.col("lo") == F.col("hi")) | (F.col("sides") == 2)).alias("met"), F.coalesce(F.sum("n"), F.lit(0)).alias("copies"))
    blocks = int(cells.parts.sum())
    return own.select(F.lit(int(cells.size.sum())).alias("vectors"), F.lit(blocks).alias("blocks"), "met", F.lit(blocks * (blocks + 1) // 2).alias("pairs"), "copies")


def cosine_join(nodes: DataFrame, col: str, t: float, strict: bool = False, key: str = "id", tallied: bool = False) -> DataFrame:
    """i, j, score of all pairs i < j of vectors of cosine t or more; missing vectors are skipped.

    Cells that cannot hold a partner are skipped exactly; a task holds two blocks at most.
    ``tallied`` pairs are not listed: each two blocks give pairs, their number, and total, the sum of their scores.
    """
    v = units(nodes, key, col)
    kind = dict(v.dtypes)["id"]
    cells = cells_of(v)
    if cells is None:
        empty = v.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("score"))
        return empty.select(F.lit(0).cast("long").alias("pairs"), F.col("score").alias("total")) if tallied else empty

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pa.Table.from_batches(list(batches))
        own = f["lo"][0] == f["hi"][0]
        block = f["block"].to_numpy()
        a, b = f.filter(pa.array(block == f["lo"].to_numpy())), f.filter(pa.array(block == f["hi"].to_numpy()))
        if not len(a) or not len(b):
            return
        (va, vb), (ia, ib) = ([x[c].combine_chunks() for x in (a, b)] for c in ("v", "id"))
        va, vb = (x.flatten().to_numpy().reshape(len(x), -1) for x in (va, vb))
        same = codes(pa.concat_arrays([ia, ib])) if tallied else None
        step, pairs, total = max(1, CELLS // len(b)), 0, 0.0
        for first in range(0, len(a), step):
            score = va[first : first + step] @ vb.T
            x, y = np.nonzero((score > t) if strict else (score >= t))
            if own:
                x, y = x[y > x + first], y[y > x + first]
            if len(x) and tallied:
                other = same[x + first] != same[len(a) + y]
                x, y = x[other], y[other]
                pairs, total = pairs + len(x), total + float(score[x, y].sum())
            elif len(x):
                yield pa.RecordBatch.from_arrays([ia.take(pa.array(x + first)), ib.take(pa.array(y)), pa.array(score[x, y])], ["x", "y", "score"])
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([total])], ["pairs", "total"])

    if tallied:
        cells.rows = cells.rows.where("id is not null")
        return block_pairs(cells, t).groupBy("lo", "hi").applyInArrow(products, "pairs long, total double")
    e = block_pairs(cells, t).groupBy("lo", "hi").applyInArrow(products, f"x {kind}, y {kind}, score double")
    return e.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "score").where("i < j")


def cosine_topk(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank: queries (qid, v) against all rows of base (id, v); ties go to the smaller id.

    A query first meets the nearest cells that hold k rows; its k-th best score
    there is a bound that all cells farther away are held against, and only
    those that can beat it are visited.
    """
    q, rows = units(queries, "qid", "v"), units(base, "id", "v")
    cells = cells_of(rows)
    kinds = f"qid {dict(q.dtypes)['id']}, id {dict(rows.dtypes)['id']}, score double"
    if cells is None:
        return q.select(F.col("id").alias("qid"), F.col("id").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    pivots, size, starts, parts = cells.pivots, cells.size, cells.base, cells.parts

    @F.pandas_udf("array<int>")
    def nearest_blocks(x: pd.Series) -> pd.Series:
        order = angles(np.stack(x), pivots).argsort(axis=1, kind="stable")
        enough = (np.cumsum(size[order], axis=1) - size[order]) < k
        return pd.Series([np.concatenate([np.arange(starts[c], starts[c] + parts[c]) for c in o[e]]).tolist() for o, e in zip(order, enough, strict=True)])

    def best(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["asks"]], f[~f["asks"]].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        score = np.stack(a["v"]) @ np.stack(b["v"]).T
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"qid": np.repeat(a["id"].to_numpy(), top.shape[1]), "id": b["id"].to_numpy()[top.ravel()], "score": np.take_along_axis(score, top, 1).ravel()})

    def meet(asking: DataFrame, name: str) -> DataFrame:
        """The best k of each query in each block that it visits; asking: id, v, other."""
        groups = asking.groupBy("other").agg(F.count("*").alias("n"))
        slices = groups.select("other", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))  # a row a block
        asks = asking.join(F.broadcast(slices), "other").select(F.lit(True).alias("asks"), "id", "v", "other", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("slice"))
        held = cells.rows.join(F.broadcast(slices), F.col("block") == F.col("other")).select(F.lit(False).alias("asks"), "id", "v", "other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("slice"))
        return settle(asks.unionByName(held).groupBy("other", "slice").applyInPandas(best, kinds), name)

    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    first = meet(q.select("id", "v", F.explode(nearest_blocks("v")).alias("other")), "nearest")
    bound = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("score").alias("bound"))
    asking = q.join(bound, "id", "left").select("id", "v", F.coalesce("bound", F.lit(-1.0)).alias("bound"))
    reach = visits(asking, cells, lambda f: np.arccos(np.clip(f["bound"].to_numpy(), -1, 1))).select("id", "v", "other")
    return meet(reach, "best").withColumn("rank", rank).where(F.col("rank") <= k)
