"""The k nearest of every vector among all others, exactly: blocks of vectors meet in pairs, by matrix products in bounded memory.

The work grows with the square of the table, a task's memory does not: a pair of blocks holds both, k places a query and one tile of a product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most rows and bytes (as doubles) of a block, rows below which a block is not cut for the sake of more tasks, most tasks of a step. Fixed values.
ROWS, BYTES, LEAST, TASKS = 1 << 16, 64 << 20, 1 << 11, 4096
#: Queries and items of one product; distances are compared as whole numbers of STEPS a unit, as if rounded to nine decimals.
QUERIES, ITEMS, STEPS = 256, 512, 10**9
#: Keys of pairs with a distance that is not a number (a vector of length zero, or not finite), without a distance (no vector, other length), and of no pair.
NAN, NONE, FAR = 3 * STEPS, 4 * STEPS, np.iinfo(np.int64).max


def neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, distance (cosine), rank of the k nearest others of every row of vectors (vec_id, embedding).

    By distance, then vec_id; distances that are not numbers come after all others, and null after these."""
    v = vectors.where("vec_id is not null").select("vec_id", "embedding")
    size = v.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    most = max(1, min(ROWS, BYTES // (8 * max(size.dim or 1, 1))))
    blocks = max(1, -(-size.n // most), min(-(-size.n // LEAST), math.isqrt(3 * v.sparkSession.sparkContext.defaultParallelism) + 1))
    own, all_ = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = lambda a, b: v.select(a.alias("a"), b.alias("b"), "vec_id", "embedding").repartition(min(4 * blocks * blocks, TASKS), "a", "b").groupBy("a", "b")
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def met(queries: pa.Table, items: pa.Table) -> pa.Table:
        ids, others, at, distance = _nearest(_Block(queries), _Block(items), k, own=len(queries) > 0 and queries["a"][0] == queries["b"][0])
        return pa.table({"query_id": ids, "vec_id": others.take(at), "distance": distance})

    met_ = dealt(own, all_).cogroup(dealt(all_, own)).applyInArrow(met, f"query_id {kind}, vec_id {kind}, distance double")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), F.asc("vec_id"))
    return met_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Block:
    """Vectors by ascending id, scaled to length 1: their lengths as lists (0: none, or nulls in it), and whether they have a direction."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("vec_id")
        self.ids, lists = rows["vec_id"].combine_chunks(), rows["embedding"].combine_chunks()
        values = lists.flatten()
        self.size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        x = np.full((len(rows), max(self.size.max(initial=0), 1)), 0.0)
        x[np.arange(x.shape[1]) < self.size[:, None]] = np.asarray(pc.fill_null(values, float("nan")) if values.null_count else values, np.float64)
        if values.null_count:
            holes = np.repeat(np.arange(len(rows)), self.size)[np.asarray(pc.is_null(values))]
            self.size[holes] = 0
        with np.errstate(all="ignore"):
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
        self.sound = np.isfinite(x).all(1) & (self.size > 0)
        x[~self.sound] = 0
        self.x = x


def _nearest(q: _Block, v: _Block, k: int, own: bool) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Query, ids of v, place in them and distance of the k rows of v nearest to each row of q. own: the same block, where no row is met by its own id.

    A key is the distance in STEPS, then the place, which goes by id. A later item that only equals the k-th distance is behind it, so large groups of copies cost no more than other rows."""
    n, width = len(q.ids), len(v.ids)
    best = np.full((n, k), FAR)
    wide = max(q.x.shape[1], v.x.shape[1])
    x, y = (np.pad(b.x, ((0, 0), (0, wide - b.x.shape[1]))) if b.x.shape[1] < wide else b.x for b in (q, v))
    odd = not (q.sound.all() and v.sound.all() and len(np.unique(np.concatenate([q.size, v.size]))) <= 1)
    mine, theirs = (np.asarray(b.ids) for b in (q, v)) if own else (None, None)
    out = np.empty((QUERIES, ITEMS))
    for lo in range(0, n, QUERIES):
        rows = slice(lo, min(lo + QUERIES, n))
        kept, least = best[rows], np.full(rows.stop - lo, -np.inf)
        for at in range(0, width, ITEMS):
            cols = slice(at, min(at + ITEMS, width))
            like = out[: rows.stop - lo, : cols.stop - at] if cols.stop - at == ITEMS else np.empty((rows.stop - lo, cols.stop - at))
            np.matmul(x[rows], y[cols].T, out=like)
            if odd:
                same = (q.size[rows, None] == v.size[cols]) & (q.size[rows, None] > 0)
                like[same & ~(q.sound[rows, None] & v.sound[cols])] = 1 - NAN // STEPS
                like[~same] = 1 - NONE // STEPS
            if own:
                like[mine[rows, None] == theirs[cols]] = -np.inf
            some = np.flatnonzero(like.max(1) > least)
            if not len(some):
                continue
            near = like[some]
            r, c = np.nonzero(near > least[some, None])
            key = np.floor(np.maximum((1 - near[r, c]) * STEPS, 0) + 0.5).astype(np.int64) * width + (at + c)
            count = np.bincount(r, minlength=len(some))
            both = np.full((len(some), k + count.max()), FAR)
            both[:, :k] = kept[some]
            both[r, k + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)] = key
            kept[some] = np.partition(both, k - 1, axis=1)[:, :k]
            last = kept[some, k - 1]
            least[some] = np.where(last == FAR, -np.inf, 1 - (last // width - 0.5) / STEPS - 1e-14)  # a little below: keys decide
    best.sort(axis=1)
    r, c = np.nonzero(best != FAR)
    steps, place = np.divmod(best[r, c], max(width, 1))
    distance = pa.array(np.where(steps == NAN, np.nan, steps / STEPS), pa.float64(), mask=steps == NONE)
    return q.ids.take(pa.array(r)), v.ids, pa.array(place), distance
