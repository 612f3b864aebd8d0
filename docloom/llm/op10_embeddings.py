"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length 1 and halved; each half has its own codebook, and the product of the two is a grid of cells.
Every distinct vector is indexed in its cell. A query walks the cells in order of distance, by the multi-sequence rule
over the two sorted lists of centroids, until the extra distance exceeds a slack that is set for a target recall: SLACK_Q
of the pairs with a cosine of exactly the threshold, made from sampled vectors, lie within it. Pairs are then verified.
Codebooks and slack are fitted on the driver on at most SAMPLE vectors (those with the smallest hash of vec_id); every
row is indexed and queried.

Equal vectors of a label are first put together, so copies cost one row. Cells with many vectors are cut into blocks, and
pairs of blocks are compared by separate tasks, which hand on counts and a spanning forest of links, never all pairs.

Defined results: links need equal labels that are not null, and a cosine in double precision of at least the threshold.
Vectors that are null, empty or zero, or hold null or non-finite components, have 0 links and are their own component;
vectors of another length than the most frequent one meet only their like, in one cell. Repeated vec_id are taken as
one vertex with the links of its rows added per row. Labels keep their type. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stash, table, width
from .components import components

THRESHOLD = 0.98
SAMPLE = 8192
SLACK_Q = 0.9999
BLOCK = 400
#: Vectors that a cell holds on average; centroids a half follow the data up to half the sample, which is some 2e9 distinct
#: vectors. Beyond that cells grow, and are compared by blocks all the same.
CELL, MOST = 128, SAMPLE // 2
#: Rows whose distances to all centroids are held at once.
ROWS = 1024


def _kmeans(x: np.ndarray, k: int, seed: int, steps: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = np.concatenate([_gaps(x[i : i + ROWS], c).argmin(1) for i in range(0, len(x), ROWS)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, up to what all centroids share."""
    return (c**2).sum(1) - 2 * x @ c.T


class Index:
    """Two codebooks and the slack up to which cells are visited."""

    def __init__(self, x: np.ndarray, k: int, threshold: float, quantile: float = SLACK_Q, seed: int = 7):
        self.dim = x.shape[1]
        h = (self.dim + 1) // 2
        self.books = [_kmeans(x[:, :h], k, seed), _kmeans(x[:, h:], k, seed + 1)]
        rng = np.random.default_rng(seed)
        y = rng.normal(size=(max(1, -(-20_000 // len(x))), *x.shape)).reshape(-1, self.dim)
        x = np.tile(x, (len(y) // len(x), 1))
        y -= (y * x).sum(1, keepdims=True) * x
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        y = threshold * x + np.sqrt(1 - threshold**2) * y
        extra = np.concatenate([self._extra(x[i : i + ROWS], y[i : i + ROWS]) for i in range(0, len(x), ROWS)])
        self.slack = float(np.quantile(extra, quantile)) + 1e-9

    def _extra(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How much further than its nearest cell the cell of y lies from x."""
        at = np.arange(len(x))
        return sum(d[at, e.argmin(1)] - d.min(1) for d, e in zip(self.split(x), self.split(y), strict=True))

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        h = (self.dim + 1) // 2
        return [_gaps(x[:, :h], self.books[0]), _gaps(x[:, h:], self.books[1])]

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> list[int]:
        """Cells in multi-sequence order, the nearest (home) first, until the slack is used up."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        a, b, k = d1[o1].tolist(), d2[o2].tolist(), len(d2)
        most = a[0] + b[0] + self.slack
        heap, seen, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
        while heap:
            s, i, j = heapq.heappop(heap)
            if s > most:
                break
            out.append(int(o1[i]) * k + int(o2[j]))
            for n in ((i + 1, j), (i, j + 1)):
                if n[0] < len(a) and n[1] < len(b) and n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (a[n[0]] + b[n[1]], *n))
        return out


def _unit(values: pa.Array) -> list[np.ndarray]:
    out = []
    for v in values.to_pylist():
        x = np.array(v, np.float64)
        x = x / np.abs(x).max()
        out.append(x / np.sqrt((x * x).sum()))
    return out


def _walk(df: DataFrame, index: Index) -> DataFrame:
    """Rows (label, cell, query, rep, mult, vec): each vector once in its home cell (query false), and in every visited cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(b["embedding"])
            usual = [k for k, u in enumerate(unit) if len(u) == index.dim]
            cells: list[list[int]] = [[-1 - len(u)] for u in unit]
            if usual:
                for k, d1, d2 in zip(usual, *index.split(np.array([unit[k] for k in usual])), strict=True):
                    cells[k] = index.visits(d1, d2)
            who = np.repeat(np.arange(len(unit)), [len(c) + 1 for c in cells])
            cell = np.array([x for c in cells for x in (c[0], *c)], np.int64)
            home = np.zeros(len(who), bool)
            home[np.cumsum([0, *(len(c) + 1 for c in cells[:-1])])] = True
            blob = [u.tobytes() for u in unit]
            yield pa.RecordBatch.from_arrays([b["label"].take(pa.array(who)), pa.array(cell), pa.array(~home), b["rep"].take(pa.array(who)), b["mult"].take(pa.array(who)), pa.array([blob[k] for k in who], pa.binary())], ["label", "cell", "query", "rep", "mult", "vec"])

    return map_batches(df.select("label", "embedding", "rep", "mult"), run, f"label {df.schema['label'].dataType.simpleString()}, cell long, query boolean, rep long, mult long, vec binary")


def _compare(threshold: float):
    """Sorted rows of groups (members before queries) to rows (a, b, n): b null: n links of a; else a link of the forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, ids, mult, x, tree, links, edges = None, [], None, None, None, None, [], []

        def flush() -> pa.RecordBatch:
            rows = links + edges
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["a", "b", "n"])
            links.clear()
            edges.clear()
            return out

        for batch in batches:
            for label, cell, mb, qb, query, rep, m, vec in zip(*(batch[c].to_pylist() for c in ("label", "cell", "mb", "qb", "query", "rep", "mult", "vec")), strict=True):
                if (label, cell, mb, qb) != group:
                    group, members, x = (label, cell, mb, qb), [], None
                v = np.frombuffer(vec)
                if not query:
                    members.append((rep, m, v))
                    continue
                if not members:
                    continue
                if x is None:
                    ids, mult, x = np.array([r[0] for r in members]), np.array([r[1] for r in members]), np.array([r[2] for r in members])
                    tree, at = np.arange(len(ids)), {r: k for k, r in enumerate(ids.tolist())}
                near = np.flatnonzero((x @ v >= threshold) & (ids != rep))
                if len(near):
                    links.append((rep, None, int(mult[near].sum())))
                    mine = at.get(rep)
                    roots = np.unique(tree[near])
                    for r in roots.tolist():
                        if mine is None or tree[mine] != r:
                            edges.append((rep, int(ids[near[tree[near] == r][0]]), None))
                    low = min(roots.tolist() if mine is None else [*roots.tolist(), int(tree[mine])])
                    tree[np.isin(tree, roots)] = low
                    if mine is not None:
                        tree[tree == tree[mine]] = low
            yield flush()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    good = F.col("label").isNotNull() & (F.coalesce(F.size("embedding"), F.lit(0)) > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "label", "embedding")
    sound = rows.where(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull())
    uniq = stash(sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")), "vectors")
    sizes = uniq.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = uniq.where(F.size("embedding") == sizes.dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    k = max(2, min(MOST, 1 << max(1, round(np.log2(max(4.0, sizes.n / CELL)) / 2))))
    index = Index(np.array(_unit(sample)), k, threshold)
    walked = stash(_walk(uniq, index), "walked")
    cut = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(BLOCK))).cast("int")
    cells = walked.groupBy("label", "cell").agg(F.sum(F.when(~F.col("query"), 1)).alias("m"), F.sum(F.when(F.col("query"), 1)).alias("q")).where("m > 0 and q > 0 and (m > 1 or q > 1)").select("label", "cell", cut("m").alias("ms"), cut("q").alias("qs"))
    own, other = F.pmod(F.xxhash64("rep"), F.when(F.col("query"), F.col("qs")).otherwise(F.col("ms"))).cast("int"), F.sequence(F.lit(0), F.when(F.col("query"), F.col("ms")).otherwise(F.col("qs")) - 1)
    dealt = walked.join(cells, ["label", "cell"]).withColumn("own", own).withColumn("other", F.explode(other))
    dealt = dealt.select("label", "cell", F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("mb"), F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("qb"), "query", "rep", "mult", "vec")
    keys = ["label", "cell", "mb", "qb"]
    found = stash(map_batches(dealt.repartition(width(spark), *keys).sortWithinPartitions(*keys, "query", "rep"), _compare(threshold), "a long, b long, n long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    reps = uniq.join(counts, "rep", "left").join(groups, "rep", "left").select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(reps, ["label", "embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
