"""Approximate nearest neighbours: lists of product-quantised vectors on disk, exact distances for the best of them, filters.

A coarse codebook deals vectors to lists; a vector's residual to its list's centroid is cut into sub-vectors of SUB components, each
named by its nearest entry of a codebook of its own, one byte. Both are fitted on the driver on at most SAMPLE rows, those
with the smallest hash of their id; every sound row is encoded. Rows lie in buckets of ``cell``, a list and one of its blocks, of some
BLOCK rows each, so that a list with very many rows is read by many tasks.

A query probes the lists with the nearest centroids, as many as the sample needs for a recall of TARGET: at building, queries of the
sample are answered exactly within it, and it is seen how far down the order of lists their neighbours lie (in all rows neighbours are
nearer, so that is on the safe side), for several depths; with a filter the depth is k over the share of rows that pass. Data without structure need a large share of the lists. In each cell distances are added up from a table of the query's
residual against the codebooks; the REFINE * k best of a batch get exact distances, of which k are kept a cell, and k
a query at the end. A filter acts on rows before that, so it takes nothing from the k; a query that finds fewer than k probes four
times as many lists, up to all. ``nearest`` asks for a few vectors at hand and reads only the buckets of their cells; ``nearest_all`` asks
for a table of queries, which meet the rows of a cell in groups of at most about GROUP queries: nothing is sent to all tasks but the codebooks.

Metrics: cosine (on vectors of length 1) and l2. Not indexed, and so never found: null, empty or non-finite vectors, those
of another length than the most frequent, for cosine zero ones. Ties go to the smallest id. A query vector that could not be indexed finds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import map_batches
from .graph import cut
from .versions import Store

SAMPLE, SUB, ENTRIES, STEPS = 8192, 8, 256, 10
#: Lists are the square root of the rows, or more so that a list has this many on average; at most, which half the sample still fits.
LIST, LISTS = 1024, SAMPLE // 2
BLOCK, GROUP = 1 << 16, 4096
TARGET, TRIED, REFINE = 0.995, 256, 8


#: Numbers of one array of distances, and bytes of a batch that is sent on: batches are worked on in slices, however many rows and lists there are.
SLICE, SENT = 1 << 20, 8 << 20


def _slices(rows: int, wide: int) -> Iterator[slice]:
    """Stretches of rows whose distances to so many centroids are at most SLICE numbers, one row at least."""
    n = max(1, SLICE // max(1, wide))
    return (slice(i, min(i + n, rows)) for i in range(0, rows, n))


def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def _centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(STEPS):
        near = np.concatenate([_gaps(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])
        total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Codes:
    """The coarse centroids, the codebooks of residuals and what they say of vectors."""

    def __init__(self, metric: str, coarse: np.ndarray, books: np.ndarray, blocks: list[int], tuned: list | None = None):
        self.metric, self.coarse, self.books, self.blocks, self.tuned = metric, coarse, books, blocks, tuned or []
        self.dim = coarse.shape[1]

    @classmethod
    def fit(cls, metric: str, x: np.ndarray, rows: int, lists: int | None = None) -> Codes:
        k = min(len(x), LISTS, lists or max(1, int(np.sqrt(rows)), rows // LIST))
        coarse = _centres(x, k, 1)
        near = _gaps(x, coarse).argmin(1)
        m = -(-x.shape[1] // SUB)
        rest = np.pad(x - coarse[near], ((0, 0), (0, m * SUB - x.shape[1]))).reshape(len(x), m, SUB)
        books = [_centres(rest[:, j], min(ENTRIES, len(x)), 2 + j) for j in range(m)]
        share = np.bincount(near, minlength=k) / len(x)
        tried = x[np.random.default_rng(0).permutation(len(x))[:TRIED]]
        close = np.argsort(_gaps(tried, x), axis=1, kind="stable")
        order = np.argsort(np.argsort(_gaps(tried, coarse), axis=1), axis=1)
        tuned, depth = [], 10
        while depth < len(x):
            down = np.sort(np.take_along_axis(order, near[close[:, 1 : depth + 1]], 1).ravel())
            tuned.append((depth, int(down[int(TARGET * (len(down) - 1))]) + 1))
            depth *= 2
        return cls(metric, coarse, np.array(books), [max(1, int(np.ceil(s * rows / BLOCK))) for s in share], tuned)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Vectors as they are compared: for cosine of length 1."""
        if self.metric != "cosine":
            return x
        x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of scaled vectors."""
        at = _gaps(x, self.coarse).argmin(1)
        m = len(self.books)
        rest = np.pad(x - self.coarse[at], ((0, 0), (0, m * SUB - self.dim))).reshape(len(x), m, SUB)
        return at, np.stack([_gaps(rest[:, j], self.books[j]).argmin(1) for j in range(m)], 1).astype(np.uint8)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each scaled query, nearest first."""
        return np.argsort(_gaps(q, self.coarse), axis=1, kind="stable")[:, :n]

    def needed(self, depth: float) -> int:
        """Lists to probe so that of the depth nearest rows TARGET are met; all if the sample was too small to tell."""
        return next((n for d, n in self.tuned if d >= depth), len(self.coarse))

    def table(self, q: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of a query's residual to list at, by sub-vector and entry."""
        m = len(self.books)
        rest = np.pad(q - self.coarse[at], (0, m * SUB - self.dim)).reshape(m, 1, SUB)
        return ((self.books - rest) ** 2).sum(2)

    def exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 1 - x @ q if self.metric == "cosine" else np.sqrt(((x - q) ** 2).sum(1))


class Best:
    """The k nearest of what one query has met."""

    def __init__(self, k: int):
        self.k, self.d, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    def add(self, d: np.ndarray, ids: np.ndarray) -> None:
        d, ids = np.concatenate([self.d, np.round(d, 9)]), np.concatenate([self.ids, ids])
        at = np.lexsort((ids, d))[: self.k]
        self.d, self.ids = d[at], ids[at]


def _meet(codes: Codes, best: Best, q: np.ndarray, at: int, ids: np.ndarray, coded: np.ndarray, x: np.ndarray, exact: bool = False) -> None:
    """A query against rows of list at: distances by codes, exact ones for the best of them, or for all."""
    if exact:
        best.add(codes.exact(q, x), ids)
        return
    rough = codes.table(q, at)[np.arange(coded.shape[1]), coded].sum(1)
    some = REFINE * best.k
    pick = np.flatnonzero(rough <= np.partition(rough, some - 1)[some - 1]) if len(rough) > some else np.arange(len(rough))  # with all ties
    best.add(codes.exact(q, x[pick]), ids[pick])


def _sound(vectors: DataFrame, id: str, metric: str) -> DataFrame:
    e = F.col("embedding")
    good = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(e) > 0)
    if metric == "cosine":
        good = good & F.exists(e, lambda v: v != 0)
    return vectors.where(F.col(id).isNotNull() & F.coalesce(good, F.lit(False)))


class VectorIndex:
    """The index of a folder, at its latest version when opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        snap = self.store.snapshot()
        said = json.loads(self.store.read("model", snap).first().said)
        self.codes = Codes(said["metric"], np.array(said["coarse"]), np.array(said["books"]), said["blocks"], said["tuned"])
        self.rows = self.store.read_buckets("vectors", (said["buckets"], "cell"), snap)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "cosine", keep: tuple[str, ...] = ("label",), lists: int | None = None) -> VectorIndex:
        """An index of vectors (vec_id, embedding, keep...) in a new folder; keep: columns that filters may name."""
        spark = vectors.sparkSession
        rows = _sound(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), *keep), "vec_id", metric)
        size = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        if size is None:
            raise ValueError("there is no vector to index")
        rows = rows.where(F.size("embedding") == size.dim)
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
        codes = Codes(metric, np.zeros((1, size.dim)), np.zeros(0), [])
        codes = Codes.fit(metric, codes.scaled(np.stack(sample.to_numpy())), size["count"], lists)
        types = {c: rows.schema[c].dataType.simpleString() for c in keep}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(at.start, at.stop - at.start) for b in batches for at in _slices(len(b), max(len(codes.coarse), ENTRIES))):
                x = codes.scaled(np.array(b["embedding"].to_pylist(), np.float64).reshape(len(b), -1))
                at, coded = codes.encode(x)
                yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(at, pa.int32()), pa.array([c.tobytes() for c in coded], pa.binary()), pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary()), *[b[c] for c in keep]], ["vec_id", "list", "code", "vector", *keep])

        made = map_batches(rows, run, f"vec_id long, list int, code binary, vector binary{''.join(f', {c} {t}' for c, t in types.items())}")
        many = {k: n for k, n in enumerate(codes.blocks) if n > 1}
        blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in many.items() for v in kv]), F.col("list")), F.lit(1)) if many else F.lit(1)
        made = made.withColumn("cell", F.col("list").cast("long") * (1 << 20) + F.pmod(F.xxhash64("vec_id"), blocks))
        buckets = max(8, sum(codes.blocks) // 4)
        w = Store(spark, path).begin()
        w.replace("model", spark.createDataFrame([(json.dumps({"metric": metric, "coarse": codes.coarse.tolist(), "books": codes.books.tolist(), "blocks": codes.blocks, "tuned": codes.tuned, "buckets": buckets}),)], "said string"))
        w.replace("vectors", made.repartition(buckets, "cell").sortWithinPartitions("cell"), "", (buckets, "cell"))
        w.commit()
        return cls(spark, path)

    def _cells(self, at: int) -> list[int]:
        return [(int(at) << 20) + b for b in range(self.codes.blocks[at])]

    def _probes(self, k: int, where: Column | None) -> int:
        """The k nearest rows that pass a filter are as far as k / share of all; the share is counted, by a scan of the filter's columns."""
        if where is None:
            return self.codes.needed(k)
        passing = self._scan().where(where).count()
        return self.codes.needed(k * self._scan().count() / passing) if passing else 1

    def _scan(self) -> DataFrame:
        return self.rows[0]

    def nearest(self, queries: list[list[float]], k: int = 10, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """query (its place in the list), vec_id, distance, rank of the k nearest of each of a few vectors."""
        codes = self.codes
        probes = probes or self._probes(k, where)
        q = codes.scaled(np.array(queries, np.float64).reshape(len(queries), -1))
        if q.shape[1] != codes.dim:
            raise ValueError(f"vectors have {codes.dim} components")
        probed = codes.probes(q, probes)
        cells = sorted({c for row in probed for at in row for c in self._cells(at)})
        asks: dict[int, list[int]] = {}
        for n, row in enumerate(probed.tolist()):
            for at in row:
                asks.setdefault(at, []).append(n)
        rows = self._scan().where(F.col("cell").isin(cells))
        rows = (rows if where is None else rows.where(where)).select("vec_id", "list", "code", "vector")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {n: Best(k) for n in range(len(q))}
            for b in batches:
                ids, lists = b["vec_id"].to_numpy(), b["list"].to_numpy()
                if not len(ids):
                    continue
                coded, x = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(ids), -1), np.frombuffer(b"".join(b["vector"].to_pylist()), "<f8").reshape(len(ids), -1)
                for at in np.unique(lists).tolist():
                    own = lists == at
                    for n in asks.get(at, ()):
                        _meet(codes, best[n], q[n], at, ids[own], coded[own], x[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), [len(v.d) for v in best.values()]), pa.int64()), pa.array(np.concatenate([v.ids for v in best.values()]), pa.int64()), pa.array(np.concatenate([v.d for v in best.values()]), pa.float64())], ["query", "vec_id", "distance"])

        found = _ranked(map_batches(rows, run, "query long, vec_id long, distance double"), "query", k)
        if where is None or probes >= len(codes.coarse):
            return found
        kept = cut(found)
        counts = {r["query"]: r["count"] for r in kept.groupBy("query").count().collect()}  # a row a query at hand
        few = [n for n in range(len(queries)) if counts.get(n, 0) < k]
        if not few:
            return kept
        more = self.nearest([queries[n] for n in few], k, where, 4 * probes)
        renamed = self.spark.createDataFrame([(j, n) for j, n in enumerate(few)], "query long, was long")
        return kept.where(~F.col("query").isin(few)).unionByName(more.join(renamed, "query").select(F.col("was").alias("query"), "vec_id", "distance", "rank"))

    def nearest_all(self, queries: DataFrame, k: int = 10, where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query, vec_id, distance, rank of the k nearest of each row of queries (query, embedding); exact: all rows are compared."""
        codes = self.codes
        asked = _sound(queries.select("query", F.col("embedding").cast("array<double>").alias("embedding")), "query", codes.metric).where(F.size("embedding") == codes.dim)
        out, n = None, len(codes.coarse) if exact else probes or self._probes(k, where)
        while True:
            found = self._all(asked, k, where, n, exact)
            if n >= len(codes.coarse):
                return found if out is None else out.unionByName(found)
            found = cut(found)
            full = found.groupBy("query").count().where(F.col("count") >= k).select("query")
            done = found.join(full, "query", "left_semi")
            out = done if out is None else out.unionByName(done)
            asked = cut(asked.join(full, "query", "left_anti"))
            if asked.isEmpty():
                return out
            n *= 4

    def _all(self, asked: DataFrame, k: int, where: Column | None, probes: int, exact: bool) -> DataFrame:
        codes = self.codes

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(at.start, at.stop - at.start) for b in batches for at in _slices(len(b), len(codes.coarse))):
                q = codes.scaled(np.array(b["embedding"].to_pylist(), np.float64).reshape(len(b), -1))
                probed = codes.probes(q, probes)
                for part in _slices(len(b), probed.shape[1] * codes.dim * 8 * SLICE // SENT):  # a row goes out once for each of its lists
                    at = probed[part]
                    who = np.repeat(np.arange(part.start, part.stop), at.shape[1])
                    blobs = {i: q[i].tobytes() for i in range(part.start, part.stop)}
                    yield pa.RecordBatch.from_arrays([b["query"].take(pa.array(who)), pa.array(at.ravel(), pa.int32()), pa.array([blobs[i] for i in who], pa.binary())], ["query", "list", "vector"])

        probed = map_batches(asked, walk, "query long, list int, vector binary")
        # many queries of one list are dealt in groups; its rows are then sent to each group
        loads = {r["list"]: -(-r["count"] // GROUP) for r in probed.groupBy("list").count().collect() if r["count"] > GROUP}  # a row a list
        groups = lambda: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in loads.items() for v in kv]), F.col("list")), F.lit(1)) if loads else F.lit(1)
        blocks = F.element_at(F.array(*[F.lit(b) for b in codes.blocks]), F.col("list") + 1)
        first = F.col("list").cast("long") * (1 << 20)
        asks = probed.withColumn("cell", F.explode(F.sequence(first, first + blocks - 1))).select("cell", F.pmod(F.xxhash64("query"), groups()).cast("int").alias("grp"), F.lit(0).alias("kind"), F.col("query").alias("id"), F.lit(b"").alias("code"), "vector", "list")
        rows = self._scan()
        rows = (rows if where is None else rows.where(where)).withColumn("grp", F.explode(F.sequence(F.lit(0), groups() - 1))).select("cell", "grp", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "code", "vector", "list")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = asks.unionByName(rows).repartition(parts, "cell", "grp").sortWithinPartitions("cell", "grp", "kind", "id")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, best, vectors, at = None, {}, {}, 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([i for i, v in best.items() for _ in v.ids], pa.int64()), pa.array([x for v in best.values() for x in v.ids.tolist()], pa.int64()), pa.array([x for v in best.values() for x in v.d.tolist()], pa.float64())], ["query", "vec_id", "distance"])

            for b in batches:
                cell, grp, kind, ids = b["cell"].to_numpy(), b["grp"].to_numpy(), b["kind"].to_numpy(), b["id"].to_numpy()
                edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(grp) != 0) | (np.diff(kind) != 0)) + 1
                for lo, hi in zip([0, *edges], [*edges, len(cell)], strict=True):
                    if lo == hi:
                        continue
                    if here != (cell[lo], grp[lo]):
                        yield flush()
                        here, best, vectors, at = (cell[lo], grp[lo]), {}, {}, int(b["list"][lo].as_py())
                    x = np.frombuffer(b"".join(b["vector"].slice(lo, hi - lo).to_pylist()), "<f8").reshape(hi - lo, -1)
                    if kind[lo] == 0:
                        for i, v in zip(ids[lo:hi].tolist(), x, strict=True):
                            best[i], vectors[i] = Best(k), v
                        continue
                    coded = np.frombuffer(b"".join(b["code"].slice(lo, hi - lo).to_pylist()), np.uint8).reshape(hi - lo, -1)
                    for i, v in vectors.items():
                        _meet(codes, best[i], v, at, ids[lo:hi], coded, x, exact)
            yield flush()

        return _ranked(map_batches(dealt, meet, "query long, vec_id long, distance double"), "query", k)


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """query, tenth (the exact k-th distance) and hits (found rows no further) for results (query, vec_id, distance, rank)."""
    last = exact.groupBy("query").agg(F.max("distance").alias("tenth"))
    return last.join(found.select("query", "distance"), "query", "left").groupBy("query", "tenth").agg(F.count_if(F.col("distance") <= F.col("tenth") + 1e-9).alias("hits"))
