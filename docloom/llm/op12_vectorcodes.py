"""Codes of vectors by product quantisation, the codebooks fitted to all rows by exact Lloyd rounds with bound heaps.

Components become integers floor(SCALE * x), vectors are cut into PARTS equal parts, each part position has a codebook of
ENTRIES entries. Every round assigns each part to its nearest entry (ties to the lower index) and moves each entry to the
componentwise floor of its parts' mean, in integers, so results do not depend on order or on the number of tasks.

The rows are packed once into blocks of at most BLOCK vectors, a table bucketed by block. Each block keeps a heap an entry and
part position, ordered by slack: the lower bound on the distance to any other entry, minus the upper bound on that to its
own, plus the entry's cumulative drift when the part was pushed. A round adds to an entry's drift how far it moved and how far
any other entry moved at most; parts whose slack the drift has reached are popped and scanned exactly, the others have
provably kept their entry and are not touched. Bounds are rounded towards a scan, so that ties are always scanned. A round hands on
only the changes of counts and sums by entry, summed by Spark: at most PARTS * ENTRIES rows come to the driver. Blocks
and heaps are bucketed alike, so rounds join them without an exchange; each round's heaps are a written table, so lost
executors cost the tasks of one round.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Vectors of other lengths than
the longest are filled with zeros at the end, and all to a multiple of PARTS; an empty vector is all zeros. Integers are
clipped to +-2**24, so that sums fit 64 bits. Fewer rows than ENTRIES: a codebook has as many entries as there are rows. Of equal
vec_id the smaller vector starts first; null vec_id come last. Equal entries: the lower index has all. Repeated rows count
each. No rows: no rows. Labels keep their type; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, map_batches, stash, table, width

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK, CLIP = 4096, 1 << 24
#: By how much of a distance a bound is widened for rounding: far above that of doubles, far below a distance of 1.
MARGIN = 1e-9


def integers(flat: np.ndarray, lengths: np.ndarray, dim: int) -> np.ndarray:
    """Vectors, one after the other in flat, as rows of dim integers."""
    out = np.zeros((len(lengths), dim), np.int32)
    keep = np.arange(dim) < lengths[:, None]
    with np.errstate(over="ignore"):
        out[keep] = np.clip(np.floor(SCALE * flat.astype(np.float64)), -CLIP, CLIP)
    return out


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to the entries of book, in integers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, and a lower bound on how much nearer it is than any other."""
    d = distances(x, book)
    near = d.argmin(1)
    if len(book) == 1:
        return near, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return near, two[:, 1] - two[:, 0] - MARGIN * (1 + two[:, 1])


def _below(key: np.ndarray) -> np.ndarray:
    """Rounded down to 32 bits."""
    out = key.astype(np.float32)
    return np.where(out.astype(np.float64) > key, np.nextafter(out, np.float32(-np.inf)), out)


class Heaps:
    """For one part position of a block: a heap of (slack, row) an entry, as arrays in heap order until one is changed."""

    def __init__(self, k: int):
        self.rows = [np.zeros(0, np.int32)] * k
        self.keys = [np.zeros(0, np.float32)] * k

    def step(self, x: np.ndarray, book: np.ndarray, drift: np.ndarray, first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pops what the drift has reached and pushes it where it belongs now: the rows scanned, their entries before (-1: none) and after."""
        opened: dict[int, list] = {}
        out, was = [], []
        if first:
            out, was = [*range(len(x))], [-1] * len(x)
        for j, keys in enumerate(self.keys):
            if len(keys) and keys[0] <= drift[j]:
                heap = opened[j] = list(zip(keys.tolist(), self.rows[j].tolist(), strict=True))
                while heap and heap[0][0] <= drift[j]:
                    out.append(heapq.heappop(heap)[1])
                    was.append(j)
        rows, old = np.array(out, np.int64), np.array(was, np.int64)
        if not len(rows):
            return rows, old, old
        now, gap = scan(x[rows], book)
        keys = _below(gap + drift[now])
        for j, key, row in zip(now.tolist(), keys.tolist(), rows.tolist(), strict=True):
            if j not in opened:
                opened[j] = list(zip(self.keys[j].tolist(), self.rows[j].tolist(), strict=True))
            heapq.heappush(opened[j], (key, row))
        for j, heap in opened.items():
            self.keys[j], self.rows[j] = np.array([h[0] for h in heap], np.float32), np.array([h[1] for h in heap], np.int32)
        return rows, old, now

    def entries(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for j, rows in enumerate(self.rows):
            out[rows] = j
        return out

    def dump(self) -> bytes:
        return np.array([len(r) for r in self.rows], np.int32).tobytes() + np.concatenate(self.rows).tobytes() + np.concatenate(self.keys).tobytes()

    @classmethod
    def load(cls, data: bytes, k: int, n: int) -> Heaps:
        h, ends = cls(k), np.cumsum(np.frombuffer(data, np.int32, k))[:-1]
        h.rows = np.split(np.frombuffer(data, np.int32, n, 4 * k), ends)
        h.keys = np.split(np.frombuffer(data, np.float32, n, 4 * (k + n)), ends)
        return h


@dataclass
class Codebooks:
    """books: part, entry, position within the part; scanned: the parts scanned in each round."""

    books: np.ndarray
    drift: np.ndarray
    scanned: list[int] = field(default_factory=list)

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def moved(self, to: np.ndarray) -> None:
        """New entries; each one's drift grows by its own way and the longest way of another."""
        way = np.sqrt(((to - self.books) ** 2).sum(2).astype(np.float64)) * (1 + MARGIN)
        if way.shape[1] > 1:
            top = np.sort(way, axis=1)
            other = np.where((way == top[:, -1:]) & (np.arange(way.shape[1]) == way.argmax(1)[:, None]), top[:, -2:-1], top[:, -1:])
            way = way + other
        self.drift, self.books = self.drift + way, to


def _sound(vectors: DataFrame) -> DataFrame:
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(good, F.lit(False)))


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """rows packed into blocks (block, vec_id[], label[], n, data), bucketed by block."""
    ids, labels = rows.schema["vec_id"].dataType, rows.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 24, [], 0

        def block() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            e, ends = t["embedding"].combine_chunks(), pa.array([0, len(t)], pa.int32())
            data = integers(e.flatten().to_numpy(zero_copy_only=False), e.value_lengths().to_numpy(zero_copy_only=False), dim)
            number += 1
            lists = [pa.ListArray.from_arrays(ends, t[c].combine_chunks()) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([len(t)], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["block", "vec_id", "label", "n", "data"])

        for b in batches:
            for at in range(0, len(b), BLOCK):
                piece = b.slice(at, BLOCK)
                if n + len(piece) > BLOCK:
                    yield block()
                    held, n = [], 0
                held.append(piece)
                n += len(piece)
        if n:
            yield block()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("vec_id", T.ArrayType(ids)), T.StructField("label", T.ArrayType(labels)), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())])
    n = width(rows.sparkSession)
    return bucketed(map_batches(rows, run, schema).repartition(n, "block"), "block", n, "blocks")


def _round(blocks: DataFrame, heaps: DataFrame | None, c: Codebooks) -> DataFrame:
    """A table, bucketed as blocks are: (block, heaps) rows, and (part, entry, n, sums, scanned) rows with what changed."""
    books, drift = c.books, c.drift
    parts, k, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["data"], np.int32).reshape(r["n"], parts, w).astype(np.int64)
                states, count, total, scanned = [], np.zeros((parts, k), np.int64), np.zeros((parts, k, w), np.int64), 0
                for p in range(parts):
                    h = Heaps.load(r["heaps"][p], k, r["n"]) if "heaps" in r else Heaps(k)
                    rows, old, now = h.step(x[:, p], books[p], drift[p], "heaps" not in r)
                    scanned += len(rows)
                    turned = old != now
                    rows, old, now = rows[turned], old[turned], now[turned]
                    np.add.at(count[p], now, 1)
                    np.add.at(total[p], now, x[rows, p])
                    left = old >= 0
                    np.subtract.at(count[p], old[left], 1)
                    np.subtract.at(total[p], old[left], x[rows[left], p])
                    states.append(h.dump())
                changed = [(p, j) for p in range(parts) for j in range(k) if count[p, j] or total[p, j].any()]
                m = 1 + len(changed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["block"]] * m, pa.int64()), pa.array([states] + [None] * (m - 1), pa.list_(pa.binary())), pa.array([None] + [p for p, _ in changed], pa.int32()), pa.array([None] + [j for _, j in changed], pa.int32()),
                        pa.array([0] + [int(count[at]) for at in changed], pa.int64()), pa.array([None] + [total[at].tolist() for at in changed], pa.list_(pa.int64())), pa.array([scanned] + [0] * (m - 1), pa.int64()),
                    ],
                    ["block", "heaps", "part", "entry", "n", "sums", "scanned"],
                )

    rows = blocks.select("block", "n", "data") if heaps is None else blocks.select("block", "n", "data").join(heaps, "block")
    return bucketed(map_batches(rows, run, "block long, heaps array<binary>, part int, entry int, n long, sums array<long>, scanned long"), "block", width(blocks.sparkSession), "heaps")


def fit(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame, DataFrame | None] | None:
    """Codebooks after all rounds over vectors (vec_id, embedding, label), the blocks and their heaps; None if no row is left."""
    rows = _sound(vectors)
    longest = rows.agg(F.max(F.size("embedding")).alias("n")).first().n
    if longest is None:
        return None
    w = max(1, -(-longest // parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()  # at most so many rows
    start = integers(np.array([v for r in first for v in r.embedding], np.float64), np.array([len(r.embedding) for r in first]), w * parts)
    books = start.reshape(-1, parts, w).transpose(1, 0, 2).astype(np.int64)
    c = Codebooks(books, np.zeros(books.shape[:2]))
    blocks, heaps = _blocks(rows, w * parts), None
    count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for _ in range(rounds):
        done = _round(blocks, heaps, c)
        heaps = done.where("heaps is not null").select("block", "heaps")
        c.scanned.append(done.agg(F.sum("scanned").alias("n")).first().n)
        changes = done.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(w)])
        for r in changes.collect():  # a row an entry at most
            count[r.part, r.entry] += r.n
            total[r.part, r.entry] += np.array([r[f"s{i}"] for i in range(w)], np.int64)
        c.moved(np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], c.books))
    return c, blocks, heaps


def encode(blocks: DataFrame, heaps: DataFrame | None, c: Codebooks) -> DataFrame:
    """vec_id, label, code, error for all vectors of blocks: a last step of the heaps, then the distance to the own entry."""
    books, drift = c.books, c.drift
    parts, k, w = books.shape
    kinds = {n: blocks.schema[n].dataType.elementType for n in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(len(b)):
                n = b["n"][at].as_py()
                x = np.frombuffer(b["data"][at].as_py(), np.int32).reshape(n, parts, w).astype(np.int64)
                codes, error = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
                for p in range(parts):
                    known = "heaps" in b.schema.names
                    h = Heaps.load(b["heaps"][at].as_py()[p], k, n) if known else Heaps(k)
                    h.step(x[:, p], books[p], drift[p], not known)
                    codes[:, p] = h.entries(n)
                    error += ((x[:, p] - books[p][codes[:, p]]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b["vec_id"][at].values, b["label"][at].values, pa.array(["".join(f"{v:02x}" for v in row) for row in codes.tolist()]), pa.array(error)], ["vec_id", "label", "code", "error"])

    rows = blocks.select("block", "vec_id", "label", "n", "data")
    rows = rows if heaps is None else rows.join(heaps, "block")
    schema = T.StructType([*[T.StructField(n, t) for n, t in kinds.items()], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return map_batches(rows, run, schema)


def decode(codes: DataFrame, c: Codebooks) -> DataFrame:
    """codes (code, ...) with vector, the entries that its code names, in the scale of the input."""
    books = F.array(*[F.array(*[F.array(*[F.lit(v / SCALE) for v in e]) for e in part]) for part in c.books.tolist()])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[books[p][at(p)] for p in range(len(c.books))]))


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for vectors (vec_id, embedding, label)."""
    made = fit(vectors)
    if made is None:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    c, blocks, heaps = made
    coded = stash(encode(blocks, heaps, c), "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label").withColumn("codebooks_sha256", F.lit(c.sha256))


def op12_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
