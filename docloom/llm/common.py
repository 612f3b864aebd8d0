"""What the corpus operators share: tables, stages kept on shared storage, Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and 09-0D (``bytes.split()`` splits on exactly these).
SPACES = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes that one Arrow batch may hold; texts are long, and a worker holds a few batches at once. A row over the bytes is a batch.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Where none is set, a local session (whose
    executors are the driver) gets one of its own; on a cluster that would be another folder on each machine, so it fails."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("/tmp/docloom-checkpoints")
        where = sc.getCheckpointDir()
    return where


def stash(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, and survives lost executors. Removed when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _removed_at_exit(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def held(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks while a few steps read it: for many small parts, of which a table would make as many
    files. Lost parts are made anew from their lineage. The caller lets go of it with unpersist()."""
    return df.persist(StorageLevel.DISK_ONLY)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded in rows and bytes; the workers find this package wherever the driver found it.

    Spark reads both bounds when it plans, so they are set for the session, never above what it had."""
    spark = df.sparkSession
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"([0-9]+)b?", spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)
    reach_workers(spark)
    return df.mapInArrow(f, schema)


def reach_workers(spark: SparkSession) -> None:
    """Workers find this package wherever the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


def shard_ids(spark: SparkSession, n: int) -> list[int]:
    """n numbers that Spark's hash partitioning deals to n partitions, one each: number k goes to partition k."""
    found: dict[int, int] = {}
    at = 0
    while len(found) < n:
        rows = spark.range(at, at + 32 * n, numPartitions=1).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("to"))
        for r in rows.groupBy("to").agg(F.min("id").alias("id")).collect():  # at most n rows
            found.setdefault(r.to, r.id)
        at += 32 * n
    return [found[k] for k in range(n)]


def bucketed(df: DataFrame, key: str, n: int, tag: str) -> DataFrame:
    """df, already dealt by key to n partitions, written once to the shared folder as n buckets, so that readers by key need no exchange."""
    spark = df.sparkSession
    name = f"docloom_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    _removed_at_exit(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def width(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: the session's own number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Words of a text, in SQL; null: 0."""
    t = F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, 0).otherwise(F.size(F.split(t, f"[{SPACES}]+"))).cast("long")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def lowered(text: str) -> bytes:
    """A-Z lower-cased, as UTF-8; lone surrogates kept."""
    return text.encode("utf-8", "surrogatepass").lower()


def strings(column: pa.Array) -> list:
    return column.to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n; longer texts lengthen them."""
    if len(_POWERS[0]) <= n:
        m = max(1 << 16, 1 << n.bit_length())
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(m + 1, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans, by one polynomial prefix sum over the bytes."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased words joined by single spaces, and where each word starts and ends."""
    data = b" ".join(lowered(text).split())
    if not data:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    return data, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
