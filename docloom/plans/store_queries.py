"""Queries of the versioned store: tables that change together, snapshots, writers that collide."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import graph, versions
from .catalogue import query, table


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new folder on shared storage, removed when the session ends."""
    path = f"{graph.shared_dir(spark)}/docloom-{tag}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: What this session's queries have written for a table's files, by those files: made by the first that asks, opened by the others.
_KEPT: dict[tuple, str] = {}


def kept(spark: SparkSession, sf_dir: str, names: tuple[str, ...], tag: str, make: Callable[[str], object]) -> str:
    """The folder that make() has written from some tables; made anew when their files have changed."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    at: tuple = (spark.sparkContext.applicationId, tag, sf_dir)
    for n in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet")
        fs = path.getFileSystem(hadoop)
        at += (fs.getContentSummary(path).getLength(), fs.getContentSummary(path).getFileCount(), fs.getFileStatus(path).getModificationTime())
    if at not in _KEPT:
        made = fresh_path(spark, tag)
        make(made)
        _KEPT[at] = made
    return _KEPT[at]


KINDS = ("validation", "confidence", "normalisation", "review")


def _results(orders: DataFrame, worth: float) -> dict[str, DataFrame]:
    """The four tables of trust results: an order is an entity, its priority the run; review holds the doubtful ones only."""
    e = orders.select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("entity"), rounded(F.least(F.lit(1.0), F.col("o_totalprice") / worth), 6).alias("overall"), F.col("o_orderdate").alias("day"))
    return {
        "validation": e.select("run", "entity", F.lit("dated").alias("rule"), F.col("day").isNotNull().alias("passed")),
        "confidence": e.select("run", "entity", "overall"),
        "normalisation": e.select("run", "entity", F.concat(F.lit("order:"), F.col("entity")).alias("canonical_id")),
        "review": e.where("overall < 0.3").select("run", "entity", F.when(F.col("overall") < 0.1, "high").otherwise("medium").alias("priority")),
    }


def _sums(store: versions.Store, version: int) -> DataFrame:
    measure = {"validation": F.col("passed").cast("long"), "confidence": rounded(F.col("overall") * 1000, 0).cast("long"), "normalisation": F.length("canonical_id").cast("long"), "review": (F.col("priority") == "high").cast("long")}
    out = [store.read(k, version).groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.sum(measure[k]).cast("long").alias("total"), F.max("entity").alias("last")).select(F.lit(version).alias("version"), F.lit(k).alias("kind"), "run", "rows", "total", "last") for k in KINDS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_WORTH = "CASE WHEN version = 2 AND o_orderpriority = '1-URGENT' THEN 900000 ELSE 300000 END"


@query(f"""WITH e AS (SELECT version, o_orderpriority AS run, o_orderkey AS entity, round(least(1.0, o_totalprice / {_WORTH}), 6) AS overall, o_orderdate AS day
  FROM orders, (VALUES (1), (2), (3)) v(version) WHERE NOT (version = 3 AND o_orderpriority IN ('1-URGENT', '5-LOW'))
  UNION ALL SELECT 3, o_orderpriority, o_orderkey, round(least(1.0, o_totalprice / 900000), 6), o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT CAST(version AS INTEGER) AS version, kind, run, count(*) AS rows, CAST(sum(CASE kind WHEN 'validation' THEN CASE WHEN day IS NOT NULL THEN 1 ELSE 0 END WHEN 'confidence' THEN CAST(round(overall * 1000) AS BIGINT) WHEN 'normalisation' THEN length('order:' || entity) ELSE CASE WHEN overall < 0.1 THEN 1 ELSE 0 END END) AS BIGINT) AS total, max(entity) AS last
FROM e, (VALUES ('validation'), ('confidence'), ('normalisation'), ('review')) k(kind) WHERE kind <> 'review' OR overall < 0.3 GROUP BY ALL""")
def atomic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REV-6, EXT-3, SRC-4..7: four tables of a run replaced together. Version 1 holds all runs; 2 replaces one run, while a
    second writer of that run, which began at version 1 too, fails; 3 drops another run. All three can be read after that."""
    orders = table(spark, sf_dir, "orders")
    store = versions.Store(spark, fresh_path(spark, "store"))
    first = store.begin()
    for kind, df in _results(orders, 300000.0).items():
        first.replace_each(kind, df, "run")
    first.commit()
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    mine, late = store.begin(), store.begin()
    for kind in KINDS:
        mine.replace(kind, _results(urgent, 900000.0)[kind], "1-URGENT")
        late.replace(kind, _results(urgent, 1.0)[kind], "1-URGENT")
    mine.commit()
    try:
        late.commit()
    except versions.Conflict:
        last = store.begin()
        for kind in KINDS:
            last.drop(kind, "5-LOW")
        last.commit()
    return _sums(store, 1).unionByName(_sums(store, 2)).unionByName(_sums(store, 3))
