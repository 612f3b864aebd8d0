"""Relational operators: each takes and returns DataFrames, and stays lazy."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import near


def filtered(df: DataFrame, equal: dict[str, object]) -> DataFrame:
    """Rows that equal every value given; None is no condition."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])) if kv[1] is not None else d, equal.items(), df)


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def page(df: DataFrame, equal: dict[str, object], order: list[Column], offset: int = 0, size: int = 20) -> DataFrame:
    """One page in order, with page_size and n_pages."""
    rows = filtered(df, equal)
    n = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(size))).cast("long").alias("n_pages"))
    return rows.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(n)).withColumn("page_size", F.lit(size).cast("long"))


def audit_search(df: DataFrame, equal: dict[str, object], at: str, start: DataFrame, low: str, high: str) -> DataFrame:
    """Rows from start + low to start + high, both included; n_unbounded counts the rows that meet all but the bounds."""
    rows = filtered(df, equal)
    n = rows.agg(F.count("*").alias("n_unbounded"))
    one = start.select(F.expr(f"{start.columns[0]} + {low}").alias("_low"), F.expr(f"{start.columns[0]} + {high}").alias("_high")).crossJoin(n)
    return rows.crossJoin(F.broadcast(one)).where(F.col(at).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key with the largest order, by a partial aggregate instead of a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_row")).select(*keys, "_row.*")


def at_group_max(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.max(column).alias(column)), [*keys, column])


def content_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, sha256, kept and first_id; kept is the first row of each content."""
    h = df.select(key, F.sha2(F.col(text), 256).alias("sha256"))
    first = h.groupBy("sha256").agg(F.min(key).alias("first_id"))
    return h.join(first, "sha256").select(key, "sha256", (F.col(key) == F.col("first_id")).alias("kept"), "first_id")


def pairs_within(df: DataFrame, group: str, seq: str) -> DataFrame:
    """Ordered pairs of a group's rows: group, then each other column with 1 and 2."""
    rest = [c for c in df.columns if c != group]
    a, b = (df.select(group, *(F.col(c).alias(f"{c}{k}") for c in rest)) for k in (1, 2))
    return a.join(b, group).where(F.col(f"{seq}1") < F.col(f"{seq}2"))


def supply_edges(lineitem: DataFrame) -> DataFrame:
    """src, dst, confidence and evidence of supplier-part edges."""
    return lineitem.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max(1 - F.col("l_discount")).alias("confidence"), F.countDistinct("l_orderkey").alias("evidence"))


def star_graph(table: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) and edges (a, b) of customers, suppliers, nations and regions."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("customer", "c", "c_custkey", ("n", "c_nationkey")), ("supplier", "s", "s_suppkey", ("n", "s_nationkey")), ("nation", "n", "n_nationkey", ("r", "n_regionkey")), ("region", "r", "r_regionkey", None)]
    nodes = reduce(DataFrame.unionByName, (table(t).select(name(p, k).alias("id"), F.lit(t).alias("type")) for t, p, k, _ in parts))
    edges = reduce(DataFrame.unionByName, (table(t).select(name(p, k).alias("a"), name(*up).alias("b")) for t, p, k, up in parts if up))
    return nodes, edges


def repeats(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """seq and first_id of all but the first row of each key; null is a value."""
    w = Window.partitionBy(*keys).orderBy(seq)
    return df.select(seq, F.first(seq).over(w).alias("first_id"), F.row_number().over(w).alias("_n")).where("_n > 1").drop("_n")


def conflicts(df: DataFrame, keys: list[str], seq: list[str], value: str) -> DataFrame:
    base = F.first(value).over(Window.partitionBy(*keys).orderBy(*seq))
    return df.where(F.col(value).isNotNull()).withColumn("base", base).where(~near(F.col(value), F.col("base")))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def running_sample(df: DataFrame, key: str, seq: str, size: str, limit: int) -> DataFrame:
    """How many chunks of each key are taken before limit is reached, and how much they hold."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_before", before).where(F.col("_before") < limit).groupBy(key).agg(F.count("*").alias("taken"), F.max(F.col("_before") + F.col(size)).cast("long").alias("chars"))
