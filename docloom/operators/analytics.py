"""Analytics: distributions, growth, degrees, facets, percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def signature(df: DataFrame, order: Column, value: Column) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return df.agg(F.md5(F.array_join(F.transform(rows, lambda r: r["v"]), ",").cast("binary")).alias("signature"))


def percentiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """p50, p95 by nearest rank, and the mean.

    Equal values are counted first; counts are dealt by ranges of (key, value), and a value's rank is the counts before it in its range plus those of
    the key's ranges before, one sum each. So a key with very many values is ranked by many tasks."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_value")).agg(F.count("*").alias("n"))
    by = [F.col("_key").asc_nulls_first(), F.col("_value")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counted.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    placed = dealt.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(F.col("_key").alias("_k"), F.col("_part").alias("_p")).agg(F.sum("n").alias("_n"), F.sum(F.col("_value") * F.col("n")).alias("_sum"))
    w = Window.partitionBy("_k")  # a row a range
    far = parts.select("_k", "_p", (F.sum("_n").over(w.orderBy("_p")) - F.col("_n")).alias("far"), F.sum("_n").over(w).alias("of"), F.sum("_sum").over(w).alias("sum"))
    near = placed.withColumn("near", F.sum("n").over(Window.partitionBy("_part", "_key").orderBy("_at")))
    ranked = near.join(far, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    at = lambda p: F.min(F.when(F.col("far") + F.col("near") >= F.floor(p * (F.col("of") - 1) + 0.5) + 1, F.col("_value")))
    return ranked.groupBy(F.col("_key").alias(key)).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.max("sum") / F.max("of"), 6).alias("mean"))


def top_degrees(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    degree = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    all_ = nodes.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("type").orderBy(F.desc("degree"), "id")
    return all_.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("type", "id", "degree")


def distribution(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    given = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return given.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def growth(df: DataFrame, at: str, spans: int) -> DataFrame:
    """bucket 0..spans and the rows up to its end; spans are equal parts between the first and the last instant."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    ends = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    bucket = F.least(F.lit(spans), F.ceil((t - F.col("lo")) * F.lit(float(spans)) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)))).cast("long")
    per = df.where(F.col(at).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(bucket, F.lit(0)).alias("bucket")).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.range(spans + 1).withColumnRenamed("id", "bucket").join(per, "bucket", "left")
    return all_.select("bucket", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bucket")).alias("total"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Four half-open bins from 0.6, zero-filled; lower values count nowhere."""
    bins = [("0.60-0.70", 0.6, 0.7), ("0.70-0.80", 0.7, 0.8), ("0.80-0.90", 0.8, 0.9), ("0.90-1.00", 0.9, 1.01)]
    c = F.col(column)
    one = df.agg(*(F.count_if((c >= lo) & (c < hi)).alias(label) for label, lo, hi in bins))
    return one.select(F.explode(F.array(*(F.struct(F.lit(b[0]).alias("label"), F.col(f"`{b[0]}`").alias("n")) for b in bins))).alias("x")).select("x.*")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n for several columns in one pass."""
    one = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns))).alias("x")).select("x.*")
    return one.where(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count("*").alias("n"))


def faceted(df: DataFrame, among: dict[str, list], texts: list[str], needle: str | None) -> DataFrame:
    out = reduce(lambda d, kv: d.where(F.col(kv[0]).isin(kv[1])), among.items(), df)
    return out.where(F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit(needle.lower()))) if needle else out


def keyword_match(df: DataFrame, texts: list[str], needle: str) -> DataFrame:
    """Rows whose text holds any token of needle; a blank one matches all."""
    words = needle.lower().split()
    text = F.lower(F.concat_ws("\n", *texts))
    return df.where(reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))) if words else df


def timeline(nodes: DataFrame, edges: DataFrame, now: DataFrame, days: int) -> DataFrame:
    """Edges (a, b) both ends of which were first seen within so many days before now."""
    kept = nodes.crossJoin(F.broadcast(now)).where(F.col("first_seen") >= F.expr(f"now - interval {days} days")).select("id")
    return edges.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").join(kept.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
