"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Target tokens of a source: its weight's share of all tokens, at most CAP times its own, the excess shared again by weight
(a water level, found on one row a source). Document rates minimise the divergence from one copy each under that token
constraint: r = min(CAP, exp(lambda * z)), z the document's size relative to its source's mean. The dual is convex, one
lambda a source. It is solved by Newton iterations over all documents, each a distributed sum of tokens and slopes by source,
with map-side sums, so no key's rows meet in one task, however large the source. They start from the solution on a
histogram of at most some 500 size buckets a source, which leaves them a step or two. Rates are rounded by a hash of the
row; then at most PICKS documents a bucket, largest first, move by whole copies until the remainder is less than what such
documents can mend.

Defined results: null text: size 0, taken 0. A null source is a source of its own and comes last. A table without words
has targets 0. Repeated rows count each and are treated alike; rows of one doc_id with other texts or sources are other rows.
Other columns are ignored. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stash, table

WEIGHTS = (5, 2, 1)
CAP = 3
#: Newton steps on the histogram, inside a row a source; at most so many over the documents, until all constraints hold to NEAR.
STEPS, ROUNDS, NEAR = 80, 6, 1e-9
PICKS = 4


def _bucket(size: Column) -> Column:
    return F.when(size <= 16, size).otherwise(F.floor(F.log2(size.cast("double")) * 8)).cast("int")


def targets(by_source: DataFrame) -> DataFrame:
    """by_source (source, source_size, ...) with target; a row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    df = by_source.withColumn("w", w.cast("double")).withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_w", F.sum("w").over(everything))
    df = df.withColumn("most", (F.lit(CAP) * F.col("source_size")).cast("double")).withColumn("fill", F.col("most") / F.col("w"))
    below = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("full_w", F.coalesce(F.sum("w").over(below), F.lit(0.0))).withColumn("full", F.coalesce(F.sum("most").over(below), F.lit(0.0)))
    df = df.withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_w") - F.col("full_w")))
    df = df.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("fill"), F.col("level")), F.when(F.col("level") <= F.col("fill"), F.col("full_w"))).over(everything))
    return df.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most")))).drop("w", "total", "all_w", "most", "fill", "full_w", "full", "level")


def _rate(lam: Column, z: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(lam * z, F.lit(50.0))))


def duals(sizes: DataFrame) -> DataFrame:
    """source, source_size, mean, target, full, lam from sizes (source, size, bucket)."""
    hist = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    by = hist.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum("docs").alias("source_docs"), F.sort_array(F.collect_list(F.struct("bucket", "tokens", "docs"))).alias("hist"))
    by = targets(by).withColumn("mean", F.greatest(F.col("source_size"), F.lit(1)) / F.col("source_docs"))
    by = by.withColumn("hist", F.transform("hist", lambda h: F.struct(h["tokens"].cast("double").alias("tokens"), (h["tokens"] / h["docs"] / F.col("mean")).alias("z"))))

    def newton(state: Column, _: Column) -> Column:
        lam = state["lam"]
        zero = F.lit(0.0)
        got = F.aggregate("hist", zero, lambda a, h: a + h["tokens"] * _rate(lam, h["z"]))
        slope = F.aggregate("hist", zero, lambda a, h: a + F.when(_rate(lam, h["z"]) < CAP, h["tokens"] * h["z"] * _rate(lam, h["z"])).otherwise(0.0))
        return _stepped(state, got, slope)

    start = F.struct(F.lit(0.0).alias("lam"), F.lit(-1e5).alias("low"), F.lit(1e5).alias("high"))
    by = by.withColumn("lam", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, newton)["lam"])
    full = F.col("target") >= F.lit(CAP * (1 - 1e-12)) * F.col("source_size")
    by = stash(by.select("source", "source_size", "mean", "target", full.alias("full"), F.struct("lam", F.lit(-1e5).alias("low"), F.lit(1e5).alias("high")).alias("state")), "duals")
    for _ in range(ROUNDS):
        each = _of_source(sizes.select("source", "size"), by)
        rate = _rate(F.col("state.lam"), F.col("size") / F.col("mean"))
        sums = each.groupBy("source").agg(F.sum(F.col("size") * rate).alias("got"), F.sum(F.when(rate < CAP, F.col("size") * F.col("size") / F.col("mean") * rate).otherwise(0.0)).alias("slope"))
        both = by.join(sums.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        both = stash(both.withColumn("off", F.when(F.col("full"), 0.0).otherwise(F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))), "duals")
        off = both.agg(F.max("off").alias("off")).first().off or 0.0
        if off <= NEAR:
            break
        by = both.withColumn("state", _stepped(F.col("state"), F.col("got"), F.col("slope"))).drop("got", "slope", "off")
    return by.withColumn("lam", F.col("state.lam")).drop("state")


def _stepped(state: Column, got: Column, slope: Column) -> Column:
    """A Newton step for the constraint that got tokens meet the target, halving what is known to hold the root where it would leave that."""
    lam, over = state["lam"], got > F.col("target")
    low, high = F.when(over, state["low"]).otherwise(lam), F.when(over, lam).otherwise(state["high"])
    step = lam - F.when(slope > 0, (got - F.col("target")) / slope).otherwise(F.lit(float("inf")))
    met = F.abs(got - F.col("target")) <= F.lit(NEAR / 10) * F.col("target")
    return F.struct(F.when(met, lam).when((step > low) & (step < high), step).otherwise((low + high) / 2).alias("lam"), low.alias("low"), high.alias("high"))


def _of_source(df: DataFrame, plan: DataFrame) -> DataFrame:
    """df (source, ...) with its source's row of plan; Spark sends plan to all tasks only if it finds it small."""
    plan = plan.withColumnRenamed("source", "_source")
    return df.join(plan, df["source"].eqNullSafe(plan["_source"])).drop("_source")


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "source", "text")


def _planned(docs: DataFrame) -> DataFrame:
    """key, doc_id, size, source_size, target, copies, rate for docs (doc_id, source, text)."""
    size = n_words(F.col("text"))
    sizes = stash(docs.select(_row_key(docs).alias("key"), "doc_id", "source", size.alias("size")).withColumn("bucket", _bucket(F.col("size"))), "sizes")
    plan = stash(duals(sizes), "rates")
    chance = F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit("copies")), 11).cast("double") * F.lit(2.0**-53)
    rate = F.when(F.col("full"), float(CAP)).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean")))
    first = _of_source(sizes, plan).withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance).cast("long")).drop("lam", "mean", "full")
    pick = F.when(F.col("size") > 0, F.struct("key", "size", "copies"))
    # of equal rows all move, so their number counts
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(PICKS)).alias("part")
    got = first.groupBy("source", "bucket", part).agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.min_by(pick, F.when(F.col("size") > 0, F.struct(F.xxhash64("key"), F.col("key")))).alias("pick"))
    alike = first.join(got.select(F.col("pick.key").alias("key")).where("key is not null").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("alike"))
    got = got.join(alike.withColumnRenamed("key", "_key"), F.col("pick.key") == F.col("_key"), "left")
    chosen = F.when(F.col("pick").isNotNull(), F.struct((F.col("pick.size") * F.col("alike")).alias("size"), F.col("pick.key").alias("moved"), F.col("pick.copies").alias("copies")))
    got = got.groupBy("source").agg((F.first("target") - F.sum("taken")).alias("short"), F.sort_array(F.collect_list(chosen), asc=False).alias("picks"))

    def mend(state: Column, p: Column) -> Column:
        by = F.greatest(-p["copies"], F.least(F.lit(CAP) - p["copies"], F.round(state["short"] / p["size"]).cast("long")))
        return F.struct((state["short"] - by * p["size"]).alias("short"), F.concat(state["moves"], F.array(F.struct(p["moved"].alias("moved"), by.alias("by")))).alias("moves"))

    kind = "array<struct<moved:bigint,by:bigint>>"
    got = got.withColumn("moves", F.aggregate("picks", F.struct(F.col("short").alias("short"), F.array().cast(kind).alias("moves")), mend)["moves"])
    moves = stash(got.select(F.explode("moves").alias("m")).select("m.*").where("by <> 0"), "moves")
    return first.join(moves, F.col("key") == F.col("moved"), "left").withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("moved", "by")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and rate for docs (doc_id, source, text)."""
    return _planned(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, source, text, ...), each as often as the mix takes it."""
    copies = _planned(docs).where("copies > 0").select(F.col("key").alias("_key"), F.col("copies").cast("int").alias("_copies")).distinct()
    rows = docs.withColumn("_row", _row_key(docs)).join(copies, F.col("_row") == F.col("_key"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
