"""Sharding along a Hilbert curve, in DataFrame operations only.

Metadata dimensions (source, language, size) are each quantised to 2**BITS levels of near equal numbers of rows: distinct
values are counted, ranked by range partitions and their running counts, and only the first value of each level comes to the
driver, at most 2**BITS - 1 a dimension. The levels of a row are a cell of a grid; its index along the Hilbert curve through
the grid orders the rows, so that a run of the order is compact in every dimension. Rows are dealt by ranges of (curve, text's
crc, doc_id), sorted, and numbered by partition and place in it; the counts of the partitions before give the global rank. The
order is cut into runs: equal numbers of rows (law ``rows``, shards at most one row apart) or of bytes (law ``bytes``, a row
goes where its middle byte falls). ``manifest`` gives the bounds of each dimension in each shard, by which ``pruned`` tells
the shards that a range of values can be in; ``write`` lays the documents out as one folder a shard.

A hot source is one level of one dimension; ranges also cut by crc and id, so its rows spread over partitions and shards.
Equal texts of one cell are neighbours.

Defined results: null text: size 1, crc 0. Null source or language: the lowest level. Repeated rows are rows of their own and
keep neighbouring slots. With fewer rows than shards some shards stay empty; an empty table gives no rows. Other columns are
ignored. The order has no ties but between rows equal in doc_id, text's crc and cell, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table, width

SHARDS = 16
#: Levels of a dimension, as a power of two.
BITS = 5
DIMENSIONS = ("source", "lang", "size")
#: monotonically_increasing_id() has the partition above this bit, and the place in it below.
PLACE = 33


def _ordered(df: DataFrame, keys: Sequence[Column], tag: str) -> DataFrame:
    """df written once in the order of keys, with part (its range) and place (in that range)."""
    number = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(width(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_n", number)
    return stash(dealt.select("*", F.shiftright("_n", PLACE).cast("int").alias("part"), F.col("_n").bitwiseAND(F.lit((1 << PLACE) - 1)).alias("place")).drop("_n"), tag)


def _before(ordered: DataFrame, weight: Column) -> DataFrame:
    """part and the sum of weight over the parts before it: a row a part."""
    parts = ordered.groupBy("part").agg(F.sum(weight).alias("own"))
    return parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def _placed(ordered: DataFrame, offsets: DataFrame) -> DataFrame:
    return ordered.join(offsets, F.col("part") == F.col("_part")).drop("_part")


def bounds(df: DataFrame, dim: str, bits: int = BITS) -> list:
    """The first value of each level but the lowest, ascending: levels hold near equal numbers of rows, equal values one level."""
    counts = _ordered(df.groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("n")), [F.col("value").asc_nulls_first()], "values")
    run = F.sum("n").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = counts.agg(F.sum("n").alias("n")).first().n
    if not total:
        return []
    ranked = _placed(counts.withColumn("run", run), _before(counts, F.col("n")))
    level = F.floor((F.col("before") + F.col("run") - F.col("n")) * F.lit(1 << bits) / F.lit(total))
    firsts = ranked.where("value is not null").groupBy(level.alias("level")).agg(F.min("value").alias("value")).where("level > 0")
    return sorted(r.value for r in firsts.collect())


def level(dim: Column, firsts: list) -> Column:
    """How many of the firsts are not above dim; null: 0."""
    if not firsts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, firsts)), lambda b: b <= dim)), F.lit(0))


def hilbert(levels: Sequence[Column], bits: int = BITS) -> Column:
    """The index of a cell along the Hilbert curve, after Skilling's transform of axes: undo the excess work of each bit from
    the highest down, Gray encode, interleave."""
    d = len(levels)

    def undo(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        first, own = x[0], F.get(x, i)
        swap = F.when(own.bitwiseAND(q) != 0, 0).otherwise(first.bitwiseXOR(own).bitwiseAND(q - 1))
        new_first = F.when(own.bitwiseAND(q) != 0, first.bitwiseXOR(q - 1)).otherwise(first.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, new_first).when(k == i, own.bitwiseXOR(swap)).otherwise(v))

    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(d)])
    x = F.aggregate(steps, F.array(*[c.cast("int") for c in levels]), undo) if bits > 1 else F.array(*[c.cast("int") for c in levels])
    # every array is what an aggregate starts from, so that it is made once a row
    empty = F.array().cast("array<int>")
    gray = F.aggregate(x, F.struct(empty.alias("g"), F.lit(0).alias("t")), lambda a, v: F.struct(F.concat(a["g"], F.array(a["t"].bitwiseXOR(v))).alias("g"), a["t"].bitwiseXOR(v).alias("t")))["g"]
    qs = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else empty
    turn = lambda a, q: F.struct(a["g"].alias("g"), F.when(F.get(a["g"], F.lit(d - 1)).bitwiseAND(q) != 0, a["t"].bitwiseXOR(q - 1)).otherwise(a["t"]).alias("t"))
    axes = F.aggregate(qs, F.struct(gray.alias("g"), F.lit(0).alias("t")), turn, lambda a: F.transform(a["g"], lambda v: v.bitwiseXOR(a["t"])))
    places = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(d)])
    put = lambda a, p: F.struct(a["x"].alias("x"), (a["h"] * 2 + F.when(F.get(a["x"], p["i"]).bitwiseAND(p["q"]) != 0, 1).otherwise(0)).alias("h"))
    return F.aggregate(places, F.struct(axes.alias("x"), F.lit(0).cast("long").alias("h")), put, lambda a: a["h"])


def shards(docs: DataFrame, law: str = "rows", k: int = SHARDS, dims: Sequence[str] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve and the dimensions, for docs (doc_id, text, ...)."""
    if law not in ("rows", "bytes"):
        raise ValueError("runs of a curve have equal rows or equal bytes")
    text = F.coalesce("text", F.lit("")).cast("binary")
    meta = stash(docs.select("doc_id", *[d for d in dims if d != "size"], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "metadata")
    at = [level(F.col(d), bounds(meta, d, bits)) for d in dims]
    levelled = meta.withColumns({f"_level{i}": c for i, c in enumerate(at)})
    curved = levelled.withColumn("curve", hilbert([F.col(f"_level{i}") for i in range(len(dims))], bits)).drop(*[f"_level{i}" for i in range(len(dims))])
    order = _ordered(curved, [F.col("curve"), F.col("text_crc32"), F.col("doc_id").asc_nulls_first()], "curve")
    total = order.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).first()
    rank = _placed(order, _before(order, F.lit(1).cast("long"))).withColumn("rank", F.col("before") + F.col("place")).drop("before")
    if law == "rows":
        n = F.lit(max(1, total.rows)).cast("long")
        cut = rank.withColumn("shard", F.expr("rank").cast("long") * k)
        cut = cut.withColumn("shard", ((F.col("shard") - F.pmod(F.col("shard"), n)) / n).cast("int"))
        # the first rank of shard s is the least r with r * k >= s * n
        first = F.col("shard").cast("long") * n
        cut = cut.withColumn("slot", F.col("rank") - ((first + F.pmod(-first, F.lit(k).cast("long"))) / k).cast("long"))
    else:
        run = F.sum("size").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        summed = _placed(rank.withColumn("run", run), _before(order, F.col("size")))
        middle = (F.col("before") + F.col("run") - F.col("size") / 2) * k / F.lit(max(1, total.bytes or 1))
        cut = stash(summed.withColumn("shard", F.least(F.floor(middle), F.lit(k - 1)).cast("int")).drop("before", "run"), "cut")
        firsts = cut.groupBy("shard").agg(F.min("rank").alias("first")).withColumnRenamed("shard", "_shard")
        cut = cut.join(firsts, F.col("shard") == F.col("_shard")).withColumn("slot", F.col("rank") - F.col("first")).drop("_shard", "first")
    return cut.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *[d for d in dims if d != "size"])


def manifest(sharded: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """A row a shard: rows, bytes, and for each dimension its least and greatest value and the number of nulls."""
    each = [f for d in dims for f in (F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"), F.count_if(F.col(d).isNull()).alias(f"{d}_nulls"))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *each)


def pruned(bounds_by_shard: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """The rows of a manifest whose shard can hold a row within all ranges {dimension: (least, greatest)}."""
    meets = [(F.col(f"{d}_min") <= F.lit(high)) & (F.col(f"{d}_max") >= F.lit(low)) for d, (low, high) in ranges.items()]
    return bounds_by_shard.where(reduce(lambda a, b: a & b, meets, F.lit(True)))


def write(docs: DataFrame, path: str, law: str = "rows", k: int = SHARDS) -> DataFrame:
    """The documents as one folder a shard (``shard=3/``), each file a run of the curve in order of slots; returns the manifest.

    Ranges of (shard, slot) are written, at least as many as the session has shuffle partitions, so a large shard has several files."""
    where = shards(docs, law, k)
    key = ["doc_id", "text_crc32", "size", "source", "lang"]
    same = Window.partitionBy(*key).orderBy("slot")
    mine = docs.withColumn("size", (F.octet_length(F.coalesce("text", F.lit("")).cast("binary")) + 1).cast("long")).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    mine = mine.withColumn("_same", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    at = where.select(*[F.col(c).alias(f"_{c}") for c in key], "shard", "slot", F.row_number().over(same).alias("_again"))
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]) & (F.col("_same") == F.col("_again"))
    rows = mine.join(at, met).select(docs.columns + ["shard", "slot"])
    rows.repartitionByRange(max(k, width(docs.sparkSession)), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return manifest(where)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
