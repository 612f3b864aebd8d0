"""Traversal over an adjacency that is written once, in buckets: hops send frontiers to the edges, never edges.

``Adjacency`` holds every edge in both directions, bucketed by ``cell``: a node's number, or for a hub (more than HUB neighbours) one of several, by
neighbour, so that no bucket has all edges of a hub. A hop deals the frontier by cell, a row a node and slice of it, and meets the bucketed edges
there; Spark reads those without an exchange. What a frontier node passes on is combined by map-side sums before it is dealt.

``reach`` walks from many seeds at once: each node carries a set of seeds as bits of 64-bit words, so a hop has a row a node, not one a
seed and node; seeds beyond WORDS words are rows of further rounds, which walk in the same hops. ``levels`` counts what each of very many seeds
reaches, and walks once for all seeds with the same neighbours. ``nearest`` labels each node once, by the first seed of the fewest
hops. ``path`` searches from both ends, always growing the smaller side, and then follows the nodes of shortest paths only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import MAX_DEPTH, both_ways, cut
from .versions import Store

HUB = 10_000
WORDS = 16


def _cell(node: Column, slice_: Column) -> Column:
    return F.xxhash64(node, slice_)


class Adjacency:
    """Edges of a folder, read in both directions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        snap = self.store.snapshot()
        self.buckets = self.store.read("shape", snap).first().buckets
        self.edges = self.store.read_buckets("edges", (self.buckets, "cell"), snap)[0]
        self.hubs = self.store.read("hubs", snap)

    @classmethod
    def build(cls, edges: DataFrame, path: str, a: str = "a", b: str = "b", hub: int = HUB) -> Adjacency:
        """edges (a, b), either way, repeats once, in a new folder."""
        spark = edges.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        both = cut(both_ways(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b))
        hubs = cut(both.groupBy("a").count().where(F.col("count") > hub).select(F.col("a").alias("node"), F.ceil(F.col("count") / hub).cast("int").alias("slices")))
        sliced = both.join(hubs, F.col("a") == F.col("node"), "left").withColumn("slice", F.pmod(F.xxhash64("b"), F.coalesce("slices", F.lit(1))))
        w = Store(spark, path).begin()
        w.replace("shape", spark.createDataFrame([(n,)], "buckets int")).replace("hubs", hubs)
        w.replace("edges", sliced.select(_cell(F.col("a"), F.col("slice")).alias("cell"), "a", "b").repartition(n, "cell").sortWithinPartitions("cell"), "", (n, "cell"))
        w.commit()
        return cls(spark, path)

    def step(self, frontier: DataFrame) -> DataFrame:
        """frontier (node, ...) with to, each neighbour of node."""
        at = frontier.join(self.hubs.withColumnRenamed("node", "_hub"), F.col("node") == F.col("_hub"), "left")
        cells = at.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1)).cast("long") - 1))).withColumn("_cell", _cell(F.col("node"), F.col("_slice"))).drop("_hub", "slices", "_slice")
        # equality of nodes is said as two bounds: as a second key of the join it would have both sides dealt again by both keys
        same = (F.col("_cell") == F.col("cell")) & (F.col("node") >= F.col("a")) & (F.col("node") <= F.col("a"))
        here = cells.repartition(self.buckets, "_cell").join(self.edges, same)
        return here.withColumn("to", F.col("b")).drop("_cell", "cell", "a", "b")

    def numbered(self, seeds: DataFrame) -> DataFrame:
        """Each seed (seed) once, with at: a number of its own, gapless within each of a few partitions. Written once, so it stays."""
        one = cut(seeds.where("seed is not null").select("seed").distinct())
        return cut(one.repartition(1 + one.count() // (64 * WORDS * 64), "seed").withColumn("at", F.monotonically_increasing_id()))

    def reach(self, starts: DataFrame, depth: int) -> DataFrame:
        """node, depth, round and words for starts (node, at): at each depth the numbers at, as bits, that reach node in so many hops and no fewer; starts themselves at 0.

        Bit k % 64 of word k // 64 of round r is the number r * 64 * WORDS + k. All rounds walk at once, a row a node and round."""
        at = F.col("at") % (64 * WORDS)
        last = starts.agg(F.max(at).alias("last")).first().last
        words = [f"w{k}" for k in range(1 + (last or 0) // 64)]
        either = lambda df, to="": df.agg(*[F.bit_or(w).alias(to + w) for w in words])
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
        start = starts.select("node", F.floor(F.col("at") / (64 * WORDS)).alias("round"), *[F.when(F.floor(at / 64) == k, bit).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(words)])
        new = cut(either(start.groupBy("node", "round")).withColumn("depth", F.lit(0)))
        levels = [new]
        for d in range(1, min(depth, MAX_DEPTH) + 1):
            sent = either(self.step(new.drop("depth")).groupBy(F.col("to").alias("node"), "round"))
            known = either(reduce(DataFrame.unionByName, levels).groupBy(F.col("node").alias("_node"), F.col("round").alias("_round")), "_")
            fresh = sent.join(known, (F.col("node") == F.col("_node")) & (F.col("round") == F.col("_round")), "left").select("node", "round", *[F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0)))).alias(w) for w in words])
            new = cut(fresh.where(reduce(lambda x, y: x | y, [F.col(w) != 0 for w in words])).withColumn("depth", F.lit(d)))
            if new.isEmpty():
                break
            levels.append(new)
        return reduce(DataFrame.unionByName, levels).select("node", "depth", "round", F.array(*words).alias("words"))

    @staticmethod
    def _bits(reached: DataFrame) -> DataFrame:
        """at, node, depth: the bits of reach() as rows."""
        each = reached.select("node", "depth", "round", F.posexplode("words").alias("w", "bits")).where("bits <> 0")
        bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0))
        return each.withColumn("k", bit).select((F.col("round") * 64 * WORDS + F.col("w") * 64 + F.col("k")).alias("at"), "node", "depth")

    def within(self, seeds: list | DataFrame, depth: int) -> DataFrame:
        """seed, node, depth of all nodes within depth hops of each seed (a list, or rows of seed)."""
        if isinstance(seeds, list):
            seeds = self.spark.createDataFrame([(s,) for s in seeds], f"seed {self.edges.schema['a'].dataType.simpleString()}")
        names = self.numbered(seeds)
        return self._bits(self.reach(names.select(F.col("seed").alias("node"), "at"), depth)).join(names, "at").select("seed", "node", "depth")

    def levels(self, seeds: DataFrame, depth: int) -> DataFrame:
        """seed, depth, nodes, first_node, last_node for seeds (seed): how many nodes are so many hops from each seed, the least of them and the greatest.

        Seeds with the same neighbours have the same nodes at each depth, but for themselves, whom they meet two hops away (one, if they are their own neighbour):
        so each such class walks once, from its neighbours, and its seeds take its levels without themselves."""
        every = seeds.select("seed").distinct()
        zero = every.select("seed", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("nodes"), F.col("seed").alias("first_node"), F.col("seed").alias("last_node"))
        near = cut(self.step(every.where("seed is not null").select(F.col("seed").alias("node"))).select(F.col("node").alias("seed"), "to"))
        print_ = [F.bit_xor(F.xxhash64(F.lit(k), "to")).alias(f"x{k}") for k in range(2)]
        seen = near.groupBy("seed").agg(F.count(F.lit(1)).alias("x2"), *print_, F.bool_or(F.col("seed") == F.col("to")).alias("loop"))
        alike = cut(seen.join(seen.groupBy("x0", "x1", "x2").agg(F.min("seed").alias("rep")), ["x0", "x1", "x2"]).select("seed", "rep", "loop"))
        # equal prints may hide other neighbours: such a seed, of whose equally many neighbours one is not the representative's, is a class of its own
        theirs = near.select(F.col("seed").alias("rep"), "to")
        odd = near.join(alike.where("seed <> rep"), "seed").join(theirs, ["rep", "to"], "left_anti").select("seed", F.lit(True).alias("odd")).distinct()
        alike = cut(alike.join(odd, "seed", "left").select("seed", "loop", F.when(F.col("odd"), F.col("seed")).otherwise(F.col("rep")).alias("rep")))
        names = self.numbered(alike.select(F.col("rep").alias("seed")))
        starts = near.join(names, "seed").select(F.col("to").alias("node"), "at")
        rows = self._bits(self.reach(starts, min(depth, MAX_DEPTH) - 1)) if depth > 0 else self._bits(self.reach(starts.where("false"), 0))
        ends = cut(rows.groupBy("at", "depth").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("f1"), F.max("node").alias("l1")))
        second = rows.join(ends, ["at", "depth"]).groupBy("at", "depth", "nodes", "f1", "l1").agg(F.min(F.when(F.col("node") != F.col("f1"), F.col("node"))).alias("f2"), F.max(F.when(F.col("node") != F.col("l1"), F.col("node"))).alias("l2"))
        of = second.join(names.withColumnRenamed("seed", "rep"), "at").withColumn("depth", F.col("depth") + 1)
        own = F.col("depth") == F.when(F.col("loop"), 1).otherwise(2)
        other = lambda x, y: F.when(own & (F.col(x) == F.col("seed")), F.col(y)).otherwise(F.col(x))
        far = alike.join(of, "rep").select("seed", "depth", (F.col("nodes") - own.cast("long")).alias("nodes"), other("f1", "f2").alias("first_node"), other("l1", "l2").alias("last_node"))
        return zero.unionByName(far.where("nodes > 0"))

    def nearest(self, seeds: DataFrame, depth: int) -> DataFrame:
        """node, hops, seed for seeds (seed): the fewest hops over all seeds, then the first seed; a row a node."""
        new = cut(seeds.select(F.col("seed").alias("node"), F.lit(0).alias("hops"), "seed").distinct())
        levels, seen = [new], new.select("node")
        for d in range(1, min(depth, MAX_DEPTH) + 1):
            sent = self.step(new.select("node", "seed")).groupBy(F.col("to").alias("node")).agg(F.min("seed").alias("seed"))
            new = cut(sent.join(seen, "node", "left_anti").select("node", F.lit(d).alias("hops"), "seed"))
            if new.isEmpty():
                break
            levels.append(new)
            seen = seen.unionByName(new.select("node"))
        return reduce(DataFrame.unionByName, levels)

    def path(self, start, end) -> list | None:
        """The nodes of a shortest path of at most MAX_DEPTH hops; of several the one with the smallest nodes from the end backwards. None if there is none."""
        kind = self.edges.schema["a"].dataType.simpleString()
        one = lambda x: self.spark.createDataFrame([(x,)], f"node {kind}")
        sides = [[one(start)], [one(end)]]
        if start == end:
            return [start]
        seen, sizes, meet = [sides[0][0], sides[1][0]], [1, 1], None
        while meet is None:
            if len(sides[0]) + len(sides[1]) - 2 == MAX_DEPTH:
                return None
            k = 0 if sizes[0] <= sizes[1] else 1
            new = cut(self.step(sides[k][-1]).select(F.col("to").alias("node")).distinct().join(seen[k], "node", "left_anti"))
            sizes[k] = new.count()
            if not sizes[k]:
                return None
            sides[k].append(new)
            seen[k] = cut(seen[k].unionByName(new))
            both = cut(new.join(sides[1 - k][-1], "node", "left_semi"))
            meet = None if both.isEmpty() else both
        # levels of nodes on shortest paths: from where the sides met, onwards to the end through the levels of its side
        levels, good = sides[0][:-1] + [meet], meet
        for back in reversed(sides[1][:-1]):
            good = cut(self.step(good).select(F.col("to").alias("node")).distinct().join(back, "node", "left_semi"))
            levels.append(good)
        at, out = end, [end]
        for near in reversed(levels[:-1]):  # at most MAX_DEPTH steps of one row each
            at = self.step(one(at)).select(F.col("to").alias("node")).join(near, "node", "left_semi").agg(F.min("node").alias("node")).first().node
            out.append(at)
        return out[::-1]
