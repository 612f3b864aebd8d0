"""Connected components of a table of links, by alternating large-star and small-star rounds; nothing goes to the driver but two sums a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every end of links (a long, b long); loops and repeats are allowed."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stash(pairs, "links")
    before = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now or now[0] == 0:
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
        before = now
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large["a"] == least["u"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
        pairs = stash(small, "links")
