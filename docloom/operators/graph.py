"""Graph: relationship rules, idempotent upserts, traversal, merging. Edges are traversed either way."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp

MAX_DEPTH, MAX_CONNECTOR, MIN_CONFIDENCE, MAX_MERGES = 6, 80, 0.3, 10
_PLACED = r"(?i)\bheadquartered\s+in\b|\bbased\s+in\b|\blocated\s+in\b|\bsituated\s+in\b|\bincorporated\s+in\b"
#: Source type, target type, relationship, pattern in the text between (source first), pattern with the target first, base confidence. Fixed values.
RULES = (
    ("company", "port", "owns", r"(?i)\bowns?\b|\bowning\b", r"(?i)\bowned\s+by\b", 0.75),
    ("company", "terminal", "operates", r"(?i)\boperates?\b|\boperating\b", r"(?i)\boperated\s+by\b", 0.75),
    ("commodity", "port", "shipped_from", r"(?i)\bshipped\s+from\b|\bloaded\s+at\b|\bdeparting\s+from\b|\bexported\s+from\b", None, 0.70),
    ("commodity", "country", "shipped_to", r"(?i)\bshipped\s+to\b|\bdestined\s+for\b|\bbound\s+for\b|\bexported\s+to\b|\bimported\s+(?:in)?to\b", None, 0.70),
    ("contract", "commodity", "references", "", "", 0.55),
    ("company", "country", "located_in", _PLACED, None, 0.70),
    ("port", "country", "located_in", _PLACED, None, 0.70),
    ("port", "country", "located_in", r"^\s*,\s*$", None, 0.60),
)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once to a folder of its own on shared storage, which goes when the session ends, and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set a local session gets one of its own; on a cluster it would be another on each machine, so that fails."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "/tmp/docloom-checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def findings(mentions: DataFrame) -> DataFrame:
    """chunk_id, source_id, target_id, relationship, confidence of the pairs of a chunk that a rule relates.

    mentions: chunk_id, text, entity_id, entity_type, raw_value, character_offset, trust; the first mention of an entity in a chunk."""
    m = mentions.where("character_offset is not null")
    side = lambda k: m.select("chunk_id", *(["text"] if k == 1 else []), *(F.col(c).alias(f"{c}{k}") for c in ("entity_id", "entity_type", "raw_value", "character_offset", "trust")))
    p = side(1).join(side(2), "chunk_id").where("struct(character_offset1, entity_id1) < struct(character_offset2, entity_id2)")
    end = F.col("character_offset1") + F.length("raw_value1")
    gap = F.col("character_offset2") - end
    p = p.withColumn("between", F.when((gap >= 0) & (gap <= MAX_CONNECTOR), F.substring("text", end + 1, gap)))
    out = []
    for s, t, name, ahead, back, base in RULES:
        first = (F.col("entity_type1") == s) & (F.col("entity_type2") == t)
        second = (F.col("entity_type1") == t) & (F.col("entity_type2") == s)
        fits = lambda pattern: F.lit(False) if pattern is None else F.lit(True) if pattern == "" else F.coalesce(F.rlike("between", F.lit(pattern)), F.lit(False))
        for hit, a, b in ((first & fits(ahead), "1", "2"), (second & fits(back), "2", "1")):
            out.append(F.when(hit, F.struct(F.lit(name).alias("relationship"), F.col(f"entity_id{a}").alias("source_id"), F.col(f"entity_id{b}").alias("target_id"), F.lit(base).alias("base"))))
    r = p.select("chunk_id", ((F.col("trust1") + F.col("trust2")) / 2).alias("_t"), F.explode(F.array_compact(F.array(*out))).alias("f")).select("chunk_id", "f.*", "_t")
    r = r.withColumn("confidence", F.round(clamp(F.col("base") * F.col("_t")), 9)).where(F.col("confidence") >= MIN_CONFIDENCE)
    return r.groupBy("chunk_id", "source_id", "target_id", "relationship").agg(F.max("confidence").alias("confidence"))


def upserted(edges: DataFrame, evidence: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (source_id, target_id, relationship, confidence, evidence_count) and evidence (those keys, entity_id, chunk_id) after new findings.

    The greater confidence stays, evidence is added once, counts are of distinct chunks; self-loops are dropped. A second run changes
    nothing. Where edges and new have a provenance (and new a seq), that of an edge's last new finding stands, else the edge's own."""
    key = ["source_id", "target_id", "relationship"]
    new = new.where("source_id <> target_id")
    added = new.select(*key, F.explode(F.array("source_id", "target_id")).alias("entity_id"), "chunk_id")
    all_evidence = evidence.unionByName(added).distinct()
    counts = all_evidence.groupBy(*key).agg(F.countDistinct("chunk_id").alias("evidence_count"))
    if "provenance" in edges.columns:
        said = edges.select(*key, "confidence", "provenance", F.lit(None).cast("long").alias("seq")).unionByName(new.select(*key, "confidence", "provenance", F.col("seq").cast("long").alias("seq")))
        best = said.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.max_by("provenance", F.coalesce("seq", F.lit(-1))).alias("provenance"))
    else:
        best = edges.select(*key, "confidence").unionByName(new.select(*key, "confidence")).groupBy(*key).agg(F.max("confidence").alias("confidence"))
    return best.join(counts, key, "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0))), all_evidence


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct()


def within(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, depth, parent of every node within depth hops of each seed (seed), the seed itself at 0; ties take the smallest parent."""
    e = cut(both_ways(edges))
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(dict(seeds.dtypes)["seed"]).alias("parent")).distinct()
    front = seen
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        step = front.select("seed", F.col("node").alias("a")).join(e, "a").groupBy("seed", F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        front = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(d).alias("depth"), "parent"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def nearest_seed(reached: DataFrame) -> DataFrame:
    """node, hops, seed: the fewest hops over all seeds, then the first seed."""
    return reached.groupBy("node").agg(F.min(F.struct("depth", "seed")).alias("m")).select("node", F.col("m.depth").alias("hops"), F.col("m.seed").alias("seed"))


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """One row with the nodes of a shortest path of at most MAX_DEPTH hops, smallest parents first; no row if there is none."""
    spark = edges.sparkSession
    reached = within(edges, spark.createDataFrame([(start,)], "seed string"), MAX_DEPTH)
    back = reached.where(F.col("node") == end).select(F.array("node").alias("path"), "parent")
    for _ in range(MAX_DEPTH):
        up = reached.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
        back = back.join(up, "parent", "left").select(F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"), F.col("_next").alias("parent"))
    return back.select("path", (F.size("path") - 1).alias("hops"))


def subgraph(edges: DataFrame, reached: DataFrame, cap: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Edges (a, b, ...) both ends of which were reached; with cap, only those among the first of either end."""
    nodes = reached.select("node").distinct()
    inside = edges.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi")
    if cap is None:
        return inside
    ranks = [F.row_number().over(Window.partitionBy(c).orderBy(*(order or [F.asc("a"), F.asc("b")]))).alias(f"_{c}") for c in ("a", "b")]
    return inside.select("*", *ranks).where((F.col("_a") <= cap) | (F.col("_b") <= cap)).drop("_a", "_b")


def survivors(merges: DataFrame) -> DataFrame:
    """node, survivor along merge chains (node, into) of at most MAX_MERGES hops; a missing target ends a chain.

    Pointers are doubled: two hops, four, eight, and eight after two; each step is one join of the merges with themselves."""

    def after(far: DataFrame, near: DataFrame) -> DataFrame:
        """Where far leads from where near leads."""
        step = far.select(F.col("node").alias("survivor"), F.col("survivor").alias("_next"))
        return near.join(step, "survivor", "left").select("node", F.coalesce("_next", "survivor").alias("survivor"))

    reach = {1: cut(merges.select("node", F.col("into").alias("survivor")))}
    while 2 * max(reach) <= MAX_MERGES:
        n = max(reach)
        reach[2 * n] = cut(after(reach[n], reach[n]))
    out, hops = reach[max(reach)], max(reach)
    for n in sorted(reach, reverse=True):
        if hops + n <= MAX_MERGES:
            out, hops = after(reach[n], out), hops + n
    return out


def merged(edges: DataFrame, evidence: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, relationship, confidence) and evidence (a, b, relationship, chunk_id, ...) after merges (node, survivor).

    Ends move, self-loops go with their evidence, duplicates are folded: the greatest confidence, all evidence, chunks counted anew."""
    to = lambda c: merges.select(F.col("node").alias(c), F.col("survivor").alias(f"_{c}"))
    move = lambda df: df.join(to("a"), "a", "left").join(to("b"), "b", "left").withColumns({"a": F.coalesce("_a", "a"), "b": F.coalesce("_b", "b")}).drop("_a", "_b").where("a <> b")
    key = ["a", "b", "relationship"]
    proof = move(evidence).select(evidence.columns)
    best = move(edges).groupBy(*key).agg(F.max("confidence").alias("confidence"))
    counts = proof.groupBy(*key).agg(F.count_distinct("chunk_id").alias("evidence_count"))
    return best.join(counts, key, "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0))), proof


def merged_nodes(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """nodes (node, display_name, aliases, status) after merges (node, survivor): survivors take aliases and names of the merged, which become tombstones (merged_into)."""
    gone = nodes.join(merges, "node")
    names = gone.select(F.col("survivor").alias("node"), F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("display_name"))).alias("_alias")).groupBy("node").agg(F.collect_set("_alias").alias("_more"))
    j = nodes.join(names, "node", "left").join(merges.select("node", F.col("survivor").alias("merged_into")), "node", "left")
    aliases = F.when(F.col("_more").isNull() | F.col("merged_into").isNotNull(), F.col("aliases")).otherwise(F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), "_more"))))
    return j.select("node", "display_name", aliases.alias("aliases"), F.when(F.col("merged_into").isNotNull(), "merged").otherwise(F.col("status")).alias("status"), "merged_into")
