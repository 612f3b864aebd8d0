"""Queries for the graph: upserts, traversal, merging, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, traversal
from ..operators import relational as rel
from .catalogue import query, table
from .store_queries import kept

_G = """e0 AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.star_graph(lambda n: table(spark, sf_dir, n))[1]


def _adjacency(spark: SparkSession, sf_dir: str) -> traversal.Adjacency:
    """The bucketed edges, on shared storage."""
    return traversal.Adjacency(spark, kept(spark, sf_dir, ("customer", "supplier", "nation"), "adjacency", lambda path: traversal.Adjacency.build(_edges(spark, sf_dir), path)))


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "seed string")


@query(f"""WITH RECURSIVE {_G}, r(node, depth) AS (SELECT 's1', 0 UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 4) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def khop_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRT-2, GRT-8, AGG-5: nodes within four hops, each at its least depth."""
    return _adjacency(spark, sf_dir).within(["s1"], 4).select("node", "depth")


@query(f"""WITH RECURSIVE {_G}, r(seed, node, depth) AS (SELECT 's' || s_suppkey, 's' || s_suppkey, 0 FROM supplier UNION SELECT r.seed, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 2),
m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT seed, CAST(depth AS INTEGER) AS depth, count(*) AS nodes, min(node) AS first_node, max(node) AS last_node FROM m GROUP BY 1, 2""")
def khop_all_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRT-2, GRT-10, AGG-5: how many nodes each supplier reaches in one hop and in two; suppliers with the same neighbours walk once, as bits."""
    return _adjacency(spark, sf_dir).levels(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("seed")), 2)


@query(f"""WITH RECURSIVE {_G}, r(node, depth) AS (SELECT 's1', 0 UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 6) SELECT CAST(min(depth) AS INTEGER) AS hops FROM r WHERE node = 'c3' HAVING min(depth) IS NOT NULL""")
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRT-3: the length of a shortest path."""
    path = _adjacency(spark, sf_dir).path("s1", "c3")
    return spark.createDataFrame([] if path is None else [(len(path) - 1,)], "hops int")


@query(f"""WITH RECURSIVE {_G}, r(node, depth) AS (SELECT 'n3', 0 UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 2) SELECT DISTINCT a, b FROM e0 WHERE a IN (SELECT node FROM r) AND b IN (SELECT node FROM r)""")
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRT-4: edges between nodes within two hops."""
    e = _edges(spark, sf_dir)
    return graph.subgraph(e, graph.within(e, _seeds(spark, "n3"), 2)).distinct()


@query(f"""WITH RECURSIVE {_G}, r(seed, node, depth) AS (SELECT 's1', 's1', 0 UNION SELECT 'c7', 'c7', 0 UNION SELECT r.seed, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS hops, arg_min(seed, (depth, seed)) AS seed FROM r GROUP BY node""")
def multi_seed_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRT-9, GRT-10, WIN-6: the fewest hops over several seeds."""
    return _adjacency(spark, sf_dir).nearest(_seeds(spark, "s1", "c7"), 3)


@query("""SELECT 's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id, 'supplies' AS relationship, max(1 - l_discount) AS confidence, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS evidence_count FROM lineitem GROUP BY 1, 2""")
def edge_upsert_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS-1..4: two batches, the second one twice; the state is that of one run over all."""
    l = table(spark, sf_dir, "lineitem")
    f = l.select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.lit("supplies").alias("relationship"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_orderkey").alias("chunk_id"), "l_linenumber")
    key = ["source_id", "target_id", "relationship"]
    none = f.where("false")
    edges, evidence = none.select(*key, "confidence"), none.select(*key, F.lit("").alias("entity_id"), "chunk_id")
    for batch in (f.where("l_linenumber <= 3"), f.where("l_linenumber > 3"), f.where("l_linenumber > 3")):
        edges, evidence = graph.upserted(edges, evidence, batch.drop("l_linenumber"))
    return edges


@query("""WITH m AS (SELECT CASE WHEN l_suppkey IN (2, 3) THEN 1 ELSE l_suppkey END AS s, l_partkey AS p, 1 - l_discount AS c, l_orderkey AS ch FROM lineitem)
SELECT 's' || s AS a, 'p' || p AS b, 'supplies' AS relationship, max(c) AS confidence, count(DISTINCT ch) AS n_chunks, count(*) AS n_evidence FROM m GROUP BY 1, 2""")
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRT-6, GRT-7: two nodes merged into a third, by a chain; their edges and evidence move."""
    l = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), F.lit("supplies").alias("relationship"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_orderkey").alias("chunk_id"))
    e = l.groupBy("a", "b", "relationship").agg(F.max("confidence").alias("confidence"))
    chain = spark.createDataFrame([("s3", "s2"), ("s2", "s1")], "node string, into string")
    edges, proof = graph.merged(e, l.drop("confidence"), graph.survivors(chain))
    key = ["a", "b", "relationship"]
    return edges.join(proof.groupBy(*key).agg(F.count("*").alias("n_evidence")), key).withColumnRenamed("evidence_count", "n_chunks")


@query("""SELECT 's' || s_suppkey AS node, s_name AS display_name, CASE WHEN s_suppkey = 1 THEN (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT 'alias ' || s_suppkey AS x FROM supplier WHERE s_suppkey IN (1, 2, 3) UNION SELECT s_name FROM supplier WHERE s_suppkey IN (2, 3))) ELSE 'alias ' || s_suppkey END AS aliases,
CASE WHEN s_suppkey IN (2, 3) THEN 'merged' ELSE 'active' END AS status, CASE WHEN s_suppkey IN (2, 3) THEN 's1' END AS merged_into FROM supplier""")
def node_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRT-7: the survivor takes aliases and names of the merged, which become tombstones."""
    n = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("display_name"), F.array(F.concat(F.lit("alias "), "s_suppkey")).alias("aliases"), F.lit("active").alias("status"))
    chain = spark.createDataFrame([("s3", "s2"), ("s2", "s1")], "node string, into string")
    return graph.merged_nodes(n, graph.survivors(chain)).withColumn("aliases", F.array_join("aliases", ","))


@query("""SELECT 's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id, max(1 - l_discount) AS confidence, CAST(coalesce(max(l_orderkey * 10 + l_linenumber) FILTER (l_linenumber > 3), max(l_orderkey * 10 + l_linenumber)) AS VARCHAR) AS provenance, count(DISTINCT l_orderkey) AS evidence_count FROM lineitem GROUP BY 1, 2""")
def edge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS-1: the greater confidence, and the provenance of the last finding of the last batch."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    f = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.lit("supplies").alias("relationship"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_orderkey").alias("chunk_id"), k.cast("string").alias("provenance"), k.alias("seq"), "l_linenumber")
    key = ["source_id", "target_id", "relationship"]
    edges, evidence = f.where("false").select(*key, "confidence", "provenance"), f.where("false").select(*key, F.lit("").alias("entity_id"), "chunk_id")
    for batch in (f.where("l_linenumber <= 3"), f.where("l_linenumber > 3")):
        edges, evidence = graph.upserted(edges, evidence, batch)
    return edges.drop("relationship")
