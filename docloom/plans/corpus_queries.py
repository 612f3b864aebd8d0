"""The graph of a corpus, built over the runs of all customers until one fails by its data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph_build
from .catalogue import query, table

# A run is a customer, a chunk one of its orders; each line item mentions its supplier and its part. Suppliers of a score are merged each into the one before it,
# in chains of up to twelve, of which ten hops are followed. An overall of 1.2, which is none, is made of some rare lines.
_OVERALL = "CASE WHEN l_quantity >= 50 AND l_tax >= 0.08 AND l_discount >= 0.1 THEN 1.2 WHEN l_tax = 0 AND l_discount = 0 THEN NULL ELSE 1 - l_discount END"
_BUILD = f"""m AS (
  SELECT o_custkey AS run, l_orderkey AS chunk, l_linenumber AS seq, 'company' AS kind, l_suppkey AS id, 'Supplier ' || l_suppkey || '/' || l_linenumber % 3 AS value, {_OVERALL} AS overall FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT o_custkey, l_orderkey, l_linenumber, 'commodity', l_partkey, 'Part ' || l_partkey, {_OVERALL} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), failed AS (SELECT min(run) AS f FROM m WHERE overall > 1),
done AS (SELECT m.* FROM m, failed WHERE f IS NULL OR run < f),
good AS (SELECT run, chunk, seq, kind, value, overall, kind || ':' || CASE WHEN kind = 'company' AND id % 20 BETWEEN 1 AND 12 THEN id - least(10, id % 20) ELSE id END AS node FROM done WHERE overall IS NOT NULL AND (kind = 'company' OR id % 50 <> 7)),
aliases AS (SELECT node, value, min(run) AS run, min(struct_pack(run := run, seq := seq, value := value)) AS said, min(kind) AS kind FROM good GROUP BY 1, 2),
nodes AS (SELECT node, min(said).value AS display_name, min(kind) AS node_type, string_agg(value, ',' ORDER BY value) AS aliases, min(run) AS made, count(DISTINCT run) - 1 AS updates FROM aliases GROUP BY 1),
ends AS (SELECT run, chunk, node, kind, max(overall) AS overall FROM good GROUP BY 1, 2, 3, 4),
proofs AS (SELECT a.node AS source, b.node AS target, a.run, a.chunk, round(0.75::DOUBLE * (a.overall + b.overall) / 2, 9) AS confidence FROM ends a JOIN ends b ON a.run = b.run AND a.chunk = b.chunk WHERE a.kind = 'company' AND b.kind = 'commodity'),
edges AS (SELECT source, target, max(confidence) AS confidence, count(DISTINCT chunk) AS evidence_count, min(run) AS made, count(DISTINCT run) - 1 AS updates FROM proofs WHERE confidence >= 0.3 GROUP BY 1, 2)"""


def _build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    customer, orders, line = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    l = line.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").withColumn("overall", F.expr(_OVERALL).cast("double"))
    one = lambda kind, id, value: F.struct(F.lit(kind).alias("node_type"), F.concat(F.lit(f"{kind}:"), id).alias("canonical_id"), value.alias("value"))
    part = F.when(F.col("l_partkey") % 50 != 7, F.col("l_partkey"))  # some parts have no identity
    both = F.array(one("company", F.col("l_suppkey"), F.concat(F.lit("Supplier "), "l_suppkey", F.lit("/"), F.col("l_linenumber") % 3)), one("commodity", part, F.concat(F.lit("Part "), "l_partkey")))
    mentions = l.select(F.col("o_custkey").alias("run_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("seq"), "overall", F.explode(both).alias("x")).select("run_id", "chunk_id", "seq", "overall", "x.*")
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 20 between 1 and 12")
    merges = s.select(F.concat(F.lit("company:"), "s_suppkey").alias("node"), F.concat(F.lit("company:"), F.col("s_suppkey") - 1).alias("into"))
    return graph_build.built(customer.select(F.col("c_custkey").alias("run_id"), F.col("c_custkey").alias("seq")), mentions, merges, ("company", "commodity"), "supplies", 0.75)


@query(f"""WITH {_BUILD} SELECT (SELECT count(*) FROM customer, failed WHERE f IS NULL OR c_custkey < f) AS runs_processed, (SELECT count(*) FROM done WHERE overall IS NULL OR (kind = 'commodity' AND id % 50 = 7)) AS skipped,
(SELECT count(*) FROM nodes) AS nodes_created, (SELECT CAST(coalesce(sum(updates), 0) AS BIGINT) FROM nodes) AS nodes_updated, (SELECT count(*) FROM edges) AS edges_created, (SELECT CAST(coalesce(sum(updates), 0) AS BIGINT) FROM edges) AS edges_updated, (SELECT f FROM failed) AS failed_run""")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRB-5, AGG-12: what a build over all runs has made and changed, and the run at which it stopped."""
    return _build(spark, sf_dir)[2]


@query(f"WITH {_BUILD} SELECT * FROM nodes")
def corpus_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRB-2, GRB-5, GRT-6: nodes of the build, identities followed through merge chains; in which run each was made."""
    return _build(spark, sf_dir)[0].withColumn("aliases", F.array_join("aliases", ",")).withColumn("made", F.col("made.run_id"))


@query(f"WITH {_BUILD} SELECT source, target, 'supplies' AS relationship, confidence, evidence_count, made, updates FROM edges")
def corpus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRB-5, UPS-1..4: edges of the build, with the greatest confidence and their evidence."""
    return _build(spark, sf_dir)[1].withColumn("made", F.col("made.run_id"))
