"""Queries for judgements, explanations, token usage and capped subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, judging, relational
from .catalogue import query, table
from .graph_queries import _G, _adjacency, _edges
from .rule_queries import _LINES, CASES, _pick, scored


@query("""WITH j AS (SELECT o_custkey AS query, l_partkey AS id, arg_max(l_returnflag = 'R', (l_orderkey, l_linenumber, l_returnflag = 'R')) AS relevant FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY price DESC, id) AS rank FROM (SELECT o_custkey AS query, l_partkey AS id, max(l_extendedprice) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)),
t AS (SELECT r.query, count(*) AS returned, count(*) FILTER (relevant) AS hits FROM r JOIN j USING (query, id) WHERE rank <= 5 GROUP BY 1), w AS (SELECT query, count(*) AS wanted FROM j WHERE relevant GROUP BY 1)
SELECT t.query, CASE WHEN wanted IS NOT NULL THEN hits END AS hits, hits / wanted AS recall, CASE WHEN wanted IS NOT NULL THEN hits / returned END AS precision FROM t LEFT JOIN w USING (query)""")
def judged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-1, AGG-23: judgements recorded in two batches, the later ones standing; metrics of the five dearest parts of each customer's orders."""
    of = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("query"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_id"), (F.col("l_returnflag") == "R").alias("relevant"), F.col("l_extendedprice").alias("price"))
    # joined once; of a customer's line items on a part the last of each batch and the dearest are all that is asked
    odd, seq = F.col("l_linenumber") % 2 == 1, F.struct("l_orderkey", "l_linenumber")
    last = lambda batch: F.max(F.when(batch, F.struct(seq.alias("seq"), "relevant")))
    pairs = graph.cut(line.join(of, "l_orderkey").groupBy("query", "source_id").agg(last(odd).alias("first"), last(~odd).alias("second"), F.max("price").alias("price")))
    key = ["query", F.lit("part").alias("source_type"), "source_id"]
    batch = lambda c: pairs.where(F.col(c).isNotNull()).select(*key, f"{c}.relevant", f"{c}.seq")
    judgements = judging.recorded(judging.recorded(batch("first").where("false"), batch("first")), batch("second"))
    ranked = relational.top_per_key(pairs.select(*key, "price"), ["query"], [F.desc("price"), F.asc("source_id")], 5).withColumn("rank", F.lit(1))
    return judging.metrics(ranked, judgements, 5)


@query(f"""WITH {_LINES}, x AS (SELECT entity_id, {_pick([f"'{c[2]}'" if c[2] else "NULL" for c in CASES], "VARCHAR")} AS rule, {_pick([c[3] for c in CASES], "BOOLEAN")} AS passed, {_pick([f"{c[7]}::DOUBLE" for c in CASES], "DOUBLE")} AS normalization FROM lines)
SELECT entity_id, 0.25::DOUBLE AS weight, normalization, CASE WHEN passed = false THEN 0.0 ELSE 1.0 END::DOUBLE AS validation, CASE WHEN rule IS NULL THEN 0 ELSE 1 END AS findings, rule AS first_rule, CAST(passed AS VARCHAR) AS first_passed FROM x""")
def explained_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-2, CNF-9: the explanation of each score as JSON, read back: a weight, two components, the findings."""
    got = F.from_json("explanation", "weights map<string,double>, components map<string,double>, validation_findings array<struct<rule_id:string,severity:string,passed:boolean>>")
    out = judging.explained_of(scored(spark, sf_dir)).select("entity_id", got.alias("x"))
    return out.select("entity_id", F.col("x.weights")["validation"].alias("weight"), F.col("x.components")["normalization"].alias("normalization"), F.col("x.components")["validation"].alias("validation"), F.size("x.validation_findings").alias("findings"), F.get("x.validation_findings", F.lit(0))["rule_id"].alias("first_rule"), F.get("x.validation_findings", F.lit(0))["passed"].cast("string").alias("first_passed"))


@query("""SELECT o_orderpriority AS provider, CAST(sum(coalesce(i, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(o, 0)) AS BIGINT) AS output_tokens, CAST(sum(coalesce(t, coalesce(i, 0) + coalesce(o, 0))) AS BIGINT) AS total_tokens
FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 1000 END AS i, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 100 END AS o, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2000 END AS t FROM orders) GROUP BY 1""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: token usage summed over runs, with parts that are not given."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("provider"), F.when(k % 7 != 0, k % 1000).alias("input_tokens"), F.when(k % 5 != 0, F.col("o_custkey") % 100).alias("output_tokens"), F.when(k % 3 == 0, k % 2000).alias("total_tokens"))
    return judging.usage(runs, ["provider"])


@query(f"""WITH RECURSIVE {_G}, r(node, depth) AS (SELECT 'n3', 0 UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 3), i AS (SELECT DISTINCT a, b FROM e0 WHERE a IN (SELECT node FROM r) AND b IN (SELECT node FROM r)),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY a, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY a, b) AS rb FROM i) SELECT a, b FROM k WHERE rb <= 20 OR (ra <= 20 AND a LIKE 'n%')""")
def subgraph_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRT-4, TOP-5: edges within three hops, of a node's many only the first twenty as either end lists them."""
    e = _edges(spark, sf_dir).distinct()
    reached = _adjacency(spark, sf_dir).within(["n3"], 3)
    capped = graph.subgraph(e, reached, 20)
    nodes = F.col("a").startswith("n")
    # a customer or supplier has one edge, so its own list never cuts it: what is asked is the nations' lists
    ranks = relational.top_per_key(graph.subgraph(e, reached), ["b"], [F.asc("a"), F.asc("b")], 20).select("a", "b")
    return capped.join(ranks.withColumn("_in", F.lit(True)), ["a", "b"], "left").where(F.col("_in").isNotNull() | nodes).select("a", "b")
