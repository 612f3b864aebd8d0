"""Queries for building the graph, embedding texts, filters of queries, and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, graph_build, relational as rel, services
from .catalogue import query, table
from .graph_queries import _edges, _G, _seeds
from .trust_queries import _CONF, _scored


@query(f"""WITH {_CONF} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (overall < 0.6) AS BIGINT) AS n_low, round(CAST(avg(overall) AS DOUBLE), 6) AS mean FROM s""")
def trust_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: entities of a run, those with low confidence, and the mean."""
    return _scored(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("overall") < 0.6).alias("n_low"), F.round(F.avg("overall"), 6).alias("mean"))


@query("""SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN n_nationkey < 20 THEN 'none' ELSE 'identity' END AS reason FROM nation UNION ALL SELECT 'type' FROM (SELECT DISTINCT l_orderkey FROM lineitem), range(2)) GROUP BY 1""")
def node_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRB-1, JN-5: how many entities become nodes, and why others do not."""
    return graph_build.eligibility_of(_scored(spark, sf_dir)).groupBy(F.coalesce("skipped", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT 'country:' || n_nationkey AS canonical_id, CASE WHEN n_nationkey % 2 = 0 THEN 'old' ELSE ' ' || n_name END AS display_name, CASE WHEN n_nationkey % 2 = 1 THEN ' ' || n_name WHEN n_nationkey % 4 = 0 THEN ' ' || n_name ELSE ' ' || n_name || ',old' END AS aliases, CASE WHEN n_nationkey % 2 = 1 THEN 'new' WHEN n_nationkey % 4 = 0 THEN 'same' ELSE 'updated' END AS state FROM nation WHERE n_nationkey < 20""")
def node_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRB-2, GRB-4: new nodes, and those whose aliases grow."""
    e = graph_build.eligibility_of(_scored(spark, sf_dir))
    k = F.col("n_nationkey")
    old = table(spark, sf_dir, "nation").where(k % 2 == 0).select(F.concat(F.lit("country:"), k).alias("canonical_id"), F.lit("old").alias("display_name"), F.lit("country").alias("node_type"), F.array(F.when(k % 4 == 0, F.concat(F.lit(" "), "n_name")).otherwise("old")).alias("aliases"))
    return graph_build.node_plans(e, old).select("canonical_id", "display_name", F.array_join("aliases", ",").alias("aliases"), "state")


@query("""WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, 'customer' AS ta, 'nation' AS tb FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplier', 'nation' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation', 'region' FROM nation)
SELECT id, type, CAST(count(*) AS BIGINT) AS n FROM (SELECT a AS id, tb AS type FROM e UNION ALL SELECT b, ta FROM e) GROUP BY 1, 2""")
def neighbour_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, JN-18, JN-4, SET-5: the types of each node's neighbours."""
    return graph_build.neighbour_types(*rel.star_graph(lambda n: table(spark, sf_dir, n)))


@query(f"""WITH RECURSIVE {_G}, n AS (SELECT 'n' || s_nationkey AS b FROM supplier WHERE s_suppkey = 1) SELECT CAST(0 AS INTEGER) AS hop, 's1' AS a, b, 'in' AS relationship, 0.9::DOUBLE AS confidence FROM n UNION ALL SELECT 1, b, (SELECT 'r' || n_regionkey FROM nation WHERE 'n' || n_nationkey = b), 'in', 0.9 FROM n""")
def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRT-5, WIN-5, WIN-10: the most confident edge of each step of a path."""
    e = _edges(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").where("s_suppkey = 1").select("s_nationkey")
    n = table(spark, sf_dir, "nation").join(F.broadcast(s), F.col("n_nationkey") == F.col("s_nationkey"))
    path = n.select(F.posexplode(F.array(F.lit("s1"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).alias("hop", "node"))
    many = e.select("a", "b", F.explode(F.array(F.struct(F.lit("near").alias("r"), F.lit(0.4).alias("c")), F.struct(F.lit("in").alias("r"), F.lit(0.9).alias("c")))).alias("x")).select("a", "b", F.col("x.r").alias("relationship"), F.col("x.c").alias("confidence"))
    return graph_build.best_hops(path, many)


@query("""SELECT entity_id, mention_id, chunk_id FROM (SELECT l_partkey AS entity_id, l_orderkey * 10 + l_linenumber AS mention_id, l_orderkey AS chunk_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber, l_orderkey) AS r FROM lineitem) WHERE r = 1""")
def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-7, JN-6: the first mention of each entity."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_shipdate").alias("created_at"))
    return graph_build.first_mentions(m.distinct()).select("entity_id", "mention_id", "chunk_id")


@query("""SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1""")
def last_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-3: the provenance of the last finding."""
    f = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("kind")).alias("provenance"))
    return graph_build.provenance(f, ["user_id"]).select("user_id", "provenance.seq", "provenance.kind")


@query("""WITH nodes AS (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey <> 3)
SELECT 'chunk' AS source_type, CAST(doc_id AS VARCHAR) AS source_id, sha256(text) AS content_hash FROM documents WHERE length(trim(text)) > 0
UNION ALL SELECT 'node', id, sha256(name || ' nation ' || lower(name)) FROM nodes
UNION ALL SELECT 'edge', 's' || s_suppkey, sha256('SUPPLIER ' || s_suppkey || ' in ' || name) FROM supplier JOIN nodes ON id = 'n' || s_nationkey
UNION ALL SELECT 'node', 's' || s_suppkey, sha256('SUPPLIER ' || s_suppkey || ' supplier') FROM supplier
UNION ALL SELECT 'canonical_entity', 'r' || r_regionkey, sha256(r_name || ' ' || lower(r_name)) FROM region
UNION ALL SELECT 'ontology', r_name, sha256(r_name || ': a region') FROM region""")
def embeddable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1, EMB-3, JN-14, JN-15, FIL-13: texts of chunks, nodes, edges, registry entries and terms."""
    t = lambda n: table(spark, sf_dir, n)
    id_ = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = t("nation").select(id_("n", "n_nationkey").alias("node_id"), F.col("n_name").alias("display_name"), F.lit("nation").alias("node_type"), F.array(F.lower("n_name")).alias("aliases"), F.when(F.col("n_nationkey") == 3, F.lit("2026-01-01")).alias("deleted_at"))
    suppliers = t("supplier").select(id_("s", "s_suppkey").alias("node_id"), id_("SUPPLIER ", "s_suppkey").alias("display_name"), F.lit("supplier").alias("node_type"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("deleted_at"))
    edges = t("supplier").select(id_("s", "s_suppkey").alias("edge_id"), id_("s", "s_suppkey").alias("a"), F.lit("in").alias("relationship"), id_("n", "s_nationkey").alias("b"))
    entries = t("region").select(id_("r", "r_regionkey").alias("canonical_id"), F.col("r_name").alias("canonical_name"), F.array(F.lower("r_name")).alias("aliases"))
    terms = t("region").select(F.col("r_name").alias("term"), F.lit("a region").alias("description"))
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), "text")
    out = graph_build.embeddable(chunks, nations.unionByName(suppliers), edges, entries, terms)
    return out.select("source_type", "source_id", F.sha2("text", 256).alias("content_hash"))


@query("""SELECT o_orderkey, '{"' || CASE WHEN o_orderkey % 2 = 0 THEN 'company_ids":["c1","c2"],"port_ids":["p1"]' ELSE 'port_ids":["p1"]' END || CASE WHEN o_orderkey % 3 = 0 THEN ',"time_range":["2026-01-01","2026-03-31"]' ELSE '' END || '}' AS filters FROM orders""")
def query_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-1, MAP-2, QRY-4: filters of a query as a map, written as JSON."""
    one = lambda kind, i: F.struct(F.lit(kind).alias("type"), F.lit(i).alias("id"))
    found = F.when(F.col("o_orderkey") % 2 == 0, F.array(one("port", "p1"), one("company", "c2"), one("company", "c1"), one("company", "c2"))).otherwise(F.array(one("port", "p1")))
    span = F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.lit("2026-01-01").cast("date").alias("start"), F.lit("2026-03-31").cast("date").alias("end")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(graph_build.query_filters(found, span)).alias("filters"))


@query("""SELECT doc_id, source, CASE WHEN source = 'src1' THEN upper(lang) ELSE lang END AS lang FROM documents WHERE source IS NOT NULL""")
def run_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4..7, EXT-3, REV-6: rows of one run replaced twice, the others stay; read from the shared folder."""
    path = f"{graph.shared_dir(spark)}/docloom-reload-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "lang", "source")
    services.replace_run(d, path, "source")
    for _ in range(2):
        services.replace_run(d.where("source = 'src1'").withColumn("lang", F.upper("lang")), path, "source")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema("doc_id long, lang string, source string").parquet(path)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'resolved' WHEN o_orderstatus = 'P' THEN 'dismissed' ELSE 'in_review' END AS state, CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderdate END AS reviewed_at FROM orders""")
def reviewed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REV-5: states of review items, and when they were closed."""
    state = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "dismissed").otherwise("in_review")
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), services.closed_at(state, F.col("o_orderdate")).alias("reviewed_at"))


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS total_candidates, CAST(least(count(*), 5) AS BIGINT) AS retrieved FROM events GROUP BY 1""")
def retrieval_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYB-5, TOP-6, WIN-4: candidates of each run before and after the best five are taken."""
    e = table(spark, sf_dir, "events")
    top = rel.top_per_key(e, ["user_id"], [F.desc("value"), F.asc("event_id")], 5).groupBy("user_id").agg(F.count("*").alias("retrieved"))
    return e.groupBy("user_id").agg(F.count("*").alias("total_candidates")).join(top, "user_id")


@query(f"""WITH RECURSIVE {_G}, r(node, depth) AS (SELECT 's2', 0 UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 2) SELECT node AS source_id, CAST(min(depth) AS INTEGER) AS hops, round(1.0::DOUBLE / (1 + min(depth)), 9) AS score FROM r WHERE node <> 's2' GROUP BY node""")
def graph_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYB-3, HYB-4, MTH-7, GRT-9: nodes near a seed as candidates, scored by their hops."""
    near = graph.nearest_seed(graph.within(_edges(spark, sf_dir), _seeds(spark, "s2"), 2))
    return near.where("hops > 0").select(F.col("node").alias("source_id"), "hops", F.round(1.0 / (1 + F.col("hops")), 9).alias("score"))
