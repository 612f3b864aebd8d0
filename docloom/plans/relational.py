"""Queries for scans, filters, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analytics, relational as rel
from .catalogue import query, table


@query("""SELECT event_id, ts, user_id, value, CAST(20 AS BIGINT) AS page_size, (SELECT CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) FROM events WHERE event_type = 'click') AS n_pages
FROM events WHERE event_type = 'click' ORDER BY ts DESC NULLS LAST, event_id LIMIT 20 OFFSET 20""")
def src_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, TOP-3: a filtered page, newest first, with the number of pages."""
    return rel.page(table(spark, sf_dir, "events"), {"event_type": "click"}, order=[F.desc_nulls_last("ts"), F.asc("event_id")], offset=20, size=20).select("event_id", "ts", "user_id", "value", "page_size", "n_pages")


@query("SELECT * FROM orders WHERE o_orderkey = 7 LIMIT 1")
def src_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1: one row by its key."""
    return rel.filtered(table(spark, sf_dir, "orders"), {"o_orderkey": 7}).limit(1)


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS n_click, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users FROM events")
def agg_count_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3, AGG-1: counts under filters."""
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("n_click"), F.countDistinct("user_id").alias("n_users"))


_EDGES = """(SELECT l_suppkey AS src, l_partkey AS dst, max(1 - l_discount) AS confidence, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS evidence FROM lineitem GROUP BY 1, 2)"""


@query(f"SELECT src, dst, confidence FROM {_EDGES} WHERE (src = 3 OR dst = 3) AND confidence >= 0.95")
def fil_either_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-3, FIL-4: edges at a node by either end, at least so sure."""
    e = rel.supply_edges(table(spark, sf_dir, "lineitem"))
    return e.where(((F.col("src") == 3) | (F.col("dst") == 3)) & (F.col("confidence") >= 0.95)).select("src", "dst", "confidence")


@query("""SELECT event_id, user_id, event_type, ts, (SELECT CAST(count(*) AS BIGINT) FROM events WHERE event_type = 'purchase') AS n_unbounded
FROM events WHERE event_type = 'purchase' AND ts BETWEEN (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND (SELECT min(ts) + INTERVAL 10 DAY FROM events)""")
def fil_audit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-5: audit rows between two instants, both included; the count that goes with them ignores the instants."""
    e = table(spark, sf_dir, "events")
    start = e.agg(F.min("ts").alias("t0"))
    return rel.audit_search(e, {"event_type": "purchase"}, "ts", start, "interval 1 day", "interval 10 day").select("event_id", "user_id", "event_type", "ts", "n_unbounded")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def fil_semi_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-6: rows whose id is in a batch."""
    return rel.among(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fil_anti_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-17: rows whose key is not there yet."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@query("""SELECT doc_id, h AS sha256, row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS kept, min(doc_id) OVER (PARTITION BY h) AS first_id FROM (SELECT doc_id, sha256(text) AS h FROM documents)""")
def dedup_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-9, STR-17: the first document of each content stays."""
    return rel.content_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT fp, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT event_id, ts, sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type)) AS fp FROM events)) WHERE r = 1""")
def fingerprint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-10, STR-18, WIN-1: the latest run of each fingerprint."""
    from ..functions.text import fingerprint

    e = table(spark, sf_dir, "events").select("event_id", "ts", fingerprint(F.col("user_id").cast("string"), F.col("event_type")).alias("fp"))
    return rel.latest(e, ["fp"], F.struct("ts", "event_id")).select("fp", "event_id", "ts")


@query("""SELECT o.o_custkey, o.o_orderkey, l.l_linenumber, l.l_partkey FROM (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")
def latest_run_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-1, JN-2: rows of each owner's latest run."""
    o = rel.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"))
    l = table(spark, sf_dir, "lineitem")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("o_custkey", "o_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT e.event_id, e.user_id, e.ts FROM events e JOIN (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) x ON e.user_id = x.user_id AND e.ts = x.m WHERE e.event_type = 'purchase'""")
def group_max_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-3, AGG-4: all rows at their group's maximum, ties included."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rel.at_group_max(e, ["user_id"], "ts").select("event_id", "user_id", "ts")


@query("SELECT a.l_orderkey AS chunk, a.l_linenumber AS s1, b.l_linenumber AS s2, a.l_partkey AS p1, b.l_partkey AS p2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-7: pairs within a chunk, in order."""
    return rel.pairs_within(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("s"), F.col("l_partkey").alias("p")), "chunk", "s")


@query(f"SELECT * FROM {_EDGES}")
def edge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2, AGG-7, UPS-4: the strongest confidence and the number of distinct chunks of each edge."""
    return rel.supply_edges(table(spark, sf_dir, "lineitem"))


@query("SELECT source, list_sort(list(DISTINCT lang)) AS aliases, CAST(count(DISTINCT lang) AS BIGINT) AS n FROM documents GROUP BY source")
def alias_union_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6, SET-4: the sorted union of a group's values."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("aliases"), F.countDistinct("lang").alias("n"))


@query("SELECT md5(string_agg(CAST(n_nationkey AS VARCHAR) || ':' || n_name, ',' ORDER BY n_nationkey)) AS signature FROM nation")
def content_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: a digest of ordered content."""
    return analytics.signature(table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.concat_ws(":", F.col("n_nationkey").cast("string"), "n_name"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, v[CAST(floor(0.50 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(0.95 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p95, round(list_avg(v), 6) AS mean FROM s""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: percentiles by nearest rank."""
    return analytics.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
n AS (SELECT 'c' || c_custkey AS id, 'customer' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region)
SELECT type, id, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM (SELECT n.type, n.id, d.degree, row_number() OVER (PARTITION BY n.type ORDER BY coalesce(d.degree, 0) DESC, n.id) AS r FROM n LEFT JOIN d USING (id)) WHERE r <= 6""")
def degree_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16: the six best connected nodes of each type."""
    nodes, edges = rel.star_graph(lambda n: table(spark, sf_dir, n))
    return analytics.top_degrees(nodes, edges, 6)


@query("""SELECT t.event_type, CAST(count(e.event_id) AS BIGINT) AS n FROM (VALUES ('click'), ('purchase'), ('view'), ('signup'), ('never')) t(event_type) LEFT JOIN events e USING (event_type) GROUP BY 1""")
def type_distribution_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: counts of given types, zero where there are none."""
    return analytics.distribution(table(spark, sf_dir, "events"), "event_type", ["click", "purchase", "view", "signup", "never"])


@query("""WITH b AS (SELECT min(epoch_us(o_orderdate)) AS lo, max(epoch_us(o_orderdate)) AS hi FROM orders),
k AS (SELECT least(12, CAST(ceil((epoch_us(o_orderdate) - lo) * 12.0 / (hi - lo)) AS BIGINT)) AS bucket FROM orders, b)
SELECT i AS bucket, CAST((SELECT count(*) FROM k WHERE k.bucket <= i) AS BIGINT) AS total FROM range(0, 13) t(i)""")
def growth_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: cumulative growth over 12 equal spans."""
    return analytics.growth(table(spark, sf_dir, "orders"), "o_orderdate", 12)


@query("""WITH v AS (SELECT 1 - l_discount AS c FROM lineitem) SELECT b.label, CAST(count(v.c) AS BIGINT) AS n FROM (VALUES ('0.60-0.70', 0.6, 0.7), ('0.70-0.80', 0.7, 0.8), ('0.80-0.90', 0.8, 0.9), ('0.90-1.00', 0.9, 1.01)) b(label, lo, hi) LEFT JOIN v ON v.c >= CAST(b.lo AS DOUBLE) AND v.c < CAST(b.hi AS DOUBLE) GROUP BY 1""")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: four half-open bins from 0.6."""
    return analytics.histogram(table(spark, sf_dir, "lineitem").select((1 - F.col("l_discount")).alias("c")), "c")


@query("""SELECT 'lang' AS facet, lang AS value, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: facet values with their counts."""
    return analytics.facets(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT doc_id, lang, source FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang = 'en' AND contains(lower(text), 'license')")
def fil_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-15, FIL-19: facets and a substring, whatever the case."""
    return analytics.faceted(table(spark, sf_dir, "documents"), {"source": ["src1", "src2", "src3"], "lang": ["en"]}, ["text"], "LICENSE").select("doc_id", "lang", "source")


@query("SELECT part.p_partkey, p_name FROM part WHERE p_name ILIKE '%red%' OR p_type ILIKE '%red%' OR p_name ILIKE '%steel%' OR p_type ILIKE '%steel%'")
def fil_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-14, FIL-16: any token of the query is part of the text."""
    return analytics.keyword_match(table(spark, sf_dir, "part"), ["p_name", "p_type"], "red steel").select("p_partkey", "p_name")


@query("""WITH seen AS (SELECT o_custkey AS c, min(o_orderdate) AS f FROM orders GROUP BY 1), m AS (SELECT max(o_orderdate) AS now FROM orders), kept AS (SELECT c FROM seen, m WHERE f >= now - INTERVAL 2000 DAY)
SELECT a.o_custkey AS a, b.o_custkey AS b FROM orders a JOIN orders b ON a.o_orderkey + 1 = b.o_orderkey WHERE a.o_custkey IN (SELECT c FROM kept) AND b.o_custkey IN (SELECT c FROM kept)""")
def fil_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-17: nodes first seen lately, and the edges both ends of which stay."""
    o = table(spark, sf_dir, "orders")
    seen = o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("first_seen"))
    x, y = o.select((F.col("o_orderkey") + 1).alias("k"), F.col("o_custkey").alias("a")), o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("b"))
    return analytics.timeline(seen, x.join(y, "k").select("a", "b"), o.agg(F.max("o_orderdate").alias("now")), 2000)


@query("""SELECT sum(hits) AS hits, CAST(sum(k) AS BIGINT) AS k, round(avg(hits / k), 6) AS precision_at_k, round(avg(hits / relevant), 6) AS recall_at_k FROM (
  SELECT q.vec_id, CAST(count(*) FILTER (WHERE n.label = q.label) AS DOUBLE) AS hits, CAST(count(*) AS DOUBLE) AS k, any_value(r.relevant) AS relevant
  FROM (SELECT a.vec_id AS q, b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rk FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) t
  JOIN embeddings q ON q.vec_id = t.q JOIN embeddings n ON n.vec_id = t.n JOIN (SELECT label, CAST(count(*) - 1 AS DOUBLE) AS relevant FROM embeddings GROUP BY 1) r ON r.label = q.label WHERE rk <= 10 GROUP BY 1)""")
def recall_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23, AGG-25, EVL-1: mean precision and recall of the ten nearest of every vector, labels as judgements."""
    from ..operators import neighbours, retrieval

    e = table(spark, sf_dir, "embeddings")
    return retrieval.label_metrics(neighbours.neighbours(e, 10), e)


@query("""SELECT doc_id, first_id FROM (SELECT doc_id, first_value(doc_id) OVER w AS first_id, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY lang, source, trim(regexp_replace(lower(text), '[\\s]+', ' ', 'g')) ORDER BY doc_id)) WHERE r > 1""".replace("\\\\", "\\"))
def win_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-9, WIN-2: second and later rows of a key, with the first one's id."""
    from ..functions.text import alias_key

    return rel.repeats(table(spark, sf_dir, "documents").withColumn("k", alias_key(F.col("text"))), ["lang", "source", "k"], "doc_id")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice AS value, base FROM (SELECT *, first_value(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS base FROM lineitem WHERE l_extendedprice IS NOT NULL)
WHERE abs(l_extendedprice - base) / greatest(abs(l_extendedprice), abs(base)) > 0.05""")
def win_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-10, WIN-3: values that differ from the first of their group by more than 5 %."""
    return rel.conflicts(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value")), ["l_orderkey"], ["l_linenumber", "value"], "value")


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS stated, round(s, 2) AS total FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - s) / greatest(abs(o_totalprice), abs(s)) > 0.02""")
def table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-11, MTH-2: stated totals that differ from their parts by more than 2 %."""
    from ..functions.numbers import near

    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    o = table(spark, sf_dir, "orders")
    return o.join(s, o["o_orderkey"] == s["l_orderkey"]).where(~near(F.col("o_totalprice"), F.col("s"), 0.02)).select("o_orderkey", F.round("o_totalprice", 2).alias("stated"), F.round("s", 2).alias("total"))


@query("""SELECT l_suppkey, l_partkey, confidence, r AS rank FROM (SELECT l_suppkey, l_partkey, max(1 - l_discount) AS confidence, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(1 - l_discount) DESC, l_partkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 5""")
def topk_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-5, GRT-1: each node's strongest neighbours."""
    e = rel.supply_edges(table(spark, sf_dir, "lineitem"))
    return rel.top_per_key(e, ["src"], [F.desc("confidence"), F.asc("dst")], 5).select(F.col("src").alias("l_suppkey"), F.col("dst").alias("l_partkey"), "confidence", "rank")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber >= 2)
SELECT 'union' AS op, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'new', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-2, SET-3, SET-6: keyed union, and what is new."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), "l_linenumber")
    a, b = l.where("l_linenumber <= 2").select("s", "p").distinct(), l.where("l_linenumber >= 2").select("s", "p").distinct()
    return a.union(b).distinct().agg(F.count("*").alias("n")).select(F.lit("union").alias("op"), "n").unionByName(b.join(a, ["s", "p"], "left_anti").agg(F.count("*").alias("n")).select(F.lit("new").alias("op"), "n"))


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS taken, CAST(max(before + len) AS BIGINT) AS chars FROM (SELECT conv_id AS doc_id, length(text) AS len, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 400 GROUP BY 1""")
def win_running_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-9: chunks in order until so many characters are taken."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.length("text").alias("len"))
    return rel.running_sample(c, "doc_id", "seq", "len", 400)


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def json_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-1: a value out of JSON."""
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))
