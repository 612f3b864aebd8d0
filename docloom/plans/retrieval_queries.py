"""Queries for vectors, full text, query analysis, merging and reranking, chunks, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import alias_key
from ..operators import chunking, graph, retrieval, textindex, vectorindex
from ..operators import relational as rel
from .catalogue import query, table
from .graph_queries import _G
from .store_queries import fresh_path, kept


def _knn_sql(distance: str, where: str = "true") -> str:
    return f"""SELECT vec_id, label, round(d, 6) AS distance, CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank FROM (SELECT a.vec_id, a.label, round({distance}, 9) AS d FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND {where} ORDER BY d, a.vec_id LIMIT 10)"""


def _knn(spark: SparkSession, sf_dir: str, metric: str, label: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = retrieval.nearest(e if label is None else e.where(F.col("label") == label), q, 10, metric)
    return got.join(e.select("vec_id", "label"), "vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"), "rank")


@query(_knn_sql("list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def vec_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-1, ARR-1, TOP-2: nearest by cosine."""
    return _knn(spark, sf_dir, "cosine")


@query(_knn_sql("list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def vec_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-1: nearest by Euclidean distance."""
    return _knn(spark, sf_dir, "l2")


@query(_knn_sql("-list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def vec_ip_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-1: largest inner products."""
    return _knn(spark, sf_dir, "inner_product")


@query(_knn_sql("list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "a.label = 3"))
def vec_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-1: nearest among one source type."""
    return _knn(spark, sf_dir, "cosine", 3)


def _exact_sql(where: str) -> str:
    return f"""SELECT a.vec_id, round(list_sort(list(round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)))[10], 6) AS tenth, true AS found_most FROM embeddings a JOIN embeddings b ON {where} WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id"""


def _ann(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The exact tenth distance of every query, and whether all queries together found 95 % of their ten nearest."""
    e = table(spark, sf_dir, "embeddings")
    index = vectorindex.VectorIndex(spark, kept(spark, sf_dir, ("embeddings",), "vectors", lambda path: vectorindex.VectorIndex.build(e, path)))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    hits = graph.cut(vectorindex.recall(index.nearest_all(asked, 10, where), index.nearest_all(asked, 10, where, exact=True)))
    met = hits.agg((F.sum(F.least("hits", F.lit(10))) >= 0.95 * 10 * F.count(F.lit(1))).alias("found_most"))
    return hits.select(F.col("query").alias("vec_id"), F.round("tenth", 6).alias("tenth")).join(F.broadcast(met))  # one row


@query(_exact_sql("true"))
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-1, TOP-2, AGG-25: recall of the ten nearest by the index against all vectors, for all ids divisible by 100."""
    return _ann(spark, sf_dir)


@query(_exact_sql("b.label = 3"))
def ann_filtered_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-1, FIL-8: the same among the vectors of one label: the filter acts before the ten are taken."""
    return _ann(spark, sf_dir, F.col("label") == 3)


#: Words of the test tables by their stems, and the tokens of texts.
_LICENS = "('license', 'licenses', 'licensed', 'licensing')"
_TOKENS = "t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents))"
_ONE = f"round(0.1::DOUBLE * len(list_filter(w, lambda x: x IN {_LICENS})), 9)"


def text_index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """The stored index of documents, on shared storage."""
    make = lambda path: textindex.TextIndex(spark, path).append(table(spark, sf_dir, "documents"), "doc_id", "text")
    return textindex.TextIndex(spark, kept(spark, sf_dir, ("documents",), "textindex", make))


def _text_search(spark: SparkSession, sf_dir: str, q: str, limit: int | None = None) -> DataFrame:
    return text_index(spark, sf_dir).search(q, limit).withColumnRenamed("key", "doc_id")


@query(f"WITH {_TOKENS} SELECT doc_id FROM t WHERE regexp_matches(s, ' apaches? ') AND regexp_matches(s, ' licens(e|es|ed|ing) ')")
def fts_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-1, FT-2, FT-3: all words, by their stems; stop words do not count."""
    return _text_search(spark, sf_dir, "the Apache licensing").select("doc_id")


@query(f"WITH {_TOKENS} SELECT doc_id FROM t WHERE regexp_matches(s, ' general(ly|s)? public(ly|s)? licens(e|es|ed|ing) ')")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-2: a quoted phrase."""
    return _text_search(spark, sf_dir, '"general public license"').select("doc_id")


@query(f"WITH {_TOKENS} SELECT doc_id FROM t WHERE (regexp_matches(s, ' licens(e|es|ed|ing) ') AND NOT regexp_matches(s, ' mits? ')) OR regexp_matches(s, ' tokens? ')")
def fts_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-2: exclusion and alternatives."""
    return _text_search(spark, sf_dir, "license -mit or token").select("doc_id")


@query(f"WITH {_TOKENS} SELECT doc_id, score FROM (SELECT doc_id, {_ONE} AS score FROM t) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def fts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-4, FT-5, TOP-1: the fifty densest matches of one word, each occurrence a cover."""
    return _text_search(spark, sf_dir, "licenses", 50)


@query()
def fts_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-4: the density of covers of two words; tested against all stretches of small texts."""
    return _text_search(spark, sf_dir, "licensed apache", 50)


@query(f"WITH {_TOKENS}, p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM t) SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(min(k) AS BIGINT) AS first FROM p WHERE x IN {_LICENS} GROUP BY 1")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-1: positions of a lexeme."""
    p = text_index(spark, sf_dir).postings(["licens"]).select(F.explode(F.arrays_zip("keys", "positions")).alias("x"))
    return p.select(F.col("x.keys").alias("doc_id"), F.size("x.positions").cast("long").alias("n"), F.element_at("x.positions", 1).cast("long").alias("first"))


@query(f"""WITH {_TOKENS} SELECT doc_id, score FROM (SELECT doc_id, {_ONE} AS score FROM t WHERE doc_id % 7 <> 3 UNION ALL SELECT doc_id + 10000000, {_ONE} FROM t WHERE doc_id % 7 = 3) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def fts_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-1, FT-3, TOP-1: an index written in two generations; a seventh of the documents is removed and comes back by another id, then all are merged."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = textindex.TextIndex(spark, fresh_path(spark, "textindex"))
    index.append(d.where("doc_id % 2 = 0"), "doc_id", "text").append(d.where("doc_id % 2 = 1"), "doc_id", "text")
    index.remove(d.where("doc_id % 7 = 3"), "doc_id").append(d.where("doc_id % 7 = 3").withColumn("doc_id", F.col("doc_id") + 10_000_000), "doc_id", "text")
    return index.merge().search("licenses", 50).withColumnRenamed("key", "doc_id")


@query(f"WITH {_TOKENS} SELECT doc_id FROM t WHERE NOT regexp_matches(s, ' licens(e|es|ed|ing) ')")
def fts_only_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-2: a query that only excludes, from the index."""
    return _text_search(spark, sf_dir, "-license").select("doc_id")


@query(r"""SELECT conv_id, turn, CASE WHEN contains(q, 'compare') OR contains(q, 'versus') OR contains(q, ' vs ') OR contains(q, ' vs.') THEN 'comparison' WHEN contains(q, 'owns') OR contains(q, 'owned by') OR contains(q, 'operates') OR contains(q, 'relationship') OR contains(q, 'related to') OR contains(q, 'connected to') THEN 'relationship'
WHEN contains(q, 'list ') OR contains(q, 'list all') OR contains(q, 'which ') OR contains(q, 'all of') OR contains(q, 'every ') THEN 'listing' WHEN contains(q, 'what is ') OR contains(q, 'define ') OR contains(q, 'definition of') OR contains(q, 'meaning of') THEN 'definition' WHEN regexp_matches(q, '\S') THEN 'factual' ELSE 'unknown' END AS intent,
CASE WHEN f IN ('who', 'what', 'where', 'when') THEN f WHEN starts_with(p, 'how many') OR starts_with(p, 'how much') THEN 'how_many' WHEN f IN ('is', 'are', 'does', 'do', 'can', 'did', 'was', 'were') THEN 'yes_no' ELSE 'other' END AS question_type
FROM (SELECT conv_id, turn, lower(text) AS q, trim(lower(text)) AS p, rtrim(split_part(trim(lower(text)), ' ', 1), '?') AS f FROM conversations WHERE role = 'user')""")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-2, QRY-3: intent and question type of what users say."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", retrieval.intent(F.col("text")).alias("intent"), retrieval.question_type(F.col("text")).alias("question_type"))


@query()
def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-1, ARR-3: names of nations and parts in queries, longest first."""
    name = F.regexp_replace("n_name", "_", " ")
    n = table(spark, sf_dir, "nation").select(alias_key(name).alias("alias"), F.lit(2).alias("rank"), F.lit("country").alias("entity_type"), F.concat(F.lit("country:"), "n_nationkey").alias("canonical_id"))
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Shipments to "), name, F.lit(" in 2026")).alias("query"))
    return retrieval.query_entities(q, n)


_TYPE = "CASE label % 3 WHEN 0 THEN 'document_chunk' WHEN 1 THEN 'graph_node' ELSE 'canonical_entity' END"
_ID = "CASE label % 3 WHEN 0 THEN '' WHEN 1 THEN 'c' ELSE 'e' END || vec_id"
_RUN = f"""WITH RECURSIVE {_G}, {_TOKENS}, r(node, depth) AS (SELECT 's1', 0 UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 2),
o AS (SELECT 'c' || o_custkey AS node, pow(0.5, greatest(0.0, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2026-01-01')) / 90.0) AS recency FROM orders GROUP BY 1),
c AS (SELECT 'document_chunk' AS t, CAST(doc_id AS VARCHAR) AS id, 'bm25' AS m, NULL::DOUBLE AS vs, s AS bm, NULL::DOUBLE AS gd, NULL::DOUBLE AS rc, NULL::DOUBLE AS re FROM (SELECT doc_id, {_ONE} AS s FROM t) WHERE s > 0 QUALIFY row_number() OVER (ORDER BY s DESC, doc_id) <= 50
UNION ALL SELECT * FROM (SELECT {_TYPE} AS t, {_ID} AS id, 'vector', 1 - d, NULL, NULL, NULL, NULL FROM (SELECT a.vec_id, a.label, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY d, a.vec_id LIMIT 50)) WHERE t <> 'canonical_entity'
UNION ALL SELECT 'graph_node', node, 'graph_expansion', NULL, NULL, min(depth), NULL, any_value(recency) FROM r LEFT JOIN o USING (node) GROUP BY node
UNION ALL SELECT 'graph_edge', a || '>' || b, 'graph_expansion', NULL, NULL, NULL, CASE WHEN a[1] = 'c' THEN 0.8 ELSE 0.9 END, NULL FROM (SELECT DISTINCT a, b FROM e0) WHERE a IN (SELECT node FROM r) AND b IN (SELECT node FROM r)),
g AS (SELECT t, id, CASE WHEN count(DISTINCT m) > 1 THEN 'hybrid' ELSE min(m) END AS method, max(vs) AS vs, max(bm) AS bm, max(gd) AS gd, max(rc) AS rc, max(re) AS re FROM c GROUP BY t, id),
s AS (SELECT t, id, method, (CASE WHEN vs IS NULL THEN 0 ELSE greatest(0.0, least(1.0, vs)) * 0.3::DOUBLE END + coalesce(bm / (1.0 + bm) * 0.2::DOUBLE, 0) + coalesce(0.15::DOUBLE / (1.0 + gd), 0) + coalesce(rc * 0.1::DOUBLE, 0) + coalesce(re * 0.05::DOUBLE, 0))
  / (CASE WHEN vs IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN bm IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN gd IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN rc IS NULL THEN 0 ELSE 0.1::DOUBLE END + CASE WHEN re IS NULL THEN 0 ELSE 0.05::DOUBLE END) AS score FROM g),
ranked AS (SELECT t, id, method, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, t, id) AS rank FROM s)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = retrieval.nearest(e, q, 50).join(e.select("vec_id", "label"), "vec_id")
    kind = F.element_at(F.array(*map(F.lit, ("document_chunk", "graph_node", "canonical_entity"))), F.col("label").cast("int") % 3 + 1)
    prefix = F.element_at(F.array(F.lit(""), F.lit("c"), F.lit("e")), F.col("label").cast("int") % 3 + 1)
    near = near.select(kind.alias("source_type"), F.concat(prefix, "vec_id").alias("source_id"), (1 - F.col("distance")).alias("similarity"))
    hits = _text_search(spark, sf_dir, "licenses", 50).select(F.col("doc_id").cast("string").alias("source_id"), "score")
    links = rel.star_graph(lambda n: table(spark, sf_dir, n))[1]
    reached = graph.within(links, spark.createDataFrame([("s1",)], "seed string"), 2)
    age = F.datediff(F.lit("2026-01-01").cast("date"), F.max("o_orderdate").cast("date"))
    seen = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("node")).agg(F.pow(F.lit(0.5), F.greatest(F.lit(0), age) / 90.0).alias("recency"))
    nodes = graph.nearest_seed(reached).join(seen, "node", "left").select(F.col("node").alias("source_id"), "hops", "recency")
    inside = graph.subgraph(links, reached).select("a", "b").distinct()
    edges = inside.select(F.concat("a", F.lit(">"), "b").alias("source_id"), F.when(F.col("a").startswith("c"), 0.8).otherwise(0.9).alias("confidence"), F.lit(None).cast("double").alias("recency"))
    return retrieval.hybrid("q1", hits, near, nodes, edges, ("document_chunk", "graph_node", "graph_edge"))


@query(_RUN + " SELECT t AS source_type, id AS source_id, method, score AS rerank_score, CAST(rank AS INTEGER) AS final_rank FROM ranked")
def hybrid_merge_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYB-1..3, FIL-8, RRK-1, RRK-2, MTH-6: candidates of full text, vectors and graph, allowed types only, merged and reranked."""
    out = retrieval.reranked(retrieval.merged(_candidates(spark, sf_dir)))
    return out.select("source_type", "source_id", "method", F.round("rerank_score", 6).alias("rerank_score"), "final_rank")


_CITED = """x AS (SELECT 'document_chunk' AS t, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'graph_node', 's' || s_suppkey FROM supplier UNION ALL SELECT 'graph_edge', 's' || s_suppkey || '>n' || s_nationkey FROM supplier
UNION ALL SELECT 'canonical_entity', 'country:' || n_nationkey FROM nation UNION ALL SELECT 'ontology_definition', r_name FROM region UNION ALL SELECT 'ontology_definition', 'unknown')"""


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    chunks = t("documents").select(text("doc_id").alias("chunk_id"), text("doc_id").alias("document_id"), F.col("source").alias("document_title"), F.lit(1).alias("page_number"), "text")
    s = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.concat(F.lit("supplier:"), "s_suppkey").alias("canonical_id"), F.concat(F.lit("n"), "s_nationkey").alias("to"), F.col("s_suppkey").alias("k"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("country:"), "n_nationkey").alias("canonical_id"))
    edges = s.select(F.concat("node_id", F.lit(">"), "to").alias("edge_id"), F.col("node_id").alias("source_node"), F.col("to").alias("target_node"), F.lit("located_in").alias("relationship"), F.lit(0.7).alias("confidence"), "k")
    proof = edges.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).where("k % 2 = 0").select(F.concat(F.lit("v"), "k", F.lit("."), "i").alias("evidence_id"), "edge_id", text("k").alias("document_id"), (F.col("i") + 3).alias("page_number"), none.alias("chunk_id"), F.concat(F.lit("m"), "i").alias("entity_id"))
    onto = t("region").select(F.col("r_name").alias("entity_type"), F.lit("a region").alias("description"))
    r = lambda df, kind, c: df.select(F.lit(kind).alias("source_type"), c.alias("source_id"))
    rows = r(chunks.where("document_title is not null"), "document_chunk", F.col("chunk_id")).unionByName(r(s, "graph_node", F.col("node_id"))).unionByName(r(edges, "graph_edge", F.col("edge_id")))
    rows = rows.unionByName(r(n, "canonical_entity", F.col("canonical_id"))).unionByName(r(onto, "ontology_definition", F.col("entity_type"))).unionByName(r(spark.range(1), "ontology_definition", F.lit("unknown")))
    rows = rows.withColumn("query_id", F.substring("source_id", -1, 1)).withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("source_id", "source_type")))
    return retrieval.cited(rows, chunks, s.select("node_id", "canonical_id").unionByName(n), edges, proof, onto)


@query(f"""WITH {_CITED} SELECT t AS source_type, id AS source_id, CASE t WHEN 'document_chunk' THEN id WHEN 'graph_edge' THEN CASE WHEN k % 2 = 0 THEN '' || k END END AS document_id, d.source AS document_title, CASE WHEN t = 'document_chunk' THEN 1 WHEN t = 'graph_edge' AND k % 2 = 0 THEN 3 END AS page_number,
CASE WHEN t = 'document_chunk' THEN id END AS chunk_id, CASE WHEN t = 'graph_edge' AND k % 2 = 0 THEN 'm0' END AS entity_id, CASE t WHEN 'graph_node' THEN 'supplier:' || substr(id, 2) WHEN 'canonical_entity' THEN id END AS canonical_id,
CASE WHEN length(d.text) > 280 THEN substr(d.text, 1, 280) || '...' ELSE d.text END AS text_snippet, CASE WHEN t = 'graph_edge' THEN 'supplier:' || k || '|located_in|country:' || split_part(id, '>n', 2) END AS graph_path, CASE WHEN t = 'graph_edge' THEN CASE WHEN k % 2 = 0 THEN 'v' || k || '.0|v' || k || '.1' ELSE '' END END AS evidence_ids
FROM (SELECT t, id, CASE WHEN t = 'graph_edge' THEN CAST(split_part(substr(id, 2), '>', 1) AS BIGINT) END AS k FROM x) y LEFT JOIN documents d ON t = 'document_chunk' AND d.doc_id = TRY_CAST(id AS BIGINT)""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIT-1: what a chunk, a node, an edge, a canonical entity and a definition cite."""
    return _cited(spark, sf_dir).drop("final_rank", "query_id", "in_context", "confidence").withColumn("graph_path", F.array_join("graph_path", "|")).withColumn("evidence_ids", F.array_join("evidence_ids", "|"))


@query(f"""WITH {_CITED}, y AS (SELECT t, id, right(id, 1) AS q, row_number() OVER (PARTITION BY right(id, 1) ORDER BY id, t) AS r FROM x)
SELECT q AS query_id, t AS source_type, id AS source_id, CAST(row_number() OVER (PARTITION BY q ORDER BY list_position(['document_chunk', 'graph_node', 'graph_edge', 'canonical_entity', 'ontology_definition'], t), r) AS INTEGER) AS place, count(*) OVER (PARTITION BY q) AS total_items FROM y WHERE id <> 'unknown'""")
def context_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTX-1: citations of each query in the order of the buckets, with totals; unknown definitions are left out."""
    return retrieval.context(_cited(spark, sf_dir))


@query()
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-1..4, STR-12: chunks of 120 words, 20 overlapping."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit(1).alias("page_number"), F.regexp_replace("text", "\n", "\n\n").alias("text"))).alias("pages"))
    return chunking.chunked(d, 120, 20)


@query("""SELECT doc_id, sha256(text) AS whole, true AS in_budget FROM documents WHERE text <> ''""")
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-1..4, STR-13: chunks of 120 tokens, 20 overlapping, of all texts: what is new in each, put together, is the text; none is over its budget."""
    import public_tokenizers

    c = chunking.chunked_by_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, 120, 20)
    new = F.substring("text", F.col("fresh") - F.col("start") + 1, F.col("end") - F.col("fresh"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", new.alias("new"))))  # a text in pieces
    return c.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["new"]), ""), 256).alias("whole"), (F.max("tokens") <= 120).alias("in_budget"))


@query("""SELECT 'chunk' AS source_type, doc_id AS source_id, sha256(CASE WHEN doc_id % 20 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 20 = 0 OR doc_id % 7 = 0""")
def embed_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB-1, EMB-4, JN-16: what is new or has changed."""
    d = table(spark, sf_dir, "documents")
    row = lambda c: [F.lit("chunk").alias("source_type"), F.col("doc_id").alias("source_id"), F.sha2(c, 256).alias("hash")]
    now = d.select(*row(F.when(F.col("doc_id") % 20 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return retrieval.changed(now, d.where("doc_id % 7 <> 0").select(*row(F.col("text"))))
