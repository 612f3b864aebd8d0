"""Entities of texts by the names of parts, suppliers and nations, and what becomes of them: relations of entities that stand close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction
from .catalogue import query, table


def registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of parts by name and by type, of suppliers and of nations."""
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    one = extraction.registry
    out = one(part.select("p_name").distinct(), "commodity", F.col("p_name"), F.col("p_name"))
    out = out.unionByName(one(part.select("p_type").distinct(), "grade", F.col("p_type"), F.col("p_type")))
    out = out.unionByName(one(supplier, "company", F.col("s_suppkey"), F.col("s_name")))
    return out.unionByName(one(nation, "country", F.col("n_nationkey"), F.col("n_name"), F.array(F.regexp_replace("n_name", "_", " "))))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: every document with a sentence on the part, supplier and nation of the line item of its number, before and after it."""
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    first = line.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x")).select("doc_id", "x.*")
    said = first.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    said = said.select("doc_id", F.concat(F.lit("The  "), F.upper("p_name"), F.lit(" of "), F.col("s_name"), F.lit("\n, ")).alias("head"), F.concat(F.lit(" shipped from "), F.regexp_replace("n_name", "_", " "), F.lit(" as "), F.lower("p_type"), F.lit(" goods, not "), F.col("n_name"), F.lit("x or re"), F.col("p_name"), F.lit(".")).alias("tail"))
    return table(spark, sf_dir, "documents").join(said, "doc_id", "left").select("doc_id", F.concat_ws("", "head", "text", "tail").alias("text"))


_TEXTS = r"""first AS (SELECT doc_id, x.p AS p, x.s AS s FROM (SELECT l_orderkey AS doc_id, min(struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey)) AS x FROM lineitem GROUP BY 1)),
said AS (SELECT doc_id, 'The  ' || upper(p_name) || ' of ' || s_name || chr(10) || ', ' AS head, ' shipped from ' || replace(n_name, '_', ' ') || ' as ' || lower(p_type) || ' goods, not ' || n_name || 'x or re' || p_name || '.' AS tail
  FROM first JOIN part ON p = p_partkey JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
texts AS (SELECT doc_id, concat(head, text, tail) AS text FROM documents LEFT JOIN said USING (doc_id)),
names AS (SELECT 'commodity' AS entity_type, p_name AS id, lower(p_name) AS alias FROM part UNION SELECT 'grade', p_type, lower(p_type) FROM part UNION SELECT 'company', CAST(s_suppkey AS VARCHAR), lower(s_name) FROM supplier
  UNION SELECT 'country', CAST(n_nationkey AS VARCHAR), lower(n_name) FROM nation UNION SELECT 'country', CAST(n_nationkey AS VARCHAR), replace(lower(n_name), '_', ' ') FROM nation),
pattern AS (SELECT '\b(?:' || string_agg(alias, '|' ORDER BY length(alias) DESC, alias) || ')\b' AS p FROM (SELECT DISTINCT alias FROM names))"""


@query(f"""WITH {_TEXTS}, hits AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '\\s+', ' ', 'g'), p)) AS alias FROM texts, pattern)
SELECT doc_id, entity_type, id AS canonical_id, count(*) AS mentions FROM hits JOIN names USING (alias) GROUP BY ALL""")
def extracted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-1: names of parts, suppliers and nations in all documents, leftmost and longest, whole words only."""
    found = extraction.entities(reports(spark, sf_dir), "doc_id", "text", registries(spark, sf_dir))
    return found.groupBy("doc_id", "entity_type", "canonical_id").agg(F.count(F.lit(1)).alias("mentions"))


@query(f"""WITH {_TEXTS}, one AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '\\s+', ' ', 'g'), p)) AS alias FROM texts, pattern),
e AS (SELECT DISTINCT doc_id, entity_type, id FROM one JOIN names USING (alias) WHERE entity_type IN ('commodity', 'country'))
SELECT a.id AS commodity, b.id AS country, count(*) AS documents FROM e a JOIN e b USING (doc_id) WHERE a.entity_type = 'commodity' AND b.entity_type = 'country' GROUP BY ALL""")
def extracted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-1, JN-7: commodities and countries that stand in one document, by the number of documents."""
    found = extraction.entities(reports(spark, sf_dir), "doc_id", "text", registries(spark, sf_dir)).select("doc_id", "entity_type", "canonical_id").distinct()
    side = lambda kind, name: found.where(F.col("entity_type") == kind).select("doc_id", F.col("canonical_id").alias(name))
    return side("commodity", "commodity").join(side("country", "country"), "doc_id").groupBy("commodity", "country").agg(F.count(F.lit(1)).alias("documents"))
