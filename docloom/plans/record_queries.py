"""Queries for rules on every type of entity, changes of rows, builds, registries, prompts, keys and metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alias_key
from ..operators import graph, records, trust
from .catalogue import query, table

@query("""WITH e AS (SELECT l_orderkey AS run, l_linenumber AS n, CAST(trunc(min(l_quantity)) AS INTEGER) AS v, l_orderkey || '.' || l_linenumber AS id FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT id AS entity_id, 'entity.duplicate' AS rule_id FROM (SELECT *, row_number() OVER (PARTITION BY run, v ORDER BY n, id) AS r FROM e) WHERE r > 1
UNION ALL SELECT id, 'entity.conflicting_values' FROM (SELECT *, first_value(v) OVER (PARTITION BY run ORDER BY n, id) AS base FROM e) WHERE abs(v - base) / greatest(abs(v), abs(base)) > 0.05""")
def cross_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-9, VAL-10: repeated entities and conflicting numbers of a run, as findings."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    e = l.select(F.col("l_orderkey").alias("run_id"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("entity_id"), F.col("l_linenumber").alias("seq"), F.lit("quantity").alias("entity_type"), F.lit(1).alias("page_number"), F.concat(F.lit(" "), F.col("l_quantity").cast("int"), F.lit(" Mt")).alias("raw_value"), F.lit(None).cast("string").alias("normalized_value"))
    return trust.cross_findings(e).select("entity_id", "rule_id")


@query("SELECT 'country:' || n_nationkey AS canonical_id, CASE WHEN n_nationkey < 20 THEN n_name END AS canonical_name, CASE WHEN n_nationkey < 20 THEN CASE WHEN lower(n_name) < 'the ' || lower(n_name) THEN lower(n_name) || ',the ' || lower(n_name) ELSE 'the ' || lower(n_name) || ',' || lower(n_name) END END AS aliases FROM nation")
def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-2: the entry of an id; none for ids that are not registered."""
    n = table(spark, sf_dir, "nation")
    keys = F.explode(F.array(F.col("n_name"), F.concat(F.lit("The "), "n_name"))).alias("a")
    registry = n.where("n_nationkey < 20").select(F.concat(F.lit("country:"), "n_nationkey").alias("canonical_id"), F.col("n_name").alias("canonical_name"), keys).withColumn("alias", alias_key(F.col("a")))
    ids = n.select(F.concat(F.lit("country:"), "n_nationkey").alias("canonical_id"))
    return records.entries(ids, registry).withColumn("aliases", F.array_join("aliases", ","))


@query("""WITH n AS (SELECT c_custkey AS k, 'company:' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 5 <> 0) SELECT 'company' AS registry, a AS alias, min(id) AS canonical_id, arg_min(name, id) AS canonical_name FROM (SELECT lower(name) AS a, id, name FROM n UNION ALL SELECT 'client ' || k % 100, id, name FROM n) GROUP BY a""")
def company_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-12: keys of live company nodes, names and aliases alike; the first id has a shared key."""
    k = F.col("c_custkey")
    n = table(spark, sf_dir, "customer").select(F.concat(F.lit("company:"), k).alias("canonical_id"), F.lit("company").alias("node_type"), F.col("c_name").alias("display_name"), F.array(F.concat(F.lit("Client  "), (k % 100).cast("string"))).alias("aliases"), F.when(k % 5 == 0, "merged").otherwise("active").alias("status"))
    return records.company_registry(n)


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderstatus <> 'P' UNION ALL SELECT -o_orderkey, 'N', 0.0 FROM orders WHERE o_orderstatus = 'P'""")
def record_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4, SRC-5, SRC-7: rows updated by key, deleted by key and by a sub-query, and appended in bulk."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    changes = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    rows = records.updated(records.deleted(records.deleted(o, o.where("o_orderstatus = 'P'"), ["o_orderkey"]), gone, ["o_custkey"]), changes, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = f"{graph.shared_dir(spark)}/docloom-rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    records.appended(o.where("o_orderstatus = 'P'").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice")), path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double").parquet(path)


def _cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    vector = F.array(F.length("text").cast("double"), F.lit(1.0))
    store = d.where(k % 7 != 0).select(k.alias("source_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.array(F.lit(0.0), F.lit(0.0)).alias("vector"))
    edited = F.when(k % 20 == 0, F.concat("text", F.lit(" Revised assessment."))).otherwise(F.col("text"))
    return records.of_dimension(records.embedded(d.select((-k).alias("seq"), k.alias("source_id"), edited.alias("text")), store, vector), "vector", 2)


@query("""SELECT doc_id AS source_id, -doc_id AS seq, doc_id % 20 = 0 OR doc_id % 7 = 0 AS fresh, CASE WHEN doc_id % 20 = 0 THEN length(text) + 20 WHEN doc_id % 7 = 0 THEN length(text) ELSE 0 END::DOUBLE AS first FROM documents WHERE text IS NOT NULL""")
def embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB-1, EMB-2: changed items are embedded anew, others keep their vector; all of the right dimension, in input order."""
    return _cycle(spark, sf_dir).where("vector is not null").select("source_id", "seq", "fresh", F.element_at("vector", 1).alias("first")).where("first is not null")


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN text || ' Revised assessment.' ELSE text END AS t FROM documents) SELECT count(*) AS chunks, count(*) FILTER (doc_id % 20 = 0 OR doc_id % 7 = 0) AS embedded, count(*) FILTER (NOT (doc_id % 20 = 0 OR doc_id % 7 = 0)) AS skipped,
CAST(sum(CASE WHEN doc_id % 20 = 0 OR doc_id % 7 = 0 THEN coalesce(len(regexp_extract_all(t, '[^\s]+')), 0) ELSE 0 END) AS BIGINT) AS words FROM d""")
def embedding_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB-4: embedded and skipped items of a cycle, and the words sent."""
    return records.accounting(_cycle(spark, sf_dir))


@query("""SELECT 'prompt' || conv_id % 10 AS name, conv_id // 10 || '.' || turn AS version, sha256(role || chr(10) || '---' || chr(10) || text) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id // 10 DESC, turn DESC) AS r FROM conversations) WHERE r = 1""")
def prompt_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-19, SVC-5: the latest of immutable versions, compared as numbers, and the hash of its words."""
    c = table(spark, sf_dir, "conversations")
    p = c.select(F.concat(F.lit("prompt"), F.col("conv_id") % 10).alias("name"), F.concat_ws(".", F.floor(F.col("conv_id") / 10).cast("long"), "turn").alias("version"), records.prompt_hash(F.col("role"), F.col("text")).alias("hash"))
    return records.latest_prompts(records.registered(p.where("version not like '11.%'"), p.where("version like '11.%'")))


def _blob(pad: int, secret: bytes) -> str:
    return "'" + "".join(f"\\x{b ^ pad:02X}" for b in secret.ljust(64, b"\0")) + "'::BLOB"


@query(f"""SELECT doc_id, sha256({_blob(0x5C, b"s3cret")} || unhex(sha256({_blob(0x36, b"s3cret")} || encode('docs/' || doc_id || ':' || 1767225600 + doc_id)))) AS signature, doc_id >= 100 AS valid FROM documents""")
def signed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-21: signatures of storage keys, and which still hold."""
    key, until = F.concat(F.lit("docs/"), "doc_id"), F.col("doc_id") + 1767225600
    s = records.signed_key(key, until, "s3cret")
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("signature"), records.signature_holds(key, until, s, F.lit(1767225700), "s3cret").alias("valid"))


@query("""SELECT conv_id AS run_id, count(*) AS pages, CAST(max(CASE WHEN turn = 1 THEN 1 + turn % 2 END) AS BIGINT) AS columns FROM conversations GROUP BY 1""")
def layout_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-2: layout of a run's pages, by page number."""
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("page_number"), (F.col("turn") % 2 == 1).alias("is_multi_column"), (1 + F.col("turn") % 2).alias("column_count"))
    return records.layout_summary(p).select("run_id", F.size("layout").cast("long").alias("pages"), F.try_element_at("layout", F.lit("1"))["column_count"].cast("long").alias("columns"))


@query(r"""SELECT conv_id AS doc_id, CASE WHEN conv_id % 2 = 0 THEN 'Talk ' || conv_id END AS title, TIMESTAMP '2026-01-02 03:04:05' AS creation_date, count(*) AS page_count, CAST(sum(len(regexp_extract_all(text, '[^\s]+'))) AS BIGINT) AS word_count FROM conversations GROUP BY 1""")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: title, date, pages and words of documents."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text")
    d = c.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Talk "), "doc_id")).otherwise("").alias("title"), F.lit("").alias("author"), F.lit("D:20260102030405").alias("created"))
    out = records.metadata(d, c, records.language(F.col("text")))
    return out.select("doc_id", "title", F.col("creation_date").cast("timestamp_ntz").alias("creation_date"), "page_count", "word_count")


@query("SELECT doc_id, CASE WHEN length(trim(text)) >= 20 AND max(n) > 0 THEN arg_max(code, n * 10 - i) END AS language FROM (SELECT doc_id, text, code, i, len(list_filter(regexp_extract_all(lower(text), '\\p{L}+'), lambda w: list_contains(string_split(words, ' '), w))) AS n FROM documents, (VALUES ".replace("\\\\", "\\") + ", ".join(f"('{c}', '{records.FREQUENT[c]}', {i})" for i, c in enumerate(sorted(records.FREQUENT))) + ") f(code, words, i)) GROUP BY doc_id, text")
def guessed_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-28: the language of texts of 20 characters or more."""
    return table(spark, sf_dir, "documents").select("doc_id", records.language(F.col("text")).alias("language"))


@query("SELECT e.event_id, t.description, t.parent_type FROM events e LEFT JOIN (VALUES ('click', 'a press', 'action'), ('view', 'a look', 'action')) t(event_type, description, parent_type) USING (event_type)")
def ontology_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRT-11: definitions of types, none for types that are not defined."""
    o = spark.createDataFrame([("click", "a press", "action"), ("view", "a look", "action")], "event_type string, description string, parent_type string")
    return table(spark, sf_dir, "events").join(o, "event_type", "left").select("event_id", "description", "parent_type")


@query()
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13: byte-pair tokens of texts; tested against the encoder of another library."""
    import public_tokenizers

    count = records.token_counts(F.col("text"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return table(spark, sf_dir, "documents").select("doc_id", count.alias("tokens"))


@query()
def block_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19: a hundredth of the rows, at random."""
    return records.sampled(table(spark, sf_dir, "lineitem"), 0.01, 7).select("l_orderkey", "l_linenumber")


@query()
def synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: seeded paragraphs, one for each customer."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return records.synthetic_paragraphs(ids, "coal crude port vessel cargo berth tariff tender market price shipment contract".split(), 60, 42)
