"""Queries for scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from .catalogue import query, table

_ENDS = "|".join(s.replace(".", "\\.") for s in sorted(text.SUFFIXES, key=len, reverse=True))


@query(rf"""SELECT p_partkey, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug, 'part:' || CASE WHEN s = '' THEN 'unknown' ELSE s END AS canonical_id
FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(lower(p_name || ' & Co.')), '(?:{_ENDS})$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)""")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-3, STR-4: slugs and canonical ids."""
    p = table(spark, sf_dir, "part").withColumn("n", F.concat("p_name", F.lit(" & Co.")))
    return p.select("p_partkey", text.slug(F.col("n")).alias("slug"), text.canonical_id("part", F.col("n")).alias("canonical_id"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key_md5 FROM documents")
def alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1, STR-2: keys without case and spacing."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.alias_key(F.col("text")).cast("binary")).alias("key_md5"))


@query("SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '...' ELSE text END AS snippet FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16: the first 280 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\b(sk|gsk|pk|api)[-_][A-Za-z0-9]{16,}\b', '[REDACTED_API_KEY]', 'g'), '(?i)Bearer\s+[A-Za-z0-9._-]{16,}', '[REDACTED_BEARER_TOKEN]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g')) AS redacted_md5 FROM documents""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-20: secrets and addresses redacted."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redacted(F.col("text")).cast("binary")).alias("redacted_md5"))


@query(r"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '-?[0-9]+\.?[0-9]*', 0), '') AS DOUBLE) AS value FROM documents""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-1: the first number of a text."""
    return table(spark, sf_dir, "documents").select("doc_id", numbers.number(F.col("text")).alias("value"))


@query("""SELECT event_id, 'iso' AS form, CAST(ts AS DATE) AS day FROM events UNION ALL SELECT event_id, 'slash', CAST(ts AS DATE) FROM events UNION ALL SELECT event_id, 'long', CAST(ts AS DATE) FROM events UNION ALL SELECT event_id, 'month first', CAST(ts AS DATE) FROM events UNION ALL SELECT event_id, 'bad', NULL FROM events""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-1: dates in four spellings, and one that is impossible."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    forms = {"iso": F.date_format("ts", "yyyy-MM-dd"), "slash": F.date_format("ts", "d/M/yyyy"), "long": F.date_format("ts", "d MMMM yyyy"), "month first": F.date_format("ts", "MMM d, yyyy"), "bad": F.date_format("ts", "yyyy-02-30")}
    x = e.select("event_id", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("said")) for k, v in forms.items()))).alias("f"))
    return x.select("event_id", "f.form", numbers.flexible_date(F.col("f.said")).alias("day"))


@query("SELECT event_id, round(pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '2026-01-01') - epoch_us(ts)) / 86400e6) / 90.0), 9) AS recency FROM events")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-4: halved every 90 days."""
    now = F.lit("2026-01-01").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.round(numbers.recency(F.col("ts").cast("timestamp"), now), 9).alias("recency"))


@query(r"""SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '')) AS INTEGER) AS n_paragraphs, sha256(text) AS content_hash FROM documents""")
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11, STR-17: paragraphs, and the hash of the content."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.paragraphs(F.col("text"))).alias("n_paragraphs"), F.sha2("text", 256).alias("content_hash"))


@query(r"""SELECT page_id, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^./]+)$', 1)) AS extension, substr(regexp_replace(url, '[^A-Za-z0-9._ ()\[\]-]', '_', 'g'), 1, 512) AS display FROM pages""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14, STR-15: extensions and names that are safe to show."""
    return table(spark, sf_dir, "pages").select("page_id", text.extension(F.regexp_extract("url", "[^/]*$", 0)).alias("extension"), text.display_name(F.col("url")).alias("display"))
