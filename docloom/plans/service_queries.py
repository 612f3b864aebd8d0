"""Queries for uploads, quotas, permissions, tokens, costs and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission, services
from .catalogue import query, table


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'extension' WHEN doc_id % 4 = 2 THEN 'type' ELSE '' END || CASE WHEN n_chars > 3000 THEN CASE WHEN doc_id % 4 IN (1, 2) THEN ',' ELSE '' END || 'too large' ELSE '' END AS reasons FROM documents""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-11, SVC-1: why uploads are rejected."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("report"), F.when(F.col("doc_id") % 4 == 1, ".exe").otherwise(".pdf"))
    mime = F.when(F.col("doc_id") % 4 == 2, "image/png").otherwise("application/pdf")
    return d.select("doc_id", F.array_join(services.upload_reasons(name, mime, F.col("n_chars"), 3000), ",").alias("reasons"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 HAVING count(*) >= 70")
def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-12: who has reached the quota."""
    return services.over_quota(table(spark, sf_dir, "events"), "user_id", 70)


@query("""SELECT event_id, event_type IN ('click', 'view') OR user_id % 5 = 0 OR (user_id % 3 = 0) AS allowed FROM events""")
def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SVC-3: exact permissions, a resource's star, the star."""
    e = table(spark, sf_dir, "events")
    granted = F.when(F.col("user_id") % 5 == 0, F.array(F.lit("*"))).when(F.col("user_id") % 3 == 0, F.array(F.lit("event:*"))).otherwise(F.array(F.lit("event:click"), F.lit("event:view")))
    return e.select("event_id", services.permitted(granted, F.concat(F.lit("event:"), "event_type")).alias("allowed"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'revoked' WHEN ts <= (SELECT median(ts) FROM (SELECT max(ts) AS ts FROM events)) - INTERVAL 10 DAY THEN 'expired' ELSE 'valid' END AS state, 10 * pow(2.0, event_id % 4) AS delay FROM events""")
def token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SVC-4, MTH-9: states of tokens, and delays of retries."""
    e = table(spark, sf_dir, "events")
    now = e.agg((F.max("ts") - F.expr("interval 10 days")).alias("now"))
    state = services.token_state(F.when(F.col("event_type") == "click", F.col("ts")), F.col("ts"), F.col("now"))
    return e.crossJoin(F.broadcast(now)).select("event_id", state.alias("state"), services.backoff(10.0, 2.0, F.col("event_id") % 4 + 1).alias("delay"))


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN round(n_chars * 3.0::DOUBLE / 1e6 + 100 * 15.0::DOUBLE / 1e6, 9) END AS cost_usd FROM documents""")
def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-8: what tokens cost, null without a price."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("p").alias("provider"), F.col("lang").alias("model"), F.col("n_chars").alias("input_tokens"), F.lit(100).alias("output_tokens"))
    prices = spark.createDataFrame([("p", "en", 3.0, 15.0)], "provider string, model string, input_price double, output_price double")
    return services.cost(d, prices).select("doc_id", F.round("cost_usd", 9).alias("cost_usd"))


@query("""WITH d AS (SELECT doc_id, source AS owner, sha256(coalesce(text, '')) AS hash, strlen(coalesce(text, '')) AS size FROM documents),
s AS (SELECT owner, hash FROM d WHERE doc_id % 10 = 0),
u AS (SELECT doc_id, owner, hash, CASE WHEN doc_id % 11 = 0 THEN 'extension' WHEN doc_id % 13 = 1 THEN 'type' WHEN size = 0 THEN 'empty' END AS wrong, EXISTS (SELECT 1 FROM s WHERE s.owner IS NOT DISTINCT FROM d.owner AND s.hash = d.hash) AS stored FROM d WHERE doc_id % 10 <> 0),
f AS (SELECT *, CASE WHEN wrong IS NULL AND NOT stored THEN row_number() OVER (PARTITION BY owner, hash, wrong IS NULL AND NOT stored ORDER BY doc_id) = 1 ELSE false END AS is_first FROM u),
b AS (SELECT *, coalesce(sum(is_first::INT) OVER (PARTITION BY owner ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, greatest(40 - (SELECT count(*) FROM s WHERE s.owner IS NOT DISTINCT FROM f.owner), 0) AS room FROM f)
SELECT doc_id, owner, coalesce(wrong, CASE WHEN before >= room THEN 'quota' WHEN NOT is_first THEN 'duplicate' END) AS reason, wrong IS NULL AND before < room AND is_first AS accepted FROM b""")
def upload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SVC-1, FIL-9, FIL-11, FIL-12: what a walk over uploads accepts: their own faults, the owner's quota, copies in the store and among themselves."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    named = F.when(F.col("doc_id") % 11 == 0, "notes.exe").otherwise("report.pdf")
    mime = F.when(F.col("doc_id") % 13 == 1, "image/png").otherwise("application/pdf")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("owner"), F.sha2(text, 256).alias("hash"), named.alias("name"), mime.alias("mime"), F.octet_length(text).alias("size"))
    kept = d.where("doc_id % 10 = 0")
    out = admission.admitted(d.where("doc_id % 10 <> 0"), kept, 40, ["doc_id"])
    return out.select("doc_id", "owner", F.substring_index("reason", ", ", 1).alias("reason"), "accepted")
