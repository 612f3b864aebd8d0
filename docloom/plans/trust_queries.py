"""Queries for validation, normalisation, confidence and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alias_key
from ..operators import trust
from .catalogue import query, table


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities made of nations (countries), order lines (quantities), orders (prices) and ship dates."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.lit(1).alias("run_id"), F.col("n_nationkey").cast("long").alias("seq"), F.lit("country").alias("entity_type"), F.concat(F.lit(" "), F.upper("n_name")).alias("raw_value"), F.lit(0.9).alias("confidence"), F.lit(1).alias("page_number"))
    l = table(spark, sf_dir, "lineitem")
    q = l.groupBy("l_orderkey").agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min("l_shipdate").alias("t"))
    # both entities of an order come from one pass over its lines
    of = lambda letter, kind, raw, confidence, page: F.struct(F.concat(F.lit(letter), "l_orderkey").alias("entity_id"), F.lit(2).alias("run_id"), F.col("l_orderkey").alias("seq"), F.lit(kind).alias("entity_type"), raw.alias("raw_value"), confidence.alias("confidence"), page.cast("int").alias("page_number"))
    both = F.array(of("q", "quantity", F.concat((F.col("q") - 10).cast("int").cast("string"), F.lit(" MT")), 1 - F.col("d") * 8, F.col("l_orderkey") % 3), of("d", "date", F.date_format("t", "d/M/yyyy"), F.lit(0.8), F.lit(1)))
    e = n.unionByName(q.select(F.inline(both)))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"))
    return e.withColumn("normalized_value", F.lit(None).cast("string")).withColumn("bbox", F.when(F.col("seq") % 2 == 0, box)).withColumn("provider", F.lit("groq"))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return F.broadcast(n.select(F.lit("country").alias("registry"), alias_key(F.col("n_name")).alias("alias"), F.concat(F.lit("country:"), "n_nationkey").alias("canonical_id"), F.col("n_name").alias("canonical_name")))


_E = """q AS (SELECT l_orderkey AS k, min(l_quantity) AS q, min(l_discount) AS d, min(l_shipdate) AS t FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_E} SELECT 'q' || k AS entity_id, 'quantity.impossible' AS rule_id, 'error' AS severity, CAST(q - 10 AS INTEGER) >= 0 AS passed FROM (SELECT k, trunc(q - 10) AS q, d, t FROM (SELECT k, q + 0 AS q, d, t FROM q)) x(k, q, d, t)
UNION ALL SELECT 'd' || k, 'date.impossible', 'error', year(t) BETWEEN 1990 AND 2031 FROM q
UNION ALL SELECT id, 'geometry.impossible_bounding_box', 'error', true FROM (SELECT 'q' || k AS id, k FROM q UNION ALL SELECT 'd' || k, k FROM q UNION ALL SELECT 'n' || n_nationkey, n_nationkey FROM nation) WHERE k % 2 = 0""".replace("CAST(q - 10 AS INTEGER) >= 0", "q >= 0"))
def validation_entity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-1, VAL-3, VAL-8: the rules that apply to each entity, passed or not."""
    e = trust.with_alias(_entities(spark, sf_dir), _aliases(spark, sf_dir), trust.LOOKED_UP)
    return trust.entity_findings(e, 2026).select("entity_id", "rule_id", "severity", "passed")


@query(f"""WITH {_E} SELECT 'n' || n_nationkey AS entity_id, CASE WHEN n_nationkey < 20 THEN 'country:' || n_nationkey END AS canonical_id, CAST(NULL AS VARCHAR) AS normalized_value, CASE WHEN n_nationkey < 20 THEN 'alias_lookup' ELSE 'unresolved' END AS method, CASE WHEN n_nationkey < 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM nation
UNION ALL SELECT 'd' || k, NULL, strftime(t, '%Y-%m-%d'), 'value_parsed', 0.9 FROM q
UNION ALL SELECT 'q' || k, NULL, CAST(CAST(trunc(q - 10) AS INTEGER) AS VARCHAR) || '.0 unit:metric_ton', 'value_parsed', 0.9 FROM q""")
def normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-1, NRM-4, NRM-9, NRM-10: canonical ids and parsed values."""
    e = trust.with_alias(_entities(spark, sf_dir), _aliases(spark, sf_dir), trust.LOOKED_UP)
    return trust.normalised(e, ["27"], {"usd": "currency:USD"}, {"mt": "unit:metric_ton"}).select("entity_id", "canonical_id", "normalized_value", "method", "confidence")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their findings, normal form and confidence."""
    e = trust.judged(trust.with_alias(_entities(spark, sf_dir), _aliases(spark, sf_dir), trust.LOOKED_UP), 2026, ["27"], {"usd": "currency:USD"}, {"mt": "unit:metric_ton"})
    tables = spark.createDataFrame([(2, 1, 0.5), (2, 1, 0.7)], "run_id int, page_number int, confidence double")
    layout = spark.createDataFrame([(2, 1, True), (2, 2, False)], "run_id int, page_number int, is_multi_column boolean")
    return trust.scored(e, tables, layout, few=True)


_CONF = f"""{_E}, x AS (
  SELECT 'n' || n_nationkey AS id, n_nationkey AS k, 0.9 AS c, 1 AS run, 1 AS page, CAST(NULL AS BOOLEAN) AS ok, CASE WHEN n_nationkey < 20 THEN 1.0 ELSE 0.0 END AS norm FROM nation
  UNION ALL SELECT 'q' || k, k, 1 - d * 8, 2, k % 3, trunc(q - 10) >= 0, 0.9 FROM q
  UNION ALL SELECT 'd' || k, k, 0.8, 2, 1, year(t) BETWEEN 1990 AND 2031, 0.9 FROM q),
s AS (SELECT id, ok, norm, k, least(1, greatest(0, c)) * 0.2 + CASE WHEN k % 2 = 0 THEN 0.1 ELSE 0.04 END + 0.05 * CASE WHEN run = 2 AND page = 1 THEN 0.75 WHEN run = 2 AND page = 2 THEN 1.0 ELSE 0.85 END
  + 0.05 * CASE WHEN run = 2 AND page = 1 THEN 0.6 ELSE 1.0 END + 0.25 * CASE WHEN ok IS NULL THEN 1.0 WHEN ok THEN 1.0 WHEN k % 2 = 0 THEN 0.5 ELSE 0.0 END + 0.1 + 0.15 * norm + 0.085 AS overall FROM x)"""


@query(f"WITH {_CONF} SELECT id AS entity_id, round(CAST(overall AS DOUBLE), 6) AS overall FROM s")
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNF-1..9, AGG-8, JN-10: the weighted mean of eight components."""
    return _scored(spark, sf_dir).select("entity_id", F.round("overall", 6).alias("overall"))


@query(f"""WITH {_CONF}, t AS (SELECT id, 'confidence very low' AS r, 3 AS p FROM s WHERE overall < 0.4 UNION ALL SELECT id, 'confidence below threshold', 2 FROM s WHERE overall >= 0.4 AND overall < 0.6
UNION ALL SELECT id, 'validation failed: ' || CASE WHEN id LIKE 'q%' THEN 'quantity.impossible' ELSE 'date.impossible' END, 3 FROM s WHERE NOT ok UNION ALL SELECT id, 'unresolved canonical identity', 1 FROM s WHERE norm = 0.0)
SELECT id AS entity_id, string_agg(r, '; ' ORDER BY r) AS reason, (['low', 'medium', 'high', 'critical'])[max(p)] AS priority FROM t GROUP BY id""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REV-1..4, AGG-13: who needs a look, and why."""
    return trust.review_of(_scored(spark, sf_dir))


@query("""WITH c AS (SELECT l_orderkey AS t, l_linenumber AS r, l_extendedprice AS v FROM lineitem)
SELECT t AS table_id, round(max(p), 4) AS stated, round(max(s), 4) AS total, abs(max(p) - max(s)) / greatest(abs(max(p)), abs(max(s))) <= 0.02 AS passed FROM (SELECT o_orderkey AS t, round(o_totalprice, 4) AS p, (SELECT sum(round(v, 4)) FROM c WHERE c.t = o_orderkey) AS s FROM orders) WHERE s IS NOT NULL GROUP BY 1""")
def totals_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-11: stated totals of tables against the sum of their rows."""
    money = lambda c: F.round(F.col(c), 4).cast("decimal(18,4)").cast("string")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.monotonically_increasing_id().alias("row"), money("l_extendedprice").alias("v"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), F.lit(2**62).alias("row"), money("o_totalprice").alias("v"))
    cells = l.withColumn("name", F.lit("line")).unionByName(o.withColumn("name", F.lit("Total"))).select("table_id", "row", F.posexplode(F.array("name", "v")).alias("column", "raw_value"))
    return trust.totals_findings(cells).select("table_id", F.round("stated", 4).alias("stated"), F.round("total", 4).alias("total"), "passed")
