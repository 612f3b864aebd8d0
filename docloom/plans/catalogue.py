"""All queries of the reference's own operators, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import cosine_distance

    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).withColumn("distance", cosine_distance(F.col("embedding"), F.col("q"))).orderBy("distance", "vec_id").limit(10).select("vec_id", "label", F.round("distance", 6).alias("distance"))


def _load() -> None:
    import importlib.util

    for name in ("relational", "scalars", "trust_queries", "graph_queries", "retrieval_queries", "service_queries", "document_queries", "build_queries", "record_queries", "store_queries", "extraction_queries", "rule_queries", "corpus_queries", "stream_queries", "judging_queries"):
        if importlib.util.find_spec(f"docloom.plans.{name}"):
            importlib.import_module(f"docloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
