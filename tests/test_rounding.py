"""Rounding of doubles as the SQL of the queries does it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from docloom.functions.numbers import rounded


def test_halves_as_doubles_hold_them(spark) -> None:
    cents = spark.range(15, 3_000_000, 30).select((F.col("id") / 100.0 / 300000.0).alias("x"))  # all ties in decimals
    signed = cents.unionByName(cents.select((-F.col("x")).alias("x"))).unionByName(spark.createDataFrame([(0.0,), (None,), (1e300,), (2.5,)], "x double"))

    def want(x):
        if x is None or abs(x * 1e6) >= 2.0**52:
            return x
        whole = math.floor(abs(x * 1e6))
        return math.copysign(whole + (abs(x * 1e6) - whole >= 0.5), x) / 1e6

    got = signed.select("x", rounded(F.col("x"), 6).alias("r"), F.round("x", 6).alias("s")).collect()
    assert all(r.r == want(r.x) for r in got)
    assert any(r.r != r.s for r in got)  # where round() differs from the SQL


def test_runs_of_the_store_round_like_the_sql(spark, tmp_path) -> None:
    import datetime

    import duckdb

    from docloom.plans import store_queries
    from docloom.plans.catalogue import oracle_sql

    # prices at a tie of the sixth decimal that decides the third
    rows = [(k, ("1-URGENT", "5-LOW", "3-MEDIUM")[k % 3], (n + 0.4995) * 300 + extra, datetime.datetime(2024, 1, 1)) for k, (n, extra) in enumerate((n, e) for n in range(900) for e in (-0.15, 0.0))]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_totalprice double, o_orderdate timestamp_ntz").select("*", F.round(F.col("o_totalprice"), 2).alias("p")).drop("o_totalprice").withColumnRenamed("p", "o_totalprice").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in store_queries.atomic_runs(spark, str(tmp_path)).select("version", "kind", "run", "rows", "total", "last").collect()}
    db = duckdb.connect()
    db.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = set(db.execute(f"select version, kind, run, rows, total, last from ({oracle_sql()['atomic_runs']})").fetchall())
    assert got == want
