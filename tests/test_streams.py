"""The limiter as a batch and as a stream, state that goes away, and a chain of jobs whose messages come twice."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.versions import Conflict
from docloom.streaming import chain, limiter


def at(seconds: float) -> datetime.datetime:
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=seconds)


def plain(hits, seconds, most):
    out, state = [], {}
    for key, ts in sorted(hits):
        start, n = state.get(key, (None, 0))
        if start is None or (ts - start).total_seconds() >= seconds:
            start, n = ts, 0
        state[key] = (start, n + 1)
        out.append((key, ts, n + 1, n + 1 <= most))
    return sorted(out)


def test_batch_equals_a_walk(spark) -> None:
    rng = random.Random(1)
    hits = [(rng.choice("ab"), at(rng.choice([0, 1, 5, 9.5, 10, 10.000001, 20, 33]) + 60 * rng.randint(0, 3))) for _ in range(120)] + [("hot", at(k / 7)) for k in range(900)]
    df = spark.createDataFrame(hits, "key string, ts timestamp").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # a key goes on over batches
    try:
        got = sorted((r.key, r.ts, r.hits, r.allowed) for r in limiter.limited(df, 10, 2).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(hits, 10, 2)
    assert limiter.limited(df.where("false"), 10, 2).count() == 0


def test_stream_lets_go_of_quiet_keys(spark, tmp_path) -> None:
    days = [[("a", at(0)), ("a", at(5)), ("b", at(6))], [("b", at(40)), ("c", at(7200))], [("c", at(7300)), ("a", at(90000))], [("c", at(200000))]]
    for k, rows in enumerate(days):
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get(limiter.PROVIDER[0])
    spark.conf.set(*limiter.PROVIDER)
    try:
        stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        limiter.limited_stream(stream, 60, 1, "10 seconds").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet", outputMode="append").awaitTermination()
        left = spark.read.format("statestore").option("stateVarName", "window").load(str(tmp_path / "c")).select("key.key").collect()
    finally:
        spark.conf.set(limiter.PROVIDER[0], before)
    got = sorted((r.key, r.ts, r.hits, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == plain([h for rows in days for h in rows], 60, 1)
    assert {r.key for r in left} <= {"c"}  # a and b have been quiet for longer than a window


def test_chain_delivers_at_least_once(spark, tmp_path) -> None:
    source = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 5)], "run_id string, x int")
    seen: list[int] = []

    def twice(rows):
        seen.append(rows.count())
        return rows.withColumn("x", F.col("x") * 2)

    jobs = [chain.Job("double", twice), chain.Job("sum", lambda rows: rows.groupBy("run_id").agg(F.sum("x").alias("x")))]
    c = chain.Chain(spark, str(tmp_path / "c"), source, jobs)
    c.submit(source.select("run_id").distinct())
    want = [("r1", 6), ("r2", 10)]
    assert sorted(map(tuple, c.run().collect())) == want
    c.submit(source.select("run_id").where("run_id = 'r1'"))  # the same message again
    assert sorted(map(tuple, c.run().collect())) == want
    assert sorted(map(tuple, c.run(replay=True).collect())) == want and len(seen) == 3
    assert c.store.read("double").count() == 3


def test_chain_tries_again_after_a_collision(spark, tmp_path) -> None:
    source = spark.createDataFrame([("r1", 1)], "run_id string, x int")
    c = chain.Chain(spark, str(tmp_path / "c"), source, [])
    done = []

    def work(rows):
        if not done:  # another worker finishes the same run meanwhile
            done.append(1)
            c.store.begin().replace_each("only", rows.withColumn("x", F.lit(9)), "run_id").commit()
        return rows

    c.jobs = [chain.Job("only", work)]
    c._once(0, source.select("run_id"))
    assert c.store.read("only").first().x == 1
    done.clear()
    c.jobs = [chain.Job("only", work, attempts=1)]
    with pytest.raises(Conflict):
        c._once(0, source.select("run_id"))
