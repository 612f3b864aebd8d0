"""The vector index against exact search in numpy: recall, filters, copies, odd vectors, pruned buckets."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import vectorindex


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 20))
    x[:1000] = x[0]  # a third are copies
    rows = [(k, v.tolist(), k % 5) for k, v in enumerate(x)]
    odd = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 20, 1), (9004, [float("nan")] * 20, 1), (9005, [None] * 20, 1), (9006, [1.0] * 7, 1), (None, [1.0] * 20, 1)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("x"))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_and_filters(spark, vectors, tmp_path, metric) -> None:
    x, df = vectors
    df = df.where("vec_id <> 9003 or vec_id is null")  # a zero vector has an l2 distance, but no cosine
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = vectorindex.VectorIndex.build(df, str(tmp_path / metric), metric)
    asked = df.where("vec_id % 50 = 0 or vec_id > 9000").select(F.col("vec_id").alias("query"), "embedding")
    for where, some in ((None, np.arange(3000)), (F.col("label") == 3, np.arange(3, 3000, 5)), (F.col("label") == 99, np.arange(0))):
        got = index.nearest_all(asked, 10, where).collect()
        exact = index.nearest_all(asked, 10, where, exact=True).collect()
        of = {}
        for r in got:
            of.setdefault(r.query, []).append((r.distance, r.vec_id))
        hits = total = 0
        for q in range(0, 3000, 50):
            d = 1 - u[some] @ u[q] if metric == "cosine" else np.sqrt(((x[some] - x[q]) ** 2).sum(1))
            want = sorted(zip(np.round(d, 9).tolist(), some.tolist()))[:10]
            mine = sorted((r.distance, r.vec_id) for r in exact if r.query == q)
            assert np.allclose([a for a, _ in mine], [a for a, _ in want], atol=2e-9) and len(mine) == len(want)
            assert len(of.get(q, [])) == len(want)
            hits += sum(a <= want[-1][0] + 2e-9 for a, _ in of.get(q, []))
            total += len(want)
        assert hits >= 0.95 * total
        assert not {r.vec_id for r in got} - set(some.tolist())


def test_few_vectors_read_few_buckets(spark, vectors, tmp_path) -> None:
    x, df = vectors
    index = vectorindex.VectorIndex.build(df, str(tmp_path / "i"))
    one = index.nearest([x[0].tolist(), x[2500].tolist()], 5, probes=2)
    assert [r.vec_id for r in one.where("query = 0").orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert one.where("query = 1 and rank = 1").first().vec_id == 2500
    counts = [tuple(map(int, c)) for c in re.findall(r"SelectedBucketsCount: ([0-9]+) out of ([0-9]+)", one._jdf.queryExecution().toString())]
    assert counts and all(a < b for a, b in counts)
    rare = index.nearest([x[0].tolist()], 10, F.col("vec_id").isin(2990, 2995, 2999), probes=1).collect()
    assert {r.vec_id for r in rare} == {2990, 2995, 2999}  # more lists are probed until they are found
    with pytest.raises(ValueError):
        index.nearest([[1.0]], 5)
    with pytest.raises(ValueError):
        vectorindex.VectorIndex.build(df.where("false"), str(tmp_path / "none"))
