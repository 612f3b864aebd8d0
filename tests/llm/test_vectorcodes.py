"""Codes against plain Lloyd rounds in integers, on the given vectors and on odd ones; heaps leave most parts alone."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import op12_vectorcodes as op
from docloom.llm.common import table


def plain(rows, k=16, parts=8, rounds=6):
    """(vec_id, code, error, label_error, sha) of rows (vec_id, embedding, label), by comparing every part with every entry."""
    rows = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    if not rows:
        return []
    w = max(1, -(-max(len(r[1]) for r in rows) // parts))
    x = [[max(-(2**24), min(2**24, math.floor(4096 * v))) for v in r[1]] + [0] * (w * parts - len(r[1])) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(rows[i][1])))[:k]
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(x[i], p) for i in order] for p in range(parts)]
    gap = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    near = lambda v, p: min((gap(cut(v, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[near(v, p)[1] for p in range(parts)] for v in x]
        books = [[[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [cut(v, p) for v, a in zip(x, at, strict=True) if a[p] == j]) else e for j, e in enumerate(books[p])] for p in range(parts)]
    last = [[near(v, p) for p in range(parts)] for v in x]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    err = [sum(g for g, _ in one) for one in last]
    by = {}
    for r, e in zip(rows, err, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0] is None, r[0] or 0), "".join(f"{j:02x}" for _, j in one), e, by[r[2]], sha) for r, one, e in zip(rows, last, err, strict=True))


def got(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_codes(spark, sf) -> None:
    rows = [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding", "label").limit(150).collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    assert got(op.compressed(df)) == plain(rows)


def test_heaps_pop_what_moved_only(spark, sf) -> None:
    v = table(spark, sf, "embeddings")
    c, blocks, heaps = op.fit(v, rounds=9)
    n = 8 * v.count()
    assert c.scanned[0] == n and c.scanned[-1] < 0.7 * n
    codes = op.encode(blocks, heaps, c)
    far = op.decode(codes, c).join(v.select("vec_id", "embedding"), "vec_id").select(F.aggregate(F.zip_with("vector", "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, q: s + q).alias("d"), "error").collect()
    assert all(abs(r.d * op.SCALE**2 - r.error) <= 64 * (2 * math.sqrt(r.error) + 64) for r in far)


def test_scan_of_heaps_equals_full_scan() -> None:
    """Random drifts: after each move of the entries, the heaps give what a full scan gives, ties included."""
    rng = np.random.default_rng(3)
    x = rng.integers(-6, 7, (300, 2)).astype(np.int64)
    book = rng.integers(-6, 7, (5, 2)).astype(np.int64)
    c, h = op.Codebooks(book[None], np.zeros((1, 5))), op.Heaps(5)
    h.step(x, book, c.drift[0], True)
    for k in range(12):
        c.moved(c.books + rng.integers(-1, 2, c.books.shape) * (rng.random(c.books.shape) < 0.3))
        h = op.Heaps.load(h.dump(), 5, len(x))
        h.step(x, c.books[0], c.drift[0])
        assert (h.entries(len(x)) == op.distances(x, c.books[0]).argmin(1)).all(), k


def test_odd_vectors(spark) -> None:
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.1, -0.2], "a"), (1, [0.1, -0.2], None), (1, [5e30, -1.0, 0.3], None), (None, [0.5], "b"), (7, [], "b"), (8, None, "a"), (9, [nan], "a"), (10, [inf], None), (11, [None, 1.0], "a"), (12, [1.0] * 9, "long label"), (12, [1.0] * 9, "long label")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("block", F.lit("x")).withColumn("code", F.lit(1))
    assert got(op.compressed(df)) == plain(rows)
    assert op.compressed(df.where("false")).count() == 0
    ties = [(k, [float(k % 3)] * 8, 1) for k in range(60)]
    assert got(op.compressed(spark.createDataFrame(ties, "vec_id long, embedding array<float>, label long"))) == plain(ties)
    hot = [(k, [0.25] * 16 if k % 3 else [k / 100] * 16, None) for k in range(90)]
    assert got(op.compressed(spark.createDataFrame(hot, "vec_id int, embedding array<float>, label int"))) == plain(hot)
