"""Shards along the Hilbert curve against a plain version: levels, curve, order, cuts, and what pruning is worth."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from docloom.llm import op11_sharding
from docloom.llm.common import table


def plain_levels(values, bits):
    """The first value of each level by counting all rows below it; nulls are below all."""
    n, firsts = len(values), {}
    order = sorted((v is not None, v) if v is not None else (False,) for v in values)
    for v in sorted({v for v in values if v is not None}):
        below = sum(1 for o in order if o < (True, v))
        firsts.setdefault(below * 2**bits // n, v)
    firsts.pop(0, None)
    return sorted(firsts.values())


def plain_curve(x, bits):
    """The index of a cell by the recursive definition in Gray codes: entry point and direction of each sub-cube."""
    d = len(x)
    entry = direction = h = 0
    rot = lambda v, k: ((v >> k) | (v << (d - k))) & (2**d - 1) if k else v
    left = lambda v, k: rot(v, (d - k) % d)
    for b in range(bits - 1, -1, -1):
        cell = sum((x[i] >> b & 1) << i for i in range(d))
        t = rot(cell ^ entry, (direction + 1) % d)
        w, g = t, t
        while g:
            g >>= 1
            w ^= g
        h = h << d | w
        start = 0 if w == 0 else ((2 * ((w - 1) // 2)) ^ (2 * ((w - 1) // 2)) >> 1)
        entry ^= left(start, (direction + 1) % d)
        ones = lambda v: 0 if v & 1 == 0 else 1 + ones(v >> 1)
        direction = (direction + (0 if w == 0 else ones(w - 1) if w % 2 == 0 else ones(w)) % d + 1) % d
    return h


@pytest.mark.parametrize(("d", "bits"), [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, d, bits) -> None:
    side = 2**bits
    cells = spark.range(side**d).select(*[(F.floor(F.col("id") / side**i) % side).cast("int").alias(f"x{i}") for i in range(d)])
    got = cells.withColumn("h", op11_sharding.hilbert([F.col(f"x{i}") for i in range(d)], bits)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(side**d))
    assert all(sum(abs(a[i] - b[i]) for i in range(d)) == 1 for a, b in zip(got, got[1:]))
    # the same family of curves as the recursive definition: every aligned block of 2**d steps stays in one sub-cube
    for k in range(0, len(got), 2**d):
        assert len({tuple(v // 2 for v in r[:d]) for r in got[k : k + 2**d]}) == 1
    walk = sorted((plain_curve([c // side**i % side for i in range(d)], bits), c) for c in range(side**d))
    assert len({h for h, _ in walk}) == side**d


def check(rows, docs, law, k=16):
    texts = {}
    for r in docs:
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    for r in rows:
        assert any(len(t) + 1 == r.size and zlib.crc32(t) == r.text_crc32 for t in texts[r.doc_id]) and r.law == law and r.grown_shard is None
    by = [[r for r in rows if r.shard == s] for s in range(k)]
    assert sum(map(len, by)) == len(rows)
    for b in by:
        assert sorted(r.slot for r in b) == list(range(len(b)))
    line = [r for b in by for r in sorted(b, key=lambda r: r.slot)]
    key = [(r.curve, r.text_crc32, r.doc_id) for r in line]
    assert key == sorted(key)
    return by


def test_sharding(spark, sf) -> None:
    docs = table(spark, sf, "documents").collect()
    rows = op11_sharding.op11_sharding(spark, sf).collect()
    by = check(rows, docs, "rows")
    assert max(map(len, by)) - min(map(len, by)) <= 1
    sizes = [len((r.text or "").encode()) + 1 for r in docs]
    firsts = [plain_levels(v, op11_sharding.BITS) for v in ([r.source for r in docs], [r.lang for r in docs], sizes)]
    at = lambda r: tuple(bisect_right(f, v) if v is not None else 0 for f, v in zip(firsts, (r.source, r.lang, r.size), strict=True))
    cells = {}
    for r in rows:
        assert cells.setdefault(r.curve, at(r)) == at(r)
    assert len(set(cells.values())) == len(cells)
    by = check(op11_sharding.shards(table(spark, sf, "documents"), "bytes").collect(), docs, "bytes")
    weight = [sum(r.size for r in b) for b in by]
    assert max(weight) - sum(weight) / 16 <= max(sizes)
    # runs of the curve are narrower in all dimensions together than runs of one dimension
    m = op11_sharding.manifest(op11_sharding.shards(table(spark, sf, "documents")))
    asked = [{"source": ("src7", "src7"), "lang": ("en", "en"), "size": (2000, 2500)}, {"lang": ("fr", "fr"), "size": (1, 200)}, {"source": ("src1", "src1"), "size": (10**6, 10**7)}]
    left = [op11_sharding.pruned(m, q).count() for q in asked]
    assert sum(left) < 24 and left[2] == 0


def test_sharding_of_odd_rows(spark, sf, tmp_path) -> None:
    odd = [(1, None, "en", "a"), (2, "", None, "a"), (3, "x" * 300_000, "de", None), (4, "same", "en", "b"), (4, "same", "en", "b"), (5, "é\U0001f600", "en", "b"), (None, "no id", "en", "b")]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("x")).withColumn("part", F.lit(1)).withColumn("size", F.lit("y"))
    for law in ("rows", "bytes"):
        rows = op11_sharding.shards(df, law).collect()
        assert len(rows) == 7 and sorted((r.doc_id or 0, r.size) for r in rows) == [(0, 6), (1, 1), (2, 1), (3, 300_001), (4, 5), (4, 5), (5, 7)]
        assert op11_sharding.shards(df.where("false"), law).count() == 0
    assert op11_sharding.shards(df, "rows", 2).where("shard = 0").count() in (3, 4)
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    assert {r["count"] for r in op11_sharding.shards(hot).groupBy("shard").count().collect()} == {187, 188}
    op11_sharding.write(table(spark, sf, "documents"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == table(spark, sf, "documents").count() and back.select("shard").distinct().count() == 16
    with pytest.raises(ValueError):
        op11_sharding.shards(df, "key")
