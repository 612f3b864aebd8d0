"""The stored index against a search of all texts: matches, ranks, best k by block maxima, generations, pruned buckets."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import fulltext, textindex

QUERIES = ["licenses", "licensed apache", '"general public license" or token', "license -mit", "-license", "mit or -apache", '"no such phrase here"', "zzzz", "the", "", "-zzzz", 'software "public license" -apache or port']


def rows(df):
    return sorted((r[0] is None, r[0] or 0, r.score) for r in df.collect())


def plain(docs, q, limit=None):
    out = fulltext.search(docs, "doc_id", "text", q, limit)
    return rows(out)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(900001, None), (900002, ""), (None, "A license."), (900003, "license mit " * 5000), (900004, "license license"), (900004, "license")], "doc_id long, text string"))


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return textindex.TextIndex(spark, str(tmp_path_factory.mktemp("index") / "i")).append(docs.repartition(3), "doc_id", "text")


@pytest.mark.parametrize("q", QUERIES)
def test_same_rows_and_scores(docs, index, q) -> None:
    assert rows(index.search(q, None)) == plain(docs, q)
    for k in (1, 5, 50):
        got, want = [(r.doc_id if "doc_id" in r else r.key, r.score) for r in index.search(q, k).collect()], [(r.doc_id, r.score) for r in fulltext.search(docs, "doc_id", "text", q, k).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_only_some_buckets_are_read(index, docs) -> None:
    said = index.search("licensed apache", None)._jdf.queryExecution().toString()
    assert "SelectedBucketsCount" in said and "documents" not in said
    counts = [tuple(map(int, x.split(" out of "))) for x in __import__("re").findall(r"SelectedBucketsCount: ([0-9]+ out of [0-9]+)", said)]
    assert counts and all(a <= 2 < b for a, b in counts)


def test_block_maxima_leave_blocks_out(spark, tmp_path) -> None:
    """One block holds all the best; the threshold keeps the others from being read."""
    texts = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, F.repeat(F.lit("coal "), 50)).otherwise(F.lit("coal and wood")).alias("text")).coalesce(1)
    index = textindex.TextIndex(spark, str(tmp_path / "i")).append(texts, "doc_id", "text")
    blocks = index._candidates(index.postings(["coal"]), fulltext.parse("coal")).collect()
    assert len(blocks) >= 4000 // textindex.BLOCK and sum(b.bound >= 5 for b in blocks) == 1
    assert [(r.key, r.score) for r in index.search("coal", 20).collect()] == [(k, 5.0) for k in range(20)]


def test_generations(spark, docs, tmp_path) -> None:
    index = textindex.TextIndex(spark, str(tmp_path / "i"))
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 or doc_id is null")
    index.append(even, "doc_id", "text")
    old = textindex.TextIndex(spark, str(tmp_path / "i"))
    index.append(odd, "doc_id", "text")
    assert rows(index.search("license", None)) == plain(docs, "license") and rows(old.search("license", None)) == plain(even, "license")
    index.remove(docs.where("doc_id < 50"), "doc_id")
    left = docs.where("not doc_id < 50 or doc_id is null")
    for q in ("license", "-license", "apache license"):
        assert rows(index.search(q, None)) == plain(left, q)
    index.append(docs.where("doc_id = 7"), "doc_id", "text")
    index.merge()
    assert len(index.scans) == 1 and rows(index.search("-zzzz", None)) == plain(left.unionByName(docs.where("doc_id = 7")), "-zzzz")


def test_rank_takes_time_in_proportion() -> None:
    q = fulltext.parse('"coal coal port" coal')
    took = []
    for n in (20_000, 80_000):
        at = time.perf_counter()
        fulltext.rank([(k, "coal") for k in range(n)] + [(n, "port")], q)
        took.append(time.perf_counter() - at)
    assert took[1] < 12 * max(took[0], 0.01)


def test_rank_against_all_stretches() -> None:
    """The published walk, done by trying every stretch: the nearest end that holds, then the nearest begin."""
    rng = random.Random(4)
    words = ["coal", "port", "ship"]

    def holds(entries, query):
        at = {(p, w) for p, w in entries}
        has = lambda ph: any(all((p + d, w) in at for d, w in ph) for p, _ in entries)
        return any(all(has(p) for p in yes) and not any(has(p) for p in no) for yes, no in query)

    for _ in range(600):
        e = [(p, rng.choice(words)) for p in sorted(rng.sample(range(1, 25), rng.randint(0, 9)))]
        q = fulltext.parse(" ".join(rng.choice(["coal", "port", "ship", '"coal port"', "-ship", '-"port ship"', "or"]) for _ in range(rng.randint(1, 4))))
        named = {w for yes, no in q for p in yes + no for _, w in p}
        own = [x for x in e if x[1] in named]
        want, start = (0.0, 0) if q and holds(own, q) else (None, len(own))
        while start < len(own):
            ends = [j for j in range(start, len(own)) if holds(own[start : j + 1], q)]
            if not ends:
                break
            first = max(i for i in range(start, ends[0] + 1) if holds(own[i : ends[0] + 1], q))
            want += 0.1 / (1 + own[ends[0]][0] - own[first][0] - (ends[0] - first))
            start = first + 1
        got = fulltext.rank(e, q)
        assert (got is None) == (want is None) and (got is None or abs(got - want) < 1e-9), (e, q)


def test_rows_of_a_block_against_dictionaries(spark) -> None:
    import random

    from docloom.operators import fulltext

    rng = random.Random(5)
    docs = [(k, rng.choice([None, "", " ".join(rng.choice(["licenses", "the", "token", "running", "42", "flying"]) for _ in range(rng.randint(0, 30)))])) for k in range(2 * textindex.BLOCK + 9)] + [(None, "token of no key")]
    got = textindex._postings(spark.createDataFrame(docs, "id long, text string").coalesce(1), "id", "text").collect()
    want = {}
    for at, (key, text) in enumerate(docs):
        block, local = divmod(at, textindex.BLOCK)
        places = {}
        for p, w in fulltext.lexemes_of(text):
            places.setdefault(w, []).append(p)
        for w, ps in ({"": []} | places).items():
            want.setdefault((block, w), []).append((local, key, ps))
    assert {(r.block, r.lexeme): list(zip(r.local, r.keys, r.positions)) for r in got} == want
    assert all(r.most == max(len(p) for p in r.positions) for r in got) and len(got) == len(want)
