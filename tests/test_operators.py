"""Operators against the worked examples of the blueprint."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import numbers, text
from docloom.operators import chunking, fulltext, graph, retrieval, trust
from docloom.plans import document_queries
from docloom.streaming import limiter


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values()) or ("x",)], ", ".join(f"{k} string" for k in values) or "x string")
    return df.select(c.alias("r")).first().r


@pytest.mark.parametrize(("said", "day"), [("12/01/2026", "2026-01-12"), ("2026-01-12", "2026-01-12"), ("12 January 2026", "2026-01-12"), ("Sept. 3, 2026", "2026-09-03"), ("2026-02-30", None), ("12 Blorpuary 2026", None), ("", None)])
def test_dates(spark, said, day) -> None:
    got = one(spark, numbers.flexible_date(F.col("v")), v=said)
    assert (got and got.isoformat()) == day


@pytest.mark.parametrize(("said", "n"), [("$82.14 per barrel", 82.14), ("1,250 MT", 1250.0), ("-5.5", -5.5), ("none", None)])
def test_numbers(spark, said, n) -> None:
    assert one(spark, numbers.number(F.col("v")), v=said) == n


@pytest.mark.parametrize(("name", "slug"), [("Adani Ports & SEZ Ltd", "adani_ports_sez"), ("Reliance Industries Pvt Ltd", "reliance_industries"), ("&&&", "unknown")])
def test_slugs(spark, name, slug) -> None:
    assert one(spark, text.slug(F.col("v")), v=name) == slug


def test_mention(spark) -> None:
    at, around = text.mention(F.col("t"), F.col("r"))
    df = spark.createDataFrame([("The price of Brent crude rose to 82.14 today.", "brent"), ("other", "none")], "t string, r string")
    rows = df.select(at.alias("at"), around.alias("around")).collect()
    assert rows[0].at == 13 and "Brent" in rows[0].around and rows[1].at is None and rows[1].around == "none"


def test_shown(spark) -> None:
    assert one(spark, numbers.shown(F.col("v").cast("double")), v="12500000") == "12500000.0"


def test_chunks() -> None:
    assert chunking.chunks_of([(1, "")], 500, 50) == []
    assert len(chunking.chunks_of([(1, "This is a short paragraph.\n\nAnd a second one.")], 500, 50)) == 1
    two = chunking.chunks_of([(1, "Alpha. " * 40 + "\n\n" + "Beta. " * 40)], 60, 5)
    assert len(two) >= 2 and "Beta." not in two[0][1]
    many = chunking.chunks_of([(1, "\n\n".join(f"Paragraph {i}." for i in range(20)))], 30, 15)
    assert many[0][1].split("\n\n")[-1] in many[1][1]
    assert chunking.chunks_of([(1, "a"), (2, "b")], 500, 50)[0][3] == [1, 2]
    assert len(chunking.chunks_of([(1, "word " * 500)], 30, 5)) > 1
    for bad in ((0, 0), (5, 5)):
        with pytest.raises(ValueError):
            chunking.chunks_of([], *bad)


def test_paths(spark) -> None:
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    assert graph.shortest_path(e, "a", "d").first().path == ["a", "b", "c", "d"]
    assert graph.shortest_path(e, "a", "a").first().path == ["a"]
    assert graph.shortest_path(e, "a", "y").count() == 0
    got = graph.within(e, spark.createDataFrame([("a",)], "seed string"), 2)
    assert {r.node: r.depth for r in got.collect()} == {"a": 0, "b": 1, "c": 2}


def test_upsert_is_idempotent(spark) -> None:
    key = "source_id string, target_id string, relationship string, "
    new = spark.createDataFrame([("a", "b", "owns", 0.6, 1), ("a", "b", "owns", 0.9, 2), ("a", "a", "owns", 0.9, 2)], key + "confidence double, chunk_id long")
    edges, evidence = spark.createDataFrame([], key + "confidence double"), spark.createDataFrame([], key + "entity_id string, chunk_id long")
    for _ in range(2):
        edges, evidence = graph.upserted(edges, evidence, new)
        r = edges.collect()
        assert [(x.confidence, x.evidence_count) for x in r] == [(0.9, 2)] and evidence.count() == 4


def test_rerank(spark) -> None:
    cols = ", ".join(f"{s} double" for s in retrieval.WEIGHTS)
    blank = [None] * 7
    rows = [("q", "t", 1, *[1.0, *blank[1:]]), ("q", "t", 2, *[None, 1000.0, *blank[2:]]), ("q", "t", 3, *blank)]
    df = spark.createDataFrame(rows, "query_id string, source_type string, source_id int, " + cols)
    got = {r.source_id: (r.rerank_score, r.final_rank) for r in retrieval.reranked(df).collect()}
    assert got[1] == (1.0, 1) and 0 < got[2][0] < 1 and got[3] == (0.0, 3)


def test_full_text(spark) -> None:
    d = spark.createDataFrame([(1, "Adani Ports SEZ owns and operates Mundra Port terminal."), (2, "Crude oil prices rose."), (3, "Port of Mundra, the port far away from Mundra")], "id int, t string")
    found = lambda q: {r.id: r.score for r in fulltext.search(d, "id", "t", q).collect()}
    assert list(found('"Mundra Port"')) == [1] and list(found("the prices rising or rise")) == []
    assert set(found("operation")) == {1} and set(found("owning -sez")) == set()
    # 1: Ports SEZ ... Mundra, Mundra Port; 3: Port of Mundra, Mundra the port, port far away from Mundra
    assert found("Mundra Port") == {1: pytest.approx(0.1 / 5 + 0.1), 3: pytest.approx(0.1 / 2 + 0.1 / 2 + 0.1 / 4)}
    assert found("  ") == {} and found("of the") == {} and found('"unclosed -- or') == {}


def test_stems() -> None:
    stems = dict(consistency="consist", knocks="knock", hopping="hop", hoping="hope", agreed="agre", happy="happi", by="by", relational="relat", electricity="electr", replacement="replac", controlling="control", communication="communic", kiwis="kiwi", gas="gas", cries="cri", skies="sky", exceeding="exceed", licensed="licens")
    assert {w: fulltext.stem(w) for w in stems} == stems


def test_cover_density_is_that_of_all_shortest_stretches() -> None:
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice(["alpha", "beta", "gamma", "x1", "x2"]) for _ in range(rng.randint(1, 14))]
        text = " ".join(words)
        place = lambda w: [k for k, x in enumerate(words) if x == w]
        covers = {(min(a, b), max(a, b)) for a in place("alpha") for b in place("beta")}
        shortest = [c for c in covers if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in covers)]
        want = sum(0.1 / (b - a) for a, b in shortest)
        got = fulltext.rank(fulltext.lexemes_of(text), fulltext.parse("alpha beta"))
        assert (got is None) == (not covers) and (got or 0.0) == pytest.approx(want)


def test_grounded_middle(spark) -> None:
    rng = random.Random(2)
    rows = [(k, [rng.choice(["ab", "c", "abc", "d"]) for _ in range(rng.randint(4, 9))]) for k in range(30)]
    got = {r.doc_id: (r.x0, r.x1) for r in document_queries.grounded_middle(spark.createDataFrame(rows, "doc_id long, ws array<string>")).collect()}
    for k, ws in rows:
        h = len(ws) // 2
        value = "zzqx" if k % 3 == 0 else f"{ws[h - 1]} {ws[h]}"
        runs = [(n, s) for n in range(1, 13) for s in range(len(ws) - n + 1) if value in " ".join(ws[s : s + n])]
        n, s = min(runs, default=(0, None))
        assert got[k] == ((None, None) if s is None else (10.0 * (s + 1), 10.0 * (s + n) + 8))


def test_rules(spark) -> None:
    e = spark.createDataFrame([("d1", "date", "not a date"), ("c1", "currency", "ZZZ"), ("q1", "quantity", "-500 MT"), ("h1", "hs_code", "27.10.19"), ("x1", "price", "exchange rate: 0/USD"), ("x2", "price", "82")], "entity_id string, entity_type string, raw_value string")
    e = e.selectExpr("1 as run_id", "1L as seq", "*", "cast(null as string) as normalized_value", "cast(null as struct<x0:double,y0:double,x1:double,y1:double>) as bbox", "cast(null as string) as alias_id")
    got = {(r.entity_id, r.passed) for r in trust.entity_findings(e, 2026).collect()}
    assert got == {("d1", False), ("c1", False), ("q1", False), ("h1", True), ("x1", False)}


def test_limiter(spark) -> None:
    t = [datetime.datetime(2026, 1, 1, 0, 0, s) for s in (0, 1, 2, 11, 12)]
    df = spark.createDataFrame([("k", x) for x in t], "key string, ts timestamp")
    assert [(r.hits, r.allowed) for r in limiter.limited(df, 10, 2).orderBy("ts").collect()] == [(1, True), (2, True), (3, False), (1, True), (2, True)]


def test_replace_run(spark, tmp_path) -> None:
    from docloom.operators import services

    path = str(tmp_path / "runs")
    services.replace_run(spark.createDataFrame([(1, 1), (2, 2)], "x int, run_id int"), path)
    for _ in range(2):
        services.replace_run(spark.createDataFrame([(9, 2)], "x int, run_id int"), path)
        assert sorted((r.x, r.run_id) for r in spark.read.parquet(path).collect()) == [(1, 1), (9, 2)]


def test_uploads(spark) -> None:
    from docloom.operators import services

    df = spark.createDataFrame([("a.pdf", "application/pdf", 10), (None, None, None), ("x", "y", 1)], "n string, m string, s long")
    got = [r.r for r in df.select(services.upload_reasons(F.col("n"), F.col("m"), F.col("s")).alias("r")).collect()]
    assert got[0] == [] and "blank name" in got[1] and "empty" in got[1] and got[2] == ["extension"]


def test_percentiles_of_a_hot_key(spark) -> None:
    from docloom.operators import analytics

    rows = [("hot", k * 7919 % 5000 / 2) for k in range(5000)] + [("one", 3.0)] + [("same", 1.0)] * 40 + [(None, 2.0), (None, 4.0), ("gone", None)]
    got = {r.k: (r.p50, r.p95, r.mean) for r in analytics.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(6), "k", "v").collect()}
    rank = lambda v, p: sorted(v)[int(p * (len(v) - 1) + 0.5)]
    for key in ("hot", "one", "same", None):
        v = [x for k, x in rows if k == key]
        assert got[key] == (rank(v, 0.5), rank(v, 0.95), round(sum(v) / len(v), 6)), key
    assert "gone" not in got


def test_nearest_makes_norms_once_a_vector(spark) -> None:
    from docloom.functions.vectors import cosine_distance

    items = spark.createDataFrame([(k, [float(k % 5) - 2, float(k % 3), 1.0]) for k in range(40)] + [(90, [0.0, 0.0, 0.0]), (91, None)], "vec_id long, embedding array<float>")
    queries = items.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as q")
    got = retrieval.nearest(items, queries, 50)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" not in plan.split("Join")[0].upper(), plan
    want = items.crossJoin(queries).select("query_id", "vec_id", F.round(cosine_distance(F.col("embedding"), F.col("q")), 9).alias("d"))
    assert sorted(map(str, got.select("query_id", "vec_id", F.col("distance").alias("d")).collect())) == sorted(map(str, want.collect()))
