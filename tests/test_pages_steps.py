"""Pages, steps, ingest and registries on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import numbers, text
from docloom.operators import graph_build, pages, services, steps
from docloom.streaming import ingest

SPAN = "page long, pos long, word string, x0 double, y0 double, x1 double, y1 double"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_grounded(spark) -> None:
    spans = spark.createDataFrame([(1, k, w, k * 10.0, float(k), k * 10.0 + 5, k + 1.0) for k, w in enumerate(["Dated", "Brent", " ", "dated", "brent", "crude"])], SPAN)
    values = spark.createDataFrame([(1, 1, "dated  BRENT"), (2, 1, "brent dated"), (3, 1, ""), (4, 1, None), (5, 2, "x"), (6, 1, "none"), (7, 1, "crude")], "id long, page long, raw_value string")
    got = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in pages.grounded(values, spans, "id").collect()}
    none = (None,) * 4
    assert got == {1: (0.0, 0.0, 15.0, 2.0), 2: (10.0, 1.0, 35.0, 4.0), 3: none, 4: none, 5: none, 6: none, 7: (50.0, 5.0, 55.0, 6.0)}
    assert pages.grounded(values.limit(0), spans, "id").count() == 0


def test_grounded_against_all_windows(spark) -> None:
    import random

    rng = random.Random(3)
    pool = ["a", "b", "ab", "a b", " ", "", None, "B  a", "aa"]
    doc = {p: [rng.choice(pool) for _ in range(rng.randint(1, 30))] for p in range(40)} | {99: ["a"] + [" "] * 11 + ["zz"], 98: ["a"] + [" "] * 10 + ["zz"]}
    ask = [(p * 10 + k, p, v) for p in doc for k, v in enumerate(["a", "a a", "b a", "ab a b", "A  zz", "b b a a", "aa a"])]
    key = lambda w: " ".join((w or "").lower().split())
    want = {}
    for i, p, v in ask:
        runs = [(n, s) for n in range(1, pages.MAX_WINDOW + 1) for s in range(len(doc[p]) - n + 1) if key(v) in " ".join(filter(None, map(key, doc[p][s : s + n])))]
        want[i] = (float(runs[0][1]), float(runs[0][1] + runs[0][0] - 1)) if runs else (None, None)
    spans = spark.createDataFrame([(p, k, w, float(k), 0.0, float(k), 0.0) for p, ws in doc.items() for k, w in enumerate(ws)], SPAN)
    out = pages.grounded(spark.createDataFrame(ask, "id long, page long, raw_value string"), spans, "id")
    assert {r.id: (r.x0, r.x1) for r in out.collect()} == want


def test_grounding_grows_with_words(spark) -> None:
    import time

    def seconds(n: int) -> float:
        text = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("w"), k.cast("string")))
        spans = spark.range(40, numPartitions=1).select(F.col("id").alias("page"), F.posexplode(text).alias("pos", "word")).select("page", "pos", "word", *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
        values = spark.range(40, numPartitions=1).select("id", F.col("id").alias("page"), F.lit("no such").alias("raw_value"))
        at = time.time()
        assert pages.grounded(values, spans, "id").where("x0 is null").count() == 40
        return time.time() - at

    seconds(10)
    assert seconds(20_000) < 12  # all windows of up to twelve words took minutes


def test_recognised_and_text(spark) -> None:
    w = spark.createDataFrame([(1, 2, "b", 80.0), (1, 1, "a", -1.0), (1, 3, " ", 10.0), (1, 4, None, 10.0), (2, 1, "c", -1.0)], "page long, pos long, word string, conf double")
    assert {r.page: (r.text, round(r.confidence, 6)) for r in pages.recognised(w).collect()} == {1: ("a b", 0.8), 2: ("c", 0.0)}
    assert one(spark, pages.page_text(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ""
    assert one(spark, pages.page_text(F.lit("  " + "x" * 19), F.lit("seen"))) == "seen"
    assert one(spark, pages.page_text(F.lit("x" * 20), F.lit("seen"))) == "x" * 20


def test_filled_rows(spark) -> None:
    g = lambda rows: F.lit(None).cast("array<array<string>>") if rows is None else F.array(*(F.array(*(F.lit(c).cast("string") for c in r)) for r in rows))
    assert one(spark, pages.filled_rows(g([["", None], ["a", None]]))) == [["a", None]]
    assert one(spark, pages.filled_rows(g([["", None]]))) is None
    assert one(spark, pages.filled_rows(g(None))) is None


def test_dates_and_spans(spark) -> None:
    assert one(spark, numbers.pdf_date(F.lit("D:20260102"))).isoformat() == "2026-01-02T00:00:00"
    assert one(spark, numbers.pdf_date(F.lit("D:20260230"))) is None
    assert one(spark, numbers.pdf_date(F.lit("2026"))) is None
    at = lambda s: numbers.ago(F.lit(s).cast("timestamp"), F.lit("2026-01-02 00:00:00").cast("timestamp"))
    assert [one(spark, at(s)) for s in ("2026-01-01 23:59:31", "2026-01-01 23:59:30", "2026-01-01 23:00:31", "2026-01-01 00:00:00")] == ["just now", "1m ago", "59m ago", "1d ago"]
    assert one(spark, numbers.signed(F.lit(0.0))) == "0.0" and one(spark, numbers.signed(F.lit(1.25), 2)) == "+1.25"
    assert one(spark, text.candidate_keys(F.lit("$82 (MT)."))) == ["$82 (mt).", "$", "82", "mt"]


def test_best_hops(spark) -> None:
    path = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "hop int, node string")
    edges = spark.createDataFrame([("b", "a", "y", 0.9), ("a", "b", "x", 0.9), ("a", "b", "z", 0.1)], "a string, b string, relationship string, confidence double")
    assert [tuple(r) for r in graph_build.best_hops(path, edges).orderBy("hop").collect()] == [(0, "a", "b", "x", 0.9), (1, "b", "c", None, None)]


def test_steps(spark) -> None:
    calls: list[str] = []

    def flaky(c: dict) -> dict:
        calls.append("x")
        if len(calls) < 3:
            raise ValueError("not yet")
        return {"n": c["n"] + 1}

    def broken(c: dict) -> None:
        raise RuntimeError("broken")

    out = steps.run([steps.Step("flaky", flaky, attempts=3), steps.Step("never", broken, only_if=lambda c: c["n"] > 5), steps.Step("soft", broken, may_fail=True), steps.Step("hard", broken), steps.Step("after", flaky)], {"n": 1})
    assert out.state == "failed" and out.context == {"n": 2} and str(out.error) == "broken"
    assert out.steps == [("flaky", "completed", 3), ("never", "skipped", 0), ("soft", "failed", 1), ("hard", "failed", 1)]
    assert out.frame(spark).count() == 4
    assert steps.run([steps.Step("a", flaky)], {"n": 0}, cancelled=lambda: True).state == "cancelled"
    assert steps.after_failure(1, 2) == ("retrying", 20.0) and steps.after_failure(2, 2) == ("dead_letter", None)
    with pytest.raises(ValueError):
        steps.moved("completed", "running")
    jobs = spark.createDataFrame([(1, "running"), (2, "completed")], "doc long, state string")
    steps.guard_single(jobs, "doc", 2)
    with pytest.raises(RuntimeError):
        steps.guard_single(jobs, "doc", 1)


def test_ingest_twice(spark, tmp_path) -> None:
    inbox, out, seen = tmp_path / "in", str(tmp_path / "out"), []
    inbox.mkdir()
    rows = [{"run_id": 1, "text": "a"}, {"run_id": 1, "text": "a"}, {"run_id": 2, "text": None}]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, rows)))
    work = lambda b: b.withColumn("n", F.length("text"))
    for k in range(2):
        stream = ingest.queue(spark, str(inbox), "run_id long, text string")
        ingest.ingest(stream, work, out, str(tmp_path / f"checkpoint{k}"), then=lambda d: seen.append(d.count())).awaitTermination()
        assert sorted((r.run_id, r.text, r.n) for r in spark.read.parquet(out).collect()) == [(1, "a", 1), (2, None, None)]
    assert seen == [2, 2]


def test_registry_and_answers(spark, tmp_path) -> None:
    f = tmp_path / "r.json"
    f.write_text(json.dumps([{"canonical_id": "c:1", "canonical_name": "One", "aliases": ["1"], "code": 7}, {"canonical_id": "c:2", "canonical_name": "Two", "aliases": []}]))
    assert {r.canonical_id: r.extra for r in services.registry(spark, str(f)).collect()} == {"c:1": {"code": "7"}, "c:2": {}}
    df = spark.createDataFrame([('{"n": 1}',), ("no",), (None,)], "a string")
    read, bad = services.structured(F.col("a"), "n int")
    assert [(r.n, r.bad) for r in df.select(read["n"].alias("n"), bad.alias("bad")).collect()] == [(1, False), (None, True), (None, True)]
