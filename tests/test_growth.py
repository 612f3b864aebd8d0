"""Steps whose cost must not grow faster than their input: one pass, no shuffle of what a row holds, bounded batches."""

from __future__ import annotations

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import numbers, text
from docloom.operators import chunking, graph_build, judging, neighbours, pages, trust, vectorindex
from docloom.plans import catalogue, document_queries, stream_queries
from docloom.streaming import limiter

from .test_rules import cases


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dates_match_once(spark) -> None:  # F22
    df = spark.createDataFrame([("3 May 2026",), ("Sep 3 2026",), ("sept. 03, 2026",), ("31/4/2026",), ("1-2-3",), ("--",), ("2026-1-2\n",), (" 07 June, 2026",), (None,)], "v string")
    said = df.select("v", numbers.flexible_date(F.col("v")).cast("string").alias("d"))
    assert {r.v: r.d for r in said.collect()} == {"3 May 2026": "2026-05-03", "Sep 3 2026": "2026-09-03", "sept. 03, 2026": "2026-09-03", "31/4/2026": None, "1-2-3": None, "--": None, "2026-1-2\n": "2026-01-02", " 07 June, 2026": "2026-06-07", None: None}
    assert "regexp_extract" not in plan(said)
    for k, m in enumerate(numbers.MONTHS):
        assert ("".join(numbers.MONTHS).index(m) + 3) / 3 == k + 1


def forms():
    return ["27"], {"usd": "currency:USD"}, {"mt": "unit:metric_ton"}


def test_values_are_read_once(spark) -> None:  # F17
    text = plan(trust.normalised(cases(spark), *forms()))
    assert text.count("-?[0-9]+") == 1  # each use had its own extraction


def test_own_findings_need_no_join(spark) -> None:  # F9, F13, F15, F18, F21
    e = cases(spark)
    none = spark.createDataFrame([], "run_id int, page_number int, confidence double"), spark.createDataFrame([], "run_id int, page_number int, is_multi_column boolean")
    findings, normal = trust.entity_findings(e, 2026), trust.normalised(e, *forms())
    scores = trust.confidences(e, findings, normal, *none)
    own = trust.scored(trust.judged(e, 2026, *forms()), *none, few=True)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(own.select(*scores.columns)) == rows(scores)
    assert rows(trust.review_of(own)) == rows(trust.review_queue(scores, findings, normal))
    assert rows(judging.explained_of(own).select("entity_id", "explanation")) == rows(judging.explained(scores, findings).select("entity_id", "explanation"))
    skipped = lambda df: rows(df.select("entity_id", F.coalesce("skipped", F.lit("none"))))
    assert skipped(graph_build.eligibility_of(own)) == skipped(graph_build.eligibility(e, normal, scores))


@pytest.mark.parametrize("name", ["explained_scores", "review_queue", "provider_priors", "node_eligibility", "trust_run_stats"])
def test_line_items_are_read_once(spark, sf, name) -> None:  # F9, F13, F15, F18, F21
    text = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert text.count("l_orderkey") <= 1


def test_words_have_keys_by_whole_patterns(spark) -> None:  # F18, F21
    rng = np.random.default_rng(0)
    signs = ["5", "MT", "Usd", "a", "\u03a3", "\u0130", " ", " ", "\t", "\n", "\r", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", ".", ",", "(", ")", "..", "$", "-"]
    df = spark.createDataFrame([(None,), ("",), (" ",), ("$",), ("\n",), *[("".join(rng.choice(signs, rng.integers(1, 12))),) for _ in range(5000)]], "c string")
    words = F.transform(F.split(F.trim(F.regexp_replace("c", r"\$", r" \$ ")), r"\s+"), lambda w: text.alias_key(F.regexp_replace(w, r"^[().,]+|[().,]+$", "")))
    both = df.select("c", text.keys_of_words(F.col("c")).alias("got"), F.concat(F.array(text.alias_key(F.col("c"))), words).alias("want"))
    assert not both.where(~F.col("got").eqNullSafe(F.col("want"))).collect()


@pytest.mark.parametrize("name", ["node_eligibility", "trust_run_stats", "confidence_scores"])
def test_rows_are_judged_by_compiled_code(spark, sf, name) -> None:  # F18, F21
    now = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else code is made stage by stage, as it runs
    try:
        df = catalogue.queries()[name](spark, sf)
        made = df._jdf.queryExecution().debug().codegenToSeq()
        longest = max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", now)
    said = plan(df)
    assert "aggregate(" not in said and "transform(" not in said  # functions over arrays are interpreted
    assert said.count("filter(") <= 2  # the words of quantities and of prices
    assert longest < 8000  # the JVM interprets longer methods


def test_keys_are_made_for_types_that_have_any(spark) -> None:  # F18, F21
    e = spark.createDataFrame([(1, "country", "India"), (2, "date", "India"), (3, "company", "India"), (4, None, "India")], "entity_id int, entity_type string, raw_value string").withColumn("normalized_value", F.lit(None).cast("string"))
    a = spark.createDataFrame([(k, "india", f"{k}:1", "India") for k in ("country", "date", "company")], "registry string, alias string, canonical_id string, canonical_name string")
    got = lambda *kinds: {r.entity_id: r.alias_id for r in trust.with_alias(e, F.broadcast(a), *kinds).collect()}
    assert got() == {1: "country:1", 2: "date:1", 3: "company:1", 4: None}
    assert got(trust.LOOKED_UP) == {1: "country:1", 2: None, 3: None, 4: None}


def test_recall_counts_repeats(spark) -> None:  # F20
    df = spark.createDataFrame([(1, "a a b c 1.5 1.5 2", "a c 1.5"), (2, "a b b b", "b"), (3, "", "x"), (4, None, "x"), (5, " ".join(f"w{i % 97}" for i in range(1000)), " ".join(f"w{i}" for i in range(40)))], "k int, t string, f string")
    words, nums = pages.recall(F.col("t"), F.col("f"))
    got = {r.k: (r.w and round(r.w, 9), r.n and round(r.n, 9)) for r in df.select("k", words.alias("w"), nums.alias("n")).collect()}
    assert got == {1: (round(5 / 7, 9), round(2 / 3, 9)), 2: (0.75, 0.0), 3: (0.0, 0.0), 4: (None, None), 5: (sum(i % 97 < 40 for i in range(1000)) / 1000, sum(i % 97 < 40 for i in range(1000)) / 1000)}
    assert "array_contains(lambda b" not in plan(df.select(words))  # a word is not looked for among all words


def test_chunks_leave_in_small_batches(spark, monkeypatch) -> None:  # F8
    import public_tokenizers

    sizes = []
    df = spark.createDataFrame([(k, "some words. " * 50) for k in range(3000)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(chunking, "map_batches", lambda d, f, schema: sizes.append(f) or d.mapInArrow(f, schema), raising=False)
    chunking.chunked_by_tokens(df, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, 20, 5)
    monkeypatch.setattr(chunking, "BATCH_CHARS", 5000, raising=False)
    import pyarrow as pa

    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": ["some words. " * 50] * 100})
    out = list(sizes[0](iter([whole])))
    assert len(out) > 5 and max(sum(len(t.as_py()) for t in b["text"]) for b in out) < 6000


def test_words_of_a_chunk_stay_in_their_row(spark) -> None:  # F12
    words = [f"w{k % 60}" for k in range(120)]
    df = spark.createDataFrame([("r", 1, " ".join(words)), ("r", 2, " "), ("r", 3, None), ("r", 4, "a  b")], "run_id string, doc_id long, text string")
    got = stream_queries._chunks(df)
    assert "Aggregate" not in plan(got)
    assert {(r.doc_id, r.chunk): set(r.words) for r in got.collect()} == {(1, 0): set(words[:50]), (1, 1): set(words[50:100]), (1, 2): set(words[100:]), (4, 0): {"a", "b"}}


def test_vectors_in_slices() -> None:  # F19
    for rows, wide in ((0, 5), (10, 1), (5000, 4096), (7, 1 << 22)):
        at = list(vectorindex._slices(rows, wide))
        assert np.array_equal(np.concatenate([np.arange(rows)[x] for x in at] or [np.zeros(0, int)]), np.arange(rows))
        assert all((x.stop - x.start) * wide <= max(vectorindex.SLICE, wide) for x in at)


def test_stream_writes_by_all_tasks() -> None:  # F16
    assert "coalesce(1)" not in inspect.getsource(stream_queries.limiter_stream)
    assert not list(limiter.Windows.handleExpiredTimer(type("W", (), {"window": type("S", (), {"clear": lambda self: None})()})(), None, None, None))


def test_metrics_read_judgements_once(spark) -> None:  # F23
    kind = "query string, source_type string, source_id string"
    j = spark.createDataFrame([("q", "c", "a", True), ("q", "c", None, True), (None, "c", "a", True)], f"{kind}, relevant boolean")
    found = spark.createDataFrame([("q", "c", "a", 1), ("q", "c", "a", 2), ("q", "c", None, 3), (None, "c", "a", 1)], f"{kind}, rank int")
    got = judging.metrics(found, j, 5)
    assert "Join" not in plan(got)
    assert {r.query: (r.hits, r.recall, r.precision) for r in got.collect()} == {"q": (1, 1.0, 1 / 3), None: (None, None, None)}


def shown(row) -> list[str]:
    return [repr(float(x)) for x in row]


def by_sql(df, name: str) -> list[str]:
    import duckdb

    c = duckdb.connect()
    c.register("embeddings", df.toArrow())
    r = c.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    row = r.fetchone()
    return shown(row[columns.index(x)] for x in ("hits", "k", "precision_at_k", "recall_at_k"))


@pytest.mark.parametrize("labels", [[0, 1, 0], [0, 1, None], [0, 1, 7]])
def test_every_vector_is_asked_for(spark, tmp_path, labels) -> None:  # F3
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(6).round(2).tolist(), labels[k % 2] if k else labels[2]) for k in range(250)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["recall_precision_at_k"](spark, str(tmp_path)).first()
    assert got.k == 10 * sum(r[2] is not None for r in rows)  # ids divisible by 100 alone gave 30
    assert shown(got) == by_sql(df, "recall_precision_at_k")


def odd_vectors(n: int) -> list:
    """Random vectors, groups of copies, and vectors of length zero, not finite, and null."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 5)).round(1)
    x[n // 2 : n // 2 + n // 4] = x[0]
    x[1::41], x[2::97, 1], x[3::97, 2] = 0, np.nan, np.inf
    return [None if k % 61 == 7 else v.tolist() for k, v in enumerate(x)]


@pytest.mark.parametrize("n", [1, 8, 130, 700])
def test_neighbours_are_those_of_the_sql(spark, monkeypatch, n) -> None:  # F1
    import duckdb

    monkeypatch.setattr(neighbours, "ROWS", 150)  # several blocks
    df = spark.createDataFrame(list(enumerate(odd_vectors(n))), "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, str(r.distance)) for r in neighbours.neighbours(df, 10).collect())
    c = duckdb.connect()
    c.register("e", df.toArrow())
    d = "round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"
    want = c.execute(f"SELECT * FROM (SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {d}, b.vec_id) AS r, b.vec_id AS v, {d} + 0.0 FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE r <= 10").fetchall()
    assert got == sorted((q, r, v, str(d)) for q, r, v, d in want)


def test_tiles_give_what_one_product_gives(monkeypatch) -> None:  # F1
    import pyarrow as pa

    vectors = [v if k % 50 else [1.0] for k, v in enumerate(odd_vectors(400))]  # some of another length
    b = neighbours._Block(pa.table({"vec_id": list(range(400)), "embedding": pa.array(vectors, pa.list_(pa.float32()))}))
    whole = neighbours._nearest(b, b, 7, True)
    monkeypatch.setattr(neighbours, "QUERIES", 13)
    monkeypatch.setattr(neighbours, "ITEMS", 17)
    assert [str(x) for x in neighbours._nearest(b, b, 7, True)] == [str(x) for x in whole] and len(whole[0]) == 2800


def test_pairs_meet_in_blocks(spark, sf) -> None:  # F1
    said = plan(catalogue.queries()["recall_precision_at_k"](spark, sf))
    assert "aggregate(" not in said and "FlatMapCoGroupsInArrow" in said  # all queries were sent to all tasks, and a pair's product was not compiled


def test_words_of_a_page_stay_in_its_row(spark, sf) -> None:  # F2
    said = plan(catalogue.queries()["grounded_values"](spark, sf))
    assert "explode" not in said  # a row a word was shuffled back to its page
    assert "filter(split(" not in said  # words were made anew for each use, as functions over arrays are not shared


def test_plain_pages_are_grounded_as_all_others(spark) -> None:  # F2
    rng = np.random.default_rng(4)
    pool = np.array(["a", "b", "ab", "aa", "Ba", "Σ", "aΣ", "İ", "a b", " ", "", "\t", "a b", "　", "c" * 9], object)
    words = lambda k: [None if rng.random() < 0.02 else str(x) for x in rng.choice(pool[: 8 if k % 3 else len(pool)], rng.integers(0, 25))]
    pages_ = spark.createDataFrame([(k, words(k)) for k in range(300)] + [(300, None), (301, ["a"] * 14)], "page long, words array<string>")
    asks = ["a", "A", "a  b", "b a", "aa a", "σ", "aς b", "i̇", "ab\tAa b", "", " ", None, " ".join(["a"] * 12), " ".join(["a"] * 13)]
    values = pages_.select("page").crossJoin(spark.createDataFrame([(x,) for x in asks], "raw_value string"))
    key = text.alias_key(F.coalesce("raw_value", F.lit("")))
    walked = F.when((key != "") & F.col("words").isNotNull(), pages._walked(F.col("words"), key))
    want = values.join(pages_, "page").select("page", "raw_value", walked.alias("at")).withColumn("at", F.when(F.col("at.size") <= pages.MAX_WINDOW, F.col("at")))
    rows = lambda df: sorted((r.page, repr(r.raw_value), r["at"] and (r["at"]["size"], r["at"]["i"])) for r in df.select("page", "raw_value", "at").collect())
    got = rows(pages.standing(values, pages_))
    assert sum(r[2] is not None for r in got) > 500
    assert [repr(r) for r in got] == [repr(r) for r in rows(want)]


def test_rows_of_one_id_are_one_page(spark) -> None:  # F2
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(k % 30, [str(x) for x in rng.choice(["a", "B", "ab", "c"], rng.integers(4, 12))]) for k in range(45)], "doc_id long, ws array<string>")
    s = d.select(F.col("doc_id").alias("page"), F.posexplode("ws").alias("p", "word")).select("page", (F.col("p") + 1).alias("pos"), F.lower("word").alias("word"), ((F.col("p") + 1) * 10.0).alias("x0"), F.lit(0.0).alias("y0"), ((F.col("p") + 1) * 10.0 + 8).alias("x1"), F.lit(9.0).alias("y1"))
    middle = F.floor(F.size("ws") / 2).cast("int")
    v = d.select("doc_id", F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 3 == 0, "zzqx").otherwise(F.concat_ws(" ", F.get("ws", middle - 1), F.get("ws", middle))).alias("raw_value"))
    assert sorted(map(repr, pages.grounded(v, s, "doc_id").select("doc_id", "x0", "x1").collect())) == sorted(map(repr, document_queries.grounded_middle(d).collect()))
