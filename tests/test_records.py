"""Tables of record: what must fail, and what SQL does not check."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import alias_key
from docloom.operators import graph, graph_build, records, retrieval


def test_versions_do_not_change(spark) -> None:
    p = spark.createDataFrame([("a", "1.9", "x"), ("a", "1.10", "y"), ("b", "0.1", "z")], "name string, version string, text string")
    assert {r.name: r.version for r in records.latest_prompts(p).collect()} == {"a": "1.10", "b": "0.1"}
    assert records.registered(p, p.where("false")).count() == 3
    with pytest.raises(Exception, match="already registered"):
        records.registered(p, p.where("name = 'b'")).collect()


def test_dimension(spark) -> None:
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<double>")
    assert records.of_dimension(v, "v", 2).count() == 2
    with pytest.raises(Exception, match="not 3"):
        records.of_dimension(v, "v", 3).collect()


def test_signatures(spark) -> None:
    for secret in ("k", "long " * 30):
        got = spark.range(1).select(records.signed_key(F.lit("docs/ä"), F.lit(99), secret).alias("s")).first().s
        assert got == hmac.new(secret.encode(), "docs/ä:99".encode(), hashlib.sha256).hexdigest()
        holds = lambda now, s, secret=secret, got=got: spark.range(1).select(records.signature_holds(F.lit("docs/ä"), F.lit(99), F.lit(s), F.lit(now), secret).alias("h")).first().h
        assert holds(99, got) and not holds(100, got) and not holds(0, "other")


def test_token_counts(spark, sf) -> None:
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    encoder = tokenizers.Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    encoder.encode_special_tokens = True
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = d.select("text", records.token_counts(F.col("text"), str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN).alias("n")).collect()
    assert all(r.n == len(encoder.encode(r.text or "", add_special_tokens=False).ids) for r in rows)


def test_synthetic_and_sample(spark) -> None:
    ids = spark.range(50)
    text = lambda df: {r.id: r.text for r in records.synthetic_paragraphs(df, ["a", "b", "c"], 9, 1).collect()}
    got = text(ids)
    assert got == text(ids.repartition(7)) and got != {r.id: r.text for r in records.synthetic_paragraphs(ids, ["a", "b", "c"], 9, 2).collect()}
    assert all(1 <= len(t.split()) <= 9 and set(t.split()) <= {"a", "b", "c"} for t in got.values())
    assert 0 < records.sampled(spark.range(10000), 0.01, 7).count() < 300


def test_changes_may_be_null(spark) -> None:
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    out = records.updated(rows, spark.createDataFrame([(2, None)], "id int, v string"), ["id"])
    assert {tuple(r) for r in out.collect()} == {(1, "a", "x"), (2, None, "y")}
    assert records.deleted(rows, rows.where("id = 1"), ["id"]).count() == 1


def folded(runs, mentions, merges):
    """The build as a fold: run after run, each upserting its nodes and edges, until one fails."""
    nodes, edges, stats = {}, {}, dict.fromkeys(("runs_processed", "skipped", "nodes_created", "nodes_updated", "edges_created", "edges_updated"), 0) | {"failed_run": None}

    def lives(c):
        for _ in range(graph.MAX_MERGES):
            c = merges.get(c, c)
        return c

    for run in sorted(runs):
        mine = sorted((m for m in mentions if m[0] == run), key=lambda m: (m[2], m[5]))
        if any(m[6] is not None and not 0 <= m[6] <= 1 for m in mine):
            stats["failed_run"] = run
            break
        stats["runs_processed"] += 1
        good = [(m[1], lives(m[3]), m[4], m[5], m[6]) for m in mine if m[3] and m[6] is not None]
        stats["skipped"] += len(mine) - len(good)
        for node in dict.fromkeys(g[1] for g in good):
            values = [g[3] for g in good if g[1] == node]
            if node not in nodes:
                nodes[node] = (values[0], set(values))
                stats["nodes_created"] += 1
            elif set(values) - nodes[node][1]:
                nodes[node][1].update(values)
                stats["nodes_updated"] += 1
        touched = {}
        for c1, n1, k1, _, o1 in good:
            for c2, n2, k2, _, o2 in good:
                if c1 == c2 and k1 == "company" and k2 == "port" and n1 != n2 and 0.75 * (o1 + o2) / 2 >= 0.3:
                    touched.setdefault((n1, n2), []).append((0.75 * (o1 + o2) / 2, c1))
        for key, found in touched.items():
            stats["edges_updated" if key in edges else "edges_created"] += 1
            was = edges.get(key, (0, set()))
            edges[key] = (max(was[0], *(c for c, _ in found)), was[1] | {c for _, c in found})
    return nodes, edges, stats


def test_build_equals_a_fold_over_runs(spark) -> None:
    import random

    rng = random.Random(3)
    merges = {f"c{k}": f"c{k - 1}" for k in range(1, 14)}
    runs = list(range(12))
    mentions = [(rng.choice(runs), rng.randint(0, 3), k, rng.choice([None, *(f"c{j}" for j in range(16))]) if k % 2 else f"p{rng.randint(0, 3)}", "company" if k % 2 else "port", f"v{rng.randint(0, 3)}", rng.choice([None, 0.0, 0.5, 0.9, 1.0])) for k in range(160)]
    kinds = "run_id int, chunk_id int, seq int, canonical_id string, node_type string, value string, overall double"
    r = spark.createDataFrame([(k, k) for k in runs], "run_id int, seq int")
    for bad in (None, 7, 0):
        rows = mentions + ([(bad, 0, 999, "c1", "company", "v", 1.5)] if bad is not None else [])
        nodes, edges, stats = graph_build.built(r, spark.createDataFrame(rows, kinds), spark.createDataFrame(list(merges.items()), "node string, into string"), ("company", "port"), "owns", 0.75)
        n, e, s = folded(runs, rows, merges)
        assert {x.node: (x.display_name, set(x.aliases)) for x in nodes.collect()} == n
        assert {(x.source, x.target): (round(x.confidence, 6), x.evidence_count) for x in edges.collect()} == {k: (round(c, 6), len(v)) for k, (c, v) in e.items()}
        assert stats.first().asDict() == s
    assert graph_build.built(r, spark.createDataFrame([], kinds), spark.createDataFrame([], "node string, into string"), ("company", "port"), "owns", 0.75)[2].first().runs_processed == 12


def test_survivors_by_doubling(spark) -> None:
    m = {f"n{k}": f"n{k + 1}" for k in range(14)} | {"x": "y", "y": "x"}
    got = {r.node: r.survivor for r in graph.survivors(spark.createDataFrame(list(m.items()), "node string, into string")).collect()}

    def walk(n):
        for _ in range(graph.MAX_MERGES):
            n = m.get(n, n)
        return n

    assert got == {n: walk(n) for n in m}


def test_merge_moves_evidence_and_drops_loops(spark) -> None:
    e = spark.createDataFrame([("a", "p", "r", 0.5), ("b", "p", "r", 0.7), ("a", "b", "r", 0.9)], "a string, b string, relationship string, confidence double")
    v = spark.createDataFrame([("a", "p", "r", 1), ("b", "p", "r", 1), ("b", "p", "r", 2), ("a", "b", "r", 3)], "a string, b string, relationship string, chunk_id int")
    edges, proof = graph.merged(e, v, spark.createDataFrame([("b", "a")], "node string, survivor string"))
    assert [tuple(r) for r in edges.collect()] == [("a", "p", "r", 0.7, 2)] and proof.count() == 3


def test_missing_rows_cannot_be_cited(spark) -> None:
    none = F.lit(None).cast("string")
    chunks = spark.range(1).select(F.lit("c1").alias("chunk_id"), F.lit("d").alias("document_id"), none.alias("document_title"), F.lit(1).alias("page_number"), F.lit("t" * 300).alias("text"))
    nodes = spark.createDataFrame([], "node_id string, canonical_id string")
    edges = spark.createDataFrame([], "edge_id string, source_node string, target_node string, relationship string, confidence double")
    proof = spark.createDataFrame([], "evidence_id string, edge_id string, document_id string, page_number int, chunk_id string, entity_id string")
    ontology = spark.createDataFrame([], "entity_type string, description string")
    ask = lambda kind, i: retrieval.cited(spark.createDataFrame([("q", kind, i, 1)], "query_id string, source_type string, source_id string, final_rank int"), chunks, nodes, edges, proof, ontology).collect()
    assert len(ask("document_chunk", "c1")[0].text_snippet) == 283
    assert not ask("ontology_definition", "x")[0].in_context
    for kind in ("document_chunk", "graph_node", "graph_edge"):
        with pytest.raises(Exception, match="not found"):
            ask(kind, "x")


def test_query_entities(spark) -> None:
    names = [("new south port", 1, "port", "p1"), ("south", 2, "country", "s"), ("port", 1, "commodity", "c"), ("port", 2, "port", "p2")]
    aliases = spark.createDataFrame([(a, *r) for a, *r in names], "alias string, rank int, entity_type string, canonical_id string").withColumn("alias", alias_key(F.col("alias")))
    q = spark.createDataFrame([(1, "To New South Port, then south"), (2, "any PORT"), (3, ""), (4, "nothing")], "query_id int, query string")
    got = {(r.query_id, r.canonical_id, r.matched_text) for r in retrieval.query_entities(q, aliases).collect()}
    assert got == {(1, "p1", "New South Port"), (1, "s", "south"), (2, "c", "PORT")}
