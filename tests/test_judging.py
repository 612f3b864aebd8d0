"""Judgements, metrics, explanations and usage on small cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docloom.operators import judging
from docloom.operators.trust import WEIGHTS


def test_judgements_and_metrics(spark) -> None:
    kind = "query string, source_type string, source_id string, relevant boolean, seq int"
    old = spark.createDataFrame([("q", "chunk", "a", True, 1), ("q", "chunk", "b", True, 1), ("p", "chunk", "a", False, 1)], kind)
    new = spark.createDataFrame([("q", "chunk", "a", False, 2), ("q", "chunk", "c", True, 2), ("q", "chunk", "c", False, 2), ("q", "chunk", "b", False, 0)], kind)
    j = judging.recorded(old, new)
    assert {(r.query, r.source_id): r.relevant for r in j.collect()} == {("q", "a"): False, ("q", "b"): True, ("q", "c"): True, ("p", "a"): False}
    found = spark.createDataFrame([("q", "chunk", x, k) for k, x in enumerate("abxyc", 1)] + [("p", "chunk", "a", 1), ("none", "chunk", "z", 1)], "query string, source_type string, source_id string, rank int")
    got = {r.query: (r.hits, r.recall, r.precision) for r in judging.metrics(found, j, 3).collect()}
    assert got == {"q": (1, 0.5, 1 / 3), "p": (None, None, None), "none": (None, None, None)}


def test_explanations_and_usage(spark) -> None:
    scores = spark.createDataFrame([("e1", 0.5), ("e2", None)], "entity_id string, overall double").select("*", *[F.lit(0.25).alias(k) for k in WEIGHTS])
    findings = spark.createDataFrame([("e1", "z.rule", "error", False), ("e1", "a.rule", "info", True), (None, "b", "error", False)], "entity_id string, rule_id string, severity string, passed boolean")
    said = {r.entity_id: json.loads(r.explanation) for r in judging.explained(scores, findings).collect()}
    assert said["e1"]["weights"] == WEIGHTS and set(said["e1"]["components"].values()) == {0.25}
    assert [f["rule_id"] for f in said["e1"]["validation_findings"]] == ["a.rule", "z.rule"] and said["e2"]["validation_findings"] == []
    runs = spark.createDataFrame([("x", 1, 2, None), ("x", None, 5, 9), ("y", None, None, None)], "p string, input_tokens int, output_tokens int, total_tokens int")
    assert {tuple(r) for r in judging.usage(runs, ["p"]).collect()} == {("x", 1, 7, 12), ("y", 0, 0, 0)}
