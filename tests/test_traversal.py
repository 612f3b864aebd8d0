"""Traversal over bucketed edges against breadth-first search in Python; hubs in slices, many seeds, paths from both ends."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import graph, traversal


def levels(edges, seed):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    depth, front = {seed: 0}, [seed]
    while front:
        front = [b for a in front for b in sorted(near.get(a, ())) if b not in depth and not depth.update({b: depth[a] + 1})]
    return depth, near


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(7)
    return [(f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(170)] + [("hub", f"n{k}") for k in range(0, 60)] + [("x", "y"), ("n1", "n1"), ("x", "y")] + [(f"z{k}", f"z{k + 1}") for k in range(9)]


@pytest.fixture(scope="module")
def adjacency(spark, edges, tmp_path_factory):
    return traversal.Adjacency.build(spark.createDataFrame(edges + [(None, "n1")], "a string, b string"), str(tmp_path_factory.mktemp("g") / "g"), hub=8)


def test_hops_send_no_edges(spark, adjacency) -> None:
    front = spark.createDataFrame([("hub",), ("x",)], "node string")
    step = adjacency.step(front)
    assert sorted((r.node, r.to) for r in step.collect()) == sorted([("hub", f"n{k}") for k in range(60)] + [("x", "y")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else so few edges are sent as a whole
    try:
        plan = adjacency.step(front)._jdf.queryExecution().executedPlan().treeString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "cell#" in line and "FileScan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, k = [], scan
    while k > 0 and "Join" not in lines[k]:
        k -= 1
        if depth(lines[k]) < depth(lines[scan]):
            above.append(lines[k])
            if "Join" in lines[k]:
                break
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in x for x in above if depth(x) > depth(lines[k])), plan
    assert adjacency.hubs.where("node = 'hub'").first().slices == 8


def test_many_seeds(spark, edges, adjacency) -> None:
    seeds = ["hub", "x", "nowhere"] + [f"n{k}" for k in range(80)]
    got = {(r.seed, r.node): r.depth for r in adjacency.within(seeds, 4).collect()}
    want = {}
    for s in seeds:
        want |= {(s, n): d for n, d in levels(edges, s)[0].items() if d <= 4}
    assert got == want
    frame = spark.createDataFrame([(s,) for s in seeds], "seed string")
    near = {r.node: (r.hops, r.seed) for r in adjacency.nearest(frame, 3).collect()}
    best = {}
    for (s, n), d in want.items():
        if d <= 3:
            best[n] = min(best.get(n, (99, "")), (d, s))
    assert near == best


def test_levels_and_jobs_of_many_seeds(spark, edges, adjacency) -> None:
    seeds = ["hub", "x", "y", "nowhere", None, "n1"] + [f"n{k}" for k in range(0, 150, 3)]
    got = {(r.seed, r.depth): (r.nodes, r.first_node, r.last_node) for r in adjacency.levels(spark.createDataFrame([(s,) for s in seeds + ["x"]], "seed string"), 3).collect()}
    want = {(None, 0): (1, None, None)}
    for s in filter(None, seeds):
        by = {}
        for n, d in levels(edges, s)[0].items():
            by.setdefault(d, []).append(n)
        want |= {(s, d): (len(ns), min(ns), max(ns)) for d, ns in by.items() if d <= 3}
    assert got == want
    # seeds beyond the words of a round take no jobs of their own
    jobs = []
    for n in (2, 3 * 64 * traversal.WORDS):
        spark.sparkContext.setJobGroup(f"seeds{n}", "")
        adjacency.within(["x"] + [f"q{k}" for k in range(n)], 1).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"seeds{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 6, jobs


def test_paths(spark, edges, adjacency) -> None:
    rng = random.Random(2)
    pairs = [("x", "y"), ("x", "n1"), ("z0", "z6"), ("z0", "z7"), ("n3", "n3"), ("hub", "n149")] + [(f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(5)]
    for a, b in pairs:
        depth, near = levels(edges, a)
        want = None
        if depth.get(b, 99) <= graph.MAX_DEPTH:
            want = [b]
            while want[0] != a:
                want.insert(0, min(n for n in near[want[0]] if depth.get(n, 99) == depth[want[0]] - 1))
        assert adjacency.path(a, b) == want, (a, b)
