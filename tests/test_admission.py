"""Admission of uploads against a walk in order of arrival."""

from __future__ import annotations

import random

from docloom.operators import admission


def walk(uploads, store, quota):
    have = {}
    for o, h in store:
        have.setdefault(o, []).append(h)
    out = {}
    for k, o, h, name, mime, size in sorted(uploads):
        mine = have.setdefault(o, [])
        if size <= 0:
            out[k] = "empty"
        elif quota is not None and len(mine) >= quota:
            out[k] = "quota"
        elif h in mine:
            out[k] = "duplicate"
        else:
            out[k] = None
            mine.append(h)
    return out


def test_admission(spark) -> None:
    rng = random.Random(6)
    owners = [None, "a", "b", "hot"]
    uploads = [(k, rng.choice(owners) if k % 3 else "hot", f"h{rng.randint(0, 60)}", "x.pdf", "application/pdf", rng.choice([0, 5, 5, 5])) for k in range(500)]
    store = [(rng.choice(owners), f"h{rng.randint(0, 60)}") for _ in range(30)]
    store = list(dict.fromkeys(store))
    u = spark.createDataFrame(uploads, "k int, owner string, hash string, name string, mime string, size int").repartition(7)
    s = spark.createDataFrame(store, "owner string, hash string")
    for quota in (0, 9, 25, None):
        got = {r.k: r.reason for r in admission.admitted(u, s, quota, ["k"]).collect()}
        assert got == walk(uploads, store, quota), quota
    assert admission.admitted(u.where("false"), s, 3, ["k"]).count() == 0
