"""Repairs against the least of all cheapest letter strings, found by recursion on what is left; whole reports against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from docloom.llm import op13_repair as op
from docloom.llm.common import table


@lru_cache(None)
def least(marks: str, so_far: str = "", inserts: int = 3):
    """(cost, letters) of the best way on, so_far being the initials given: tries everything, checks the pattern itself."""
    ways = []
    if not re.fullmatch("(s?(ua)*u?)?", so_far):
        return 10**9, ""
    short = so_far if len(so_far) < 3 else so_far[0] * (so_far[0] == "s") + "ua" + "u" * so_far.endswith("u")
    if short != so_far:
        return least(marks, short, inserts)
    if not marks and re.fullmatch("(s?(ua)+)?", so_far):
        ways.append((0, ""))
    if inserts:
        ways += [(c + 5, "I" + x) for c, x in (least(marks, so_far + r, inserts - 1) for r in "ua")]  # at most three in a row
    if marks:
        m, rest = marks[0], marks[1:]
        c, x = least(rest, so_far)
        ways.append((c + 2, "D" + x))
        if m != "-":
            more = 5 if m.isupper() else 0
            for letter, cost, roles in (("K", 0, m.lower()), ("R", 1, "ua")):
                for r in roles:
                    c, x = least(rest, so_far + r)
                    ways.append((c + cost + more, letter + x))
    return min(ways) if ways else (10**9, "")


def test_walk_gives_the_least_of_all_cheapest() -> None:
    for n in range(5):
        for marks in map("".join, product("suaxUA-", repeat=n)):
            audit, cost = op.solve(marks)
            assert (cost, audit) == least(marks), marks


def test_segments_compose() -> None:
    """Cut anywhere, a conversation gets the same letters."""
    marks = "suauxAu-aUasuuaa-uXau" * 2
    audit, cost = op.solve(marks)
    for cuts in ([7], [1, 2, 30], list(range(1, len(marks)))):
        at = [0, *cuts, len(marks)]
        parts = [marks[a:b] for a, b in zip(at, at[1:])]
        ends = op.chained([{"conv_id": 1, "part": k, "crossing": op.crossing(p)} for k, p in enumerate(parts)])
        walks = []
        for p, e in zip(parts, ends, strict=True):
            ahead, behind = op.forward(p, tuple(e["ahead"])), op.backward(p, tuple(e["behind"]))
            for q in range(4):
                if ahead[0][q] + behind[0][q] == e["best"]:
                    letters, out = op.walk(p, ahead, behind, e["best"], {q}, e["last"])
                    walks.append({"conv_id": 1, "part": e["part"], "enter": q, "leave": min(out), "letters": letters, "best": e["best"]})
        assert op.joined(walks) == [{"conv_id": 1, "audit": audit, "cost": cost}]


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        word = lambda v: " " if v is None else str(v)
        out = convs.setdefault(c, [])
        fault = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        r, x = word(r), word(x)
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        r = "user" if fault == 4 else r
        out += [] if fault == 0 else [(t, r, x)] * (2 if fault == 3 else 1)
    for c, out in convs.items():
        out.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), hashlib.sha256(v[2].encode()).hexdigest()))
        seen, marks, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, r, x in out:
            ink = x.rstrip(" \t\n\v\f\r")
            kind = "blank" if not ink else "duplicate" if (r, x) in seen else "truncated" if ink[-1] not in ".!?" else None
            seen.add((r, x))
            if kind:
                n[kind] += 1
            m = r[:1] if r[:1] in ("s", "u", "a") else "x"
            marks += "-" if kind in ("blank", "duplicate") else m.upper() if kind else m
        for k in range(0, len(marks), 20):  # from the end, so that recursion stays shallow
            least(marks[len(marks) - k :])
            for so_far in ("s", "u", "su", "ua", "sua", "uau", "suau"):
                least(marks[len(marks) - k :], so_far)
        cost, audit = least(marks)
        said, state, k = [], 0, 0
        for letter in audit:
            if letter != "I":
                t, r, x = out[k]
                k += 1
            if letter == "D":
                continue
            if letter in "IR":
                r, x = ("assistant" if said and said[-1][0] == "u" else "user"), ("" if letter == "I" else x)
            said.append(f"{r}:{x}")
        turns = {t for t, _, _ in out if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
        yield (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost if out else 0, audit if out else "", hashlib.sha256("\n".join(said).encode()).hexdigest())


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_report(spark, sf) -> None:
    t = table(spark, sf, "conversations")
    assert order(op.report(t).collect()) == order(plain([tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()]))
    # repaired conversations need no more edits
    rows = op.damaged(t)
    out = op.repaired(rows).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append(r)
    assert all(re.fullmatch("s?(ua)+", "".join(r.role[0] for r in v)) and [r.turn for r in v] == list(range(len(v))) for v in by.values())


def test_odd_conversations(spark) -> None:
    odd = [(1, 0, None, "Hi."), (1, None, "user", None), (1, 2, "", "No role."), (1, 2, "", "No role."), (None, 1, "user", "Who?"), (None, 2, "assistant", "Me."), (2, None, "system", "Be kind!"), (2, None, "server", "É"), (3, 1, "user", "x" * 200_000), (3, 2, "assistant", "\U0001f600."), (3, 2, "Assistant", "A."), (4, 5, "user", " \n"), (5, -3, "assistant", "Yes."), (5, 9, "assistant", "Yes.")]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x")).withColumn("copy", F.lit("y"))
    assert order(op.report(df).collect()) == order(plain(odd))
    assert op.report(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [700])
def test_hot_conversation_is_cut(spark, n) -> None:
    rows = [(9, k, ("user", "assistant", "user", "tool")[k % 4], f"Line {k // 3}" + ".!?,"[k % 4]) for k in range(n)] + [(k, 0, "user", "Hi.") for k in range(20, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert op.segments(op.marks(op.damaged(df))).where("conv_id = 9").count() > 1
    assert order(op.report(df).collect()) == order(plain(rows))
