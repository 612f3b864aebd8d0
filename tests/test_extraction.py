"""Dictionary entities against a search of every alias at every place; offsets, overlaps, aliases in parts."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from docloom.operators import extraction


def brute(text, aliases):
    """Every whole-word match by regular expressions over the text itself, then leftmost and longest."""
    all_of = []
    for k, a in enumerate(aliases):
        pattern = re.sub(r"\\? ", r"\\s+", re.escape(a))
        for at in range(len(text)):
            m = re.compile(pattern, re.I).match(text, at)
            if m and not (at and extraction._word(text[at - 1]) and extraction._word(text[at])) and not (m.end() < len(text) and extraction._word(text[m.end()]) and extraction._word(text[m.end() - 1])):
                all_of.append((m.start(), m.end(), k))
    out = []
    for m in sorted(all_of, key=lambda m: (m[0], -m[1])):
        if not out or m[0] >= out[-1][1]:
            out.append(m)
    return out


def test_against_every_place() -> None:
    rng = random.Random(1)
    aliases = ("coal", "iron", "iron ore", "ore", "ore of port", "port", "u.s.", "c++", "é", "re_port")
    for _ in range(400):
        text = "".join(rng.choice(["coal", "Iron", "ore", "port", " ", "  ", "\n", ", ", "of", "x", "U.S.", "C++", "É", "_", "re_port", "-", " "]) for _ in range(rng.randint(0, 14)))
        assert extraction.chosen(extraction.matches_in(text, aliases)) == brute(text, aliases), text


def test_offsets_are_of_the_text_itself() -> None:
    text = "İİ  Iron \n\t ORE, İ coal"
    got = extraction.chosen(extraction.matches_in(text, ("coal", "iron ore")))
    assert [text[s:e] for s, e, _ in got] == ["Iron \n\t ORE", "coal"]


def test_entities(spark) -> None:
    docs = spark.createDataFrame([(1, "Iron Ore of Port  Said, iron"), (2, None), (3, ""), (4, "coal " * 30_000), (1, "Iron Ore of Port  Said, iron"), (None, "coal")], "id long, text string").withColumn("alias", F.lit("x"))
    names = spark.createDataFrame([("commodity", "c1", "Iron ore", "iron ore"), ("commodity", "c2", "Iron", "iron"), ("port", "p2", "Port Said", "port said"), ("port", "p1", "Said", "port said"), ("commodity", "c3", "Coal", "coal"), ("company", "x", "Coal", "coal")], "entity_type string, canonical_id string, canonical_name string, alias string")
    whole = sorted(tuple(map(str, r)) for r in extraction.entities(docs, "id", "text", names).collect())
    assert len(whole) == 2 * 3 + 2 * 30_000 + 2
    assert ("1", "commodity", "c1", "Iron ore", "0", "8", "Iron Ore") in whole and ("1", "port", "p1", "Said", "12", "22", "Port  Said") in whole
    parts = extraction.entities(docs.where("id <> 4 or id is null"), "id", "text", names, limit=6)
    assert sorted(tuple(map(str, r)) for r in parts.collect()) == [r for r in whole if r[0] != "4"]
    assert extraction.entities(docs, "id", "text", names.where("false")).count() == 0
    made = extraction.registry(spark.createDataFrame([(1, " Big  Port ", ["BP", " "])], "id int, name string, more array<string>"), "port", F.col("id"), F.col("name"), F.col("more")).collect()
    assert [(r.canonical_id, r.alias) for r in made] == [("1", "big port"), ("1", "bp")]
