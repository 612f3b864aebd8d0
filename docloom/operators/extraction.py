"""Entities of a text by a dictionary: the aliases of registries, all found in one pass by an automaton.

An alias is compared by its key (lower case, one space for white space) and must not continue into a letter, digit or underscore on either
side. Of matches that overlap the one that begins first is taken, of those the longest. Offsets are code points of the text as it
stands, so a mention can be grounded on its page. The automaton (Aho and Corasick's, of a published library) is built once a task
from the aliases, which are sent to all tasks while they have at most LIMIT characters; more aliases are cut into parts of that size, each text
passes every part's automaton, and the matches of a text are chosen among at the end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alias_key
from .graph import cut

#: Characters of aliases that one automaton holds; it takes some hundred bytes for each.
LIMIT = 4_000_000

Match = tuple[int, int, int]


def key_of(text: str) -> tuple[str, Callable[[int], int]]:
    """The text as it is compared, and where a place of it lies in the text itself."""
    low = text.lower()
    if len(low) == len(text):
        at = None
    else:  # a character whose lower case is longer
        low, at = "", []
        for k, c in enumerate(text):
            low += c.lower()
            at += [k] * len(c.lower())
        at.append(len(text))
    out, places, shifts, end = [], [0], [0], 0
    length = 0
    for m in re.finditer(r"\s+", low):
        if m[0] == " ":
            continue
        out += [low[end : m.start()], " "]
        length += m.start() - end + 1
        end = m.end()
        places.append(length)
        shifts.append(end - length)
    out.append(low[end:])

    def original(place: int) -> int:
        p = place + shifts[bisect_right(places, place) - 1]
        return p if at is None else at[p]

    return "".join(out), original


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def chosen(matches: list[Match]) -> list[Match]:
    """Leftmost, then longest, without overlaps, of (start, end, alias)."""
    out: list[Match] = []
    for m in sorted(matches, key=lambda m: (m[0], -m[1], m[2])):
        if not out or m[0] >= out[-1][1]:
            out.append(m)
    return out


def automaton(aliases: tuple[str, ...]):
    """All aliases in one automaton; what it finds is an alias's place."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, a in enumerate(aliases):
        made.add_word(a, k)
    made.make_automaton()
    return made


def matches_in(text: str | None, aliases: tuple[str, ...], made=None) -> list[Match]:
    """All whole-word matches (start, end, place of the alias) in a text, overlapping ones too; made: the aliases' automaton, where it is at hand."""
    if not text or not aliases:
        return []
    key, original = key_of(text)
    out = []
    for last, k in (made or automaton(aliases)).iter(key):
        first, end = last + 1 - len(aliases[k]), last + 1
        if not (first and _word(key[first - 1]) and _word(key[first])) and not (end < len(key) and _word(key[end]) and _word(key[end - 1])):
            out.append((original(first), original(last) + 1, k))
    return out


def registry(rows: DataFrame, entity_type: str, id: Column, name: Column, aliases: Column | None = None) -> DataFrame:
    """entity_type, canonical_id, canonical_name, alias of rows: the name and its aliases, a row each."""
    each = F.array(name) if aliases is None else F.concat(F.array(name), aliases)
    made = rows.select(F.lit(entity_type).alias("entity_type"), id.cast("string").alias("canonical_id"), name.alias("canonical_name"), F.explode(each).alias("alias"))
    return made.withColumn("alias", alias_key(F.col("alias"))).where("alias <> ''")


def entities(docs: DataFrame, key: str, text: str, registries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """key, entity_type, canonical_id, canonical_name, start, end, raw_value of every mention of an alias in docs.

    An alias of several entities of a type names the smallest id, as a registry's lookup does; of several types, one mention each. Null and blank texts have none."""
    spark = docs.sparkSession
    names = cut(registries.groupBy("entity_type", "alias").agg(F.min(F.struct("canonical_id", "canonical_name")).alias("e")).select("entity_type", "alias", "e.*"))
    found = [r.alias for r in names.select("alias").distinct().orderBy("alias").toLocalIterator()]  # aliases alone; in parts of limit below
    parts: list[list[str]] = [[]]
    size = 0
    for a in found:
        if size and size + len(a) > limit:
            parts.append([])
            size = 0
        parts[-1].append(a)
        size += len(a)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def finder(aliases: tuple[str, ...], whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = automaton(aliases) if aliases else None
            for b in batches:
                keys, out = [], []
                for n, t in enumerate(b["text"].to_pylist()):
                    got = matches_in(t, aliases, made)
                    for s, e, k in chosen(got) if whole else got:
                        keys.append(n)
                        out.append((s, e, aliases[k], t[s:e]))
                yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(keys, pa.int64())), *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]], ["key", "start", "end", "alias", "raw_value"])

        return run

    schema = f"key {kind}, start int, end int, alias string, raw_value string"
    if len(parts) == 1:
        hits = rows.mapInArrow(finder(tuple(parts[0]), True), schema)
    else:
        numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        each = [numbered.select(F.struct("row", "key").alias("key"), "text").mapInArrow(finder(tuple(p), False), f"key struct<row:bigint,key:{kind}>, start int, end int, alias string, raw_value string") for p in parts]
        hits = _choose(reduce(DataFrame.unionByName, each)).select("key.key", "start", "end", "alias", "raw_value")
    sent = hits.join(names, "alias")
    return sent.select(F.col("key").alias(key), "entity_type", "canonical_id", "canonical_name", "start", "end", "raw_value")


def _choose(hits: DataFrame) -> DataFrame:
    """Of the matches of each text (key), leftmost and longest; those of one text are one row, at most its number of words times the aliases that begin alike."""
    line = F.array_sort(F.collect_list(F.struct(F.col("start"), (-F.col("end")).alias("back"), "alias", "raw_value")))
    step = lambda out, m: F.when((F.size(out) == 0) | (m["start"] >= -F.element_at(out, -1)["back"]), F.concat(out, F.array(m))).otherwise(out)
    kind = "array<struct<start:int,back:int,alias:string,raw_value:string>>"
    picked = hits.groupBy("key").agg(line.alias("line")).withColumn("x", F.explode(F.aggregate("line", F.array().cast(kind), lambda out, m: F.when(F.size(out) == 0, F.array(m)).otherwise(step(out, m)))))
    return picked.select("key", "x.start", (-F.col("x.back")).alias("end"), "x.alias", "x.raw_value")
