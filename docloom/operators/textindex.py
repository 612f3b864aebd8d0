"""A stored positional index for full text: postings by lexeme and block, asked without reading a text.

Documents are taken in runs of at most BLOCK rows; a run is a block, and each of its lexemes one row of postings: the rows and
keys that hold it, its positions in each, and the most often that one row has it (the block's maximum). So a frequent lexeme is
many rows, one a block. Postings are bucketed by ``cell``, a number made of the lexeme and one of a few slices of the blocks: a
lexeme's postings lie in one cell a slice, and slices grow in number with the documents, so no bucket has all postings
of a frequent lexeme. A query reads the cells of its lexemes only: Spark prunes the other buckets. A lexeme "" lists each
block's rows, for queries that only exclude.

A query for the best k first reads block maxima, which bound every score in a block: 0.1 for each occurrence of a lexeme that it
requires. The k blocks of the highest bounds are scored, and their k-th best score is a threshold; of the others only blocks whose
bound reaches it are read with their positions. Blocks without the lexemes that an alternative requires are left out before
that. Rows and scores are those of ``fulltext.search``.

The index is a versioned store: appending adds a generation, removing notes keys whose rows of earlier generations no longer
count, merging writes all generations as one; a reader keeps the version that it has opened. Repeated keys are rows of
their own; null keys and null or blank texts are rows without lexemes or as any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fulltext
from .versions import Store

BLOCK = 128
#: Tokens after which a block ends early.
TOKENS = 1 << 20
#: Documents that share a slice, and buckets that a slice adds.
SLICE, BUCKETS = 1 << 21, 16
#: Bits of a block's number that count within a task of the build.
WITHIN = 32


class TextIndex:
    """The index of a folder, at its latest version when opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        self._open()

    def _open(self) -> TextIndex:
        self.snap = self.store.snapshot()
        scopes = self.snap.folders.get("postings", {})
        self.shape = {s: tuple(map(int, s.split("-"))) for s in scopes}  # scope: version, slices, buckets
        self.scans = {s: self.store.read_buckets("postings", (n, "cell"), self.snap, s)[0] for s, (_, _, n) in self.shape.items()}
        return self

    # writing

    def append(self, docs: DataFrame, key: str, text: str) -> TextIndex:
        """docs (key, text) as a generation of its own."""
        w = self.store.begin()
        version, slices = w.base.version + 1, 1 + docs.count() // SLICE
        self._write(w, _postings(docs, key, text).withColumn("generation", F.lit(version).cast("long")), version, slices)
        w.commit()
        return self._open()

    def remove(self, keys: DataFrame, key: str) -> TextIndex:
        """Rows of these keys in generations so far no longer count."""
        w = self.store.begin()
        w.append("removed", keys.select(F.col(key).alias("key"), F.lit(w.base.version).cast("long").alias("up_to")).distinct()).commit()
        return self._open()

    def merge(self) -> TextIndex:
        """All generations as one; blocks stay as they are."""
        w = self.store.begin()
        slices = sum(s for _, s, _ in self.shape.values())
        rows = reduce(DataFrame.unionByName, self.scans.values()).drop("cell")
        for scope in self.shape:
            w.drop("postings", scope)
        self._write(w, rows, w.base.version + 1, slices)
        w.commit()
        return self._open()

    @staticmethod
    def _write(w, rows: DataFrame, version: int, slices: int) -> None:
        n = BUCKETS * slices
        name = F.concat_ws(":", "lexeme", F.pmod(F.xxhash64("generation", "block"), F.lit(slices)).cast("string"))
        celled = rows.withColumn("cell", F.crc32(name.cast("binary"))).repartition(n, "cell").sortWithinPartitions("cell", "lexeme", "block")
        w.append("postings", celled, f"{version}-{slices}-{n}", (n, "cell"))

    # asking

    def postings(self, lexemes: list[str]) -> DataFrame:
        """The postings of some lexemes: a scan of their cells, of no text."""
        parts = []
        for scope, scan in self.scans.items():
            cells = [zlib.crc32(f"{w}:{s}".encode()) for w in lexemes for s in range(self.shape[scope][1])]
            parts.append(scan.where(F.col("cell").isin(cells) & F.col("lexeme").isin(lexemes)))
        return reduce(DataFrame.unionByName, parts)

    def search(self, query: str, limit: int | None = 50) -> DataFrame:
        """key and score of the rows that match, the best limit of them (None: all); ties go to the smallest key."""
        parsed = fulltext.parse(query)
        if not self.scans:
            raise ValueError("nothing has been indexed")
        named = sorted({w for yes, no in parsed for p in yes + no for _, w in p} | ({""} if any(not yes for yes, _ in parsed) else set()))
        if not named:
            first = next(iter(self.scans.values()))
            return first.select(F.col("keys")[0].alias("key"), F.lit(0.0).alias("score")).where("false")
        rows = self.postings(named)
        blocks = self._candidates(rows, parsed)
        if limit is None:
            return self._scored(rows, blocks, query)
        best = [F.desc("score"), F.col("key").asc_nulls_first()]
        first = blocks.orderBy(F.desc("bound"), "generation", "block").limit(limit).collect()  # at most limit rows
        if not first:
            return self._scored(rows, blocks, query).limit(limit)
        at = F.struct("generation", "block")
        mine = at.isin([F.struct(F.lit(r.generation).alias("generation"), F.lit(r.block).alias("block")) for r in first])
        top = self._scored(rows.where(F.col("block").isin([r.block for r in first]) & mine), None, query).orderBy(*best).limit(limit)
        if len(first) < limit:
            return top
        found = top.collect()  # at most limit rows
        least = found[-1].score if len(found) == limit else 0.0
        rest = self._scored(rows, blocks.where(~mine & (F.col("bound") + 1e-9 >= least)), query)
        return self.spark.createDataFrame(found, top.schema).unionByName(rest).orderBy(*best).limit(limit)

    def _candidates(self, rows: DataFrame, parsed: fulltext.Query) -> DataFrame:
        """generation, block and the bound of scores in it, for blocks that hold all that some alternative requires."""
        required = {w for yes, _ in parsed for p in yes for _, w in p}
        there = F.collect_set("lexeme")
        sums = rows.groupBy("generation", "block").agg(there.alias("there"), (F.sum(F.when(F.col("lexeme").isin(sorted(required)), F.col("most")).otherwise(0)) * 0.1).alias("bound"))
        holds = [reduce(lambda a, b: a & b, [F.array_contains("there", w) for p in yes for _, w in p], F.lit(True)) for yes, _ in parsed]
        return sums.where(reduce(lambda a, b: a | b, holds)).drop("there")

    def _scored(self, rows: DataFrame, blocks: DataFrame | None, query: str) -> DataFrame:
        """key and score of the matching rows of blocks (None: all that rows has)."""
        if blocks is not None:
            rows = rows.join(blocks.select("generation", "block"), ["generation", "block"], "left_semi")
        one = F.collect_list(F.struct("lexeme", "local", "keys", "positions"))  # a block's postings of the query's lexemes
        kind = rows.schema["keys"].dataType.elementType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parsed = fulltext.parse(query)
            for b in batches:
                keys, scores = [], []
                for block in b["postings"].to_pylist():
                    of: dict[int, tuple[object, dict[str, list[int]]]] = {}
                    for p in block:
                        for k, key, places in zip(p["local"], p["keys"], p["positions"], strict=True):
                            at = of.setdefault(k, (key, {}))[1]
                            if places:
                                at[p["lexeme"]] = places
                    for key, at in of.values():
                        score = fulltext.rank_at(at, parsed)
                        if score is not None:
                            keys.append(key)
                            scores.append(round(score, 9))
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("postings").type.value_type.field("keys").type.value_type), pa.array(scores, pa.float64())], ["key", "score"])

        alive = self._alive(rows) if "removed" in self.snap.schemas else rows
        return alive.groupBy("generation", "block").agg(one.alias("postings")).select("postings").mapInArrow(run, f"key {kind}, score double")

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows without the entries of keys that were removed since their generation."""
        each = rows.withColumn("x", F.explode(F.arrays_zip("local", "keys", "positions"))).select("generation", "block", "lexeme", "x.*")
        gone = self.store.read("removed", self.snap).groupBy("key").agg(F.max("up_to").alias("up_to"))
        left = each.join(gone, (F.col("keys") == F.col("key")) & (F.col("generation") <= F.col("up_to")), "left_anti")
        return left.groupBy("generation", "block", "lexeme").agg(F.sort_array(F.collect_list(F.struct("local", "keys", "positions"))).alias("x")).select("generation", "block", "lexeme", "x.local", "x.keys", "x.positions")


def _postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """lexeme, block, local, keys, positions, most: a row a lexeme and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, tokens = TaskContext.get().partitionId() << WITHIN, [], 0

        def made(kind: pa.DataType) -> pa.RecordBatch:
            # all tokens of the block as arrays, by lexeme, then in the order of the texts; "" is the first lexeme, in every row
            ids: dict[str, int] = {"": 0}
            lexeme = np.fromiter((ids.setdefault(w, len(ids)) for _, lexemes in held for _, w in lexemes), np.int64)
            place = np.fromiter((p for _, lexemes in held for p, _ in lexemes), np.int32)
            row = np.repeat(np.arange(len(held), dtype=np.int32), [len(lexemes) for _, lexemes in held])
            order = np.argsort(lexeme, kind="stable")
            lexeme, place, row = lexeme[order], place[order], row[order]
            first = np.flatnonzero((np.diff(lexeme, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            sizes = np.concatenate((np.zeros(len(held), np.int64), np.diff(first, append=len(lexeme))))
            local = np.concatenate((np.arange(len(held), dtype=np.int32), row[first]))
            rows = np.bincount(lexeme[first], minlength=len(ids))
            rows[0] = len(held)
            ends, places = (np.concatenate(([0], np.cumsum(x))).astype(np.int32) for x in (rows, sizes))
            lists = lambda at, of: pa.ListArray.from_arrays(pa.array(at), of)
            keys = pa.array([k for k, _ in held], kind).take(pa.array(local))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(ids), pa.string()), pa.array(np.full(len(ids), block)), lists(ends, pa.array(local)), lists(ends, keys), lists(ends, lists(places, pa.array(place))), pa.array(np.maximum.reduceat(sizes, ends[:-1]).astype(np.int32))],
                ["lexeme", "block", "local", "keys", "positions", "most"],
            )

        for b in batches:
            kind = b.schema.types[0]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((doc, fulltext.lexemes_of(t)))
                tokens += len(held[-1][1])
                if len(held) == BLOCK or tokens >= TOKENS:
                    yield made(kind)
                    block, held, tokens = block + 1, [], 0
        if held:
            yield made(kind)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"lexeme string, block long, local array<int>, keys array<{kind}>, positions array<array<int>>, most int")
