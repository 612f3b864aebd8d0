"""Language ID by language-bitmask n-gram filters.

Each slot of a Bloom filter holds one bit per language, so one lookup (the AND of a few slots) returns all languages that
contain an n-gram. A text's popcounts per language, corrected for the filter's false positives, decide.

Training gathers the counts of all n-grams of all labelled training texts. An n-gram enters the filter of a language when
it makes up at least MIN_RATE of that language's n-grams, and its share there is at least RATIO of its largest share in
any language. So a language has at most 1 / MIN_RATE n-grams, and the filter that goes to the executors is bounded by
that, whatever the size of the corpus.

Defined results: null text, empty text or no letter: ``und`` and 0. No training language: ``und`` and 0 everywhere. A text
with letters whose n-grams are in no filter: the first language by code point, and 0.
Ties go to the first language by code point. Repeated rows are counted and answered each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, mixed, stash, strings, table

N = 4
MIN_RATE = 1e-5
RATIO = 0.34
HASHES = 3
SLOTS_PER_GRAM = 16
#: n-grams that a task counts at once before it hands on what it has.
FLUSH = 3_000_000

_FOLD: list[np.ndarray] = []


def fold() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter."""
    if not _FOLD:
        to = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                to[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(to)
    return _FOLD[0]


def grams(text: str | None, n: int = N) -> np.ndarray:
    """Hashes of the n-grams of the folded text, with one space at either end; empty if it has no letter."""
    codes = fold()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    letters = codes != 32
    if not letters.any():
        return np.zeros(0, np.uint64)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    codes = codes[keep]
    parts = [np.full(1, 32, np.uint32)] * int(codes[0] != 32) + [codes] + [np.full(1, 32, np.uint32)] * int(codes[-1] != 32)
    codes = np.concatenate([*parts, np.full(max(0, n - sum(map(len, parts))), 32, np.uint32)]).astype(np.uint64)
    out = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
    return mixed(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for b in batches:
        for text, lang in zip(strings(b["text"]), strings(b["lang"]), strict=True):
            if len(g := grams(text)):
                held.setdefault(lang, []).append(g)
                size += len(g)
                if size >= FLUSH:
                    yield from out()
                    size = 0
    yield from out()


class Filters:
    """Bloom filters of all languages in one array: bit b of plane p of a slot belongs to language 64 p + b."""

    def __init__(self, langs: list[str], gram: np.ndarray, lang_of: np.ndarray):
        self.langs = langs
        self.slots = 1 << int(max(1024, SLOTS_PER_GRAM * len(gram))).bit_length()
        planes = -(-len(langs) // 64)
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        self.bits = np.zeros((planes, self.slots), kind)
        for at in self.places(gram):
            np.bitwise_or.at(self.bits, (lang_of // 64, at), np.left_shift(np.ones(len(gram), np.uint64), (lang_of % 64).astype(np.uint64)).astype(kind))
        fill = np.array([((self.bits[k // 64] >> kind(k % 64)) & kind(1)).mean() for k in range(len(langs))])
        self.false = fill**HASHES

    def places(self, gram: np.ndarray) -> list[np.ndarray]:
        step = (gram >> np.uint64(32)) | np.uint64(1)
        return [((gram + np.uint64(k) * step) & np.uint64(self.slots - 1)).astype(np.int64) for k in range(HASHES)]

    def shares(self, gram: np.ndarray) -> np.ndarray:
        """Per language, the share of the n-grams that it contains, corrected for false positives."""
        first, *rest = self.places(gram)
        masks = self.bits[:, first]
        for at in rest:
            masks = masks & self.bits[:, at]
        one = self.bits.dtype.type(1)
        hits = np.array([np.count_nonzero(masks[k // 64] & (one << self.bits.dtype.type(k % 64))) for k in range(len(self.langs))])
        return np.clip((hits / len(gram) - self.false) / (1 - self.false), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        g = grams(text)
        if not len(g) or not self.langs:
            return "und", 0.0
        share = self.shares(g)
        best = int(share.argmax())
        total = float(share.sum())
        return self.langs[best], float(share[best]) / total if total > 0 else 0.0


def train(docs: DataFrame) -> Filters:
    """Filters from the columns text and lang of docs. The driver receives at most 1 / MIN_RATE rows a language."""
    counted = map_batches(docs.where("lang is not null and text is not null").select("text", "lang"), _count, "lang string, gram long, n long")
    counted = stash(counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")  # read twice: the texts are counted once
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    sums = {r.lang: r.total for r in total.collect()}  # one row a language
    langs = sorted(sums)
    if not langs:
        return Filters([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rate = F.col("n") / F.create_map(*[F.lit(x) for kv in sums.items() for x in kv])[F.col("lang")]
    rows = counted.withColumn("rate", rate).where(F.col("rate") >= MIN_RATE).groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("of"), F.max("rate").alias("top"))
    kept = rows.select("gram", F.explode("of").alias("x"), "top").where(F.col("x.rate") >= RATIO * F.col("top")).select("gram", "x.lang").toPandas()
    at = {x: k for k, x in enumerate(langs)}
    return Filters(langs, kept["gram"].to_numpy(np.int64).view(np.uint64), kept["lang"].map(at).to_numpy(np.int64))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs (doc_id, text) with lang_pred and score; the score is the best language's part of all languages' shares."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for b in batches:
            got = [f.decide(t) for t in strings(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    out = identify(docs, filters)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
