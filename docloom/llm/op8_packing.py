"""Best-fit packing of token sequences by exact-complement hashing.

Pieces have at most SIZE tokens, so their lengths are summed up in a histogram of at most SIZE counts; only that goes to
the driver. There the gap that a piece leaves is looked up in an index of single, pair and triple sums of lengths, and
combinations that fill it exactly are consumed while counts last; what is left is packed best fit, longest first. That is
planned for each depth of sums, and the plan with the fewest sequences is kept, so it is never worse than best fit alone. The
plan says, for ranges of ranks among the pieces of one length, which sequence and offset they get; each piece finds its
place by its rank. Ranks are counted within salts of a length and shifted by the counts of the salts before, so that a
length that very many pieces share is ranked by many tasks.

Defined results: null or empty text: one piece, the end id alone. Repeated rows are packed each. Documents over SIZE
tokens are cut into full pieces, the first one taking the remainder. Sequence ids run from 0. Ties in rank go by doc_id,
piece and digest. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, stash, strings, table

SIZE = 1024
END = 2
#: Pieces of one length that one salt holds on average when all pieces have that length.
SALT_ROWS = 256
#: Salts of a length whose counts one task adds up.
UPPER = 4096

_TOKENIZERS: dict[str, Tokens] = {}


class Tokens:
    """A byte-level BPE tokenizer file. Where its merges come in the order of their ids, texts of Latin-1 characters without an
    added token go to a faster encoder of the same merges; all others, and other files, to the tokenizer itself."""

    #: The pre-tokenizer's pattern, a fixed value of this family of tokenizers.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [t["content"] for t in said.get("added_tokens", [])]
        pre, model = said.get("pre_tokenizer") or {}, said["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not said.get("normalizer")
        if plain and model.get("type") == "BPE" and not model.get("dropout"):
            import tiktoken

            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
            byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            made = [model["vocab"]["".join(m)] for m in merges]
            if made == sorted(made) and len(ranks) == 256 + len(made):
                self.fast = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self.fast and len(text.encode("latin-1", "ignore")) == len(text) and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit integers; null: none."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokens(path)
    return [_TOKENIZERS[path].encode(t or "") for t in texts]


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"].to_pylist(), token_bytes(strings(b["text"]), path), strict=True):
                ids += END.to_bytes(4, "little")
                n = len(ids) // 4
                first = n % SIZE or SIZE
                for k, at in enumerate([0, *range(first, n, SIZE)]):
                    end = first if k == 0 else at + SIZE
                    rows.append((doc, k, at, end - at, zlib.crc32(ids[4 * at : 4 * end])))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Sums:
    """Which single, pair and triple sums of lengths that are left there are: pairs by their sum, found once; triples by a length and a pair."""

    def __init__(self, left: np.ndarray):
        self.left = left
        there = np.flatnonzero(left).tolist()
        self.lengths, self.pairs = there[::-1], defaultdict(list)
        for k, b in enumerate(there):
            for c in there[: k + 1]:
                if b + c < len(left):
                    self.pairs[b + c].append((b, c))  # the longest last

    def of(self, gap: int, most: int, deep: int) -> Iterator[tuple[int, ...]]:
        """Combinations of 1 to deep lengths of at most most that fill a gap, those with the longest piece first; counts are checked by the taker."""
        if deep >= 1 and gap <= most and self.left[gap]:
            yield (gap,)
        if deep >= 2:
            for b, c in reversed(self.pairs.get(gap, ())):
                if b <= most and self.left[b] and self.left[c]:
                    yield b, c
        if deep >= 3:
            for b in self.lengths:
                if b <= min(most, gap - 2) and self.left[b] and 3 * b >= gap:
                    for c, d in reversed(self.pairs.get(gap - b, ())):
                        if c <= b and self.left[c] and self.left[d]:
                            yield b, c, d


def filled(counts: dict[int, int], size: int, deep: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan that first fills gaps exactly by up to deep further pieces, then packs what is left best fit, longest first."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        n = min(left[x] // lengths.count(x) for x in lengths)
        if n > 0:
            for x in lengths:
                left[x] -= n
            out.append((lengths, int(n)))

    take(size)
    sums = Sums(left)
    for depth in range(1, deep + 1):  # all single fills first: they use the longest pieces
        for a in range(size - 1, 0, -1):
            if left[a]:
                for rest in sums.of(size - a, a, depth):
                    if len(rest) == depth:
                        take(a, *rest)
                    if not left[a]:
                        break
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # gap: patterns and how many
    for length in range(size, 0, -1):
        n = int(left[length])
        for gap in range(length, size + 1):
            while n and bins.get(gap):
                pattern, k = bins[gap].pop()
                each = min(gap // length, n)
                used = min(k, n // each)
                if used < k:
                    bins[gap].append((pattern, k - used))
                bins[gap - each * length].append((pattern + (length,) * each, used))
                n -= used * each
        each = size // length
        if n >= each:
            bins[size - each * length].append(((length,) * each, n // each))
        if n % each:
            bins[size - n % each * length].append(((length,) * (n % each), 1))
    return out + [p for ps in bins.values() for p in ps]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths (longest first) and how many sequences have each; every piece of counts is used once.

    Exact fills by many short pieces may leave long ones without company, so fills by up to three, two, one and no further
    pieces are all planned on the histogram, and the one with the fewest sequences is taken, of equals the deepest."""
    return min((filled(counts, size, deep) for deep in (3, 2, 1, 0)), key=lambda p: sum(n for _, n in p))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows of first rank, pieces a sequence, first sequence, first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, n in patterns:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows[length].append((rank[length], each, base, at))
            rank[length] += each * n
            at += each * length
        base += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    kept = stash(pieces(docs, path), "pieces")
    counts = {r.length: r.n for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most SIZE rows
    place = slots(plan(counts))
    salts = max(1, -(-sum(counts.values()) // SALT_ROWS))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # counts of the salts before in two steps, so that no task has all salts of a length
    before = before.withColumn("upper", F.floor(F.col("salt") / UPPER))
    uppers = before.groupBy("length", "upper").agg(F.sum("n").alias("n")).select("length", "upper", (F.sum("n").over(Window.partitionBy("length").orderBy("upper")) - F.col("n")).alias("far"))
    before = before.join(uppers, ["length", "upper"]).select("length", "salt", (F.col("far") + F.sum("n").over(Window.partitionBy("length", "upper").orderBy("salt")) - F.col("n")).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("ahead")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                rows = place[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                seq[at] = row[:, 2] + nth // row[:, 1]
                off[at] = row[:, 3] + nth % row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
