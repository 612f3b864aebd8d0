"""Language-model scores from an Elias-Fano n-gram trie.

A model of order 2 or 3 that weighs the evidence of each order; of order 3:

    P(w | u, v) = (n(u, v, w) + A * n(v, w) + B * P(w)) / (n(u, v) + A * n(v) + B),   P(w) = (n(w) + ALPHA) / (N + ALPHA * (V + 1))

and of order 2, the default: P(w | v) = (n(v, w) + B2 * P(w)) / (n(v) + B2). Both sum to one over the V known tokens and one
unknown. Starts stand before each text; after unknown words less evidence is left, none at last. log P splits into a
numerator, of which all counts end in w, and a denominator, of which all end in v. So one trie that is keyed from the last
word backwards serves both: w, below it the words before, below those the words before them. An occurrence of w asks for its
own numerator and for the denominator of the token that follows.

Four steps, none of which sends a table of the corpus anywhere:

1. Tokens are counted map-side and summed by shards: N, V. Each task also names the words that make up at least HOT / 2 of
   what it holds, so every word of a rate of HOT or more is named; at most 2 / HOT go on with their counts, a proven bound.
   (Of order 3, also pairs and triples, whose counts take another reading of the texts.)
2. Distinct n-grams with counts go to shards by w, those of hot words by (v, w) (hot pairs by (u, v, w)), so no shard gets more
   than about HOT of the corpus by one key. A shard builds its trie, which is written once to shared storage, a bucket a shard.
3. Distinct n-grams of all texts go to the shards as questions; the tries stay where they are.
4. Answers return to the part of the texts that asked, in its order, and are summed by document.

Keys of a level are monotone within a node and pointers to children monotone overall, so both are Elias-Fano coded;
numerators and denominators are quantised to 16 bits. A task maps the levels of its trie from a scratch file that ends with
it, and finds a child by successor search between its parent's pointers. All counts are of all training texts; no n-gram is
dropped, whatever its rate.

Defined results: null text is empty: one token, the end. A null doc_id is neither held out nor learnt from. Without
training texts N and V are 0. Repeated rows are counted and answered each. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, crc_mod, lowered, map_batches, mixed, reach_workers, shard_ids, span_hashes, stash, strings, table, width

ALPHA = 0.1
#: Weights of the lower orders by held-out likelihood, for triples and for pairs; the longest n-grams of the model.
A, B, B2 = 0.01, 20.0, 200.0
ORDER = 2
#: The rate from which an n-gram counts as hot; it only decides where counts are held.
HOT = 2.5e-4
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Tokens that a task holds before it hands them on.
FLUSH = 2_000_000
LOWEST, HIGHEST, LEVELS = -16.0, 12.0, 65535


class EliasFano:
    """A monotone sequence: low parts in whole bytes, high parts in unary, with a directory of ones for every 64 bits."""

    PARTS = ("low", "high", "ahead")

    def __init__(self, values: np.ndarray, universe: int):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        self.l = min(56, -(-(max(1, universe // max(1, n)).bit_length() - 1) // 8) * 8)
        self.low = np.ascontiguousarray(values.view(np.uint8).reshape(n, 8)[:, : self.l // 8].T).reshape(-1)
        ones = (values >> np.uint64(self.l)).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) if n else 0) // 64 + 2
        flags = np.zeros(size * 64, np.uint8)
        flags[ones] = 1
        self.high = np.packbits(flags, bitorder="little").view(np.uint64)
        self.ahead = np.concatenate(([0], np.cumsum(np.bitwise_count(self.high)))).astype(np.uint32)

    def _joined(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        out = high.astype(np.uint64) << np.uint64(self.l)
        for k in range(self.l // 8):
            out |= self.low[i + k * self.n].astype(np.uint64) << np.uint64(8 * k)
        return out

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ahead, i, "right") - 1
        left = (i - self.ahead[word]).astype(np.int64)
        bits, place = self.high[word], np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= n
            left = np.where(up, left - n, left)
            place += np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), bits)
        return self._joined(word * 64 + place - i, i)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        i = np.arange(self.n)
        return self._joined(np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n] - i, i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below the given ones: the ones before that many zeros."""
        zeros = np.arange(len(self.ahead)) * 64 - self.ahead
        j = np.minimum(high, zeros[-1]) - 1
        word = np.maximum(np.searchsorted(zeros, j, "right") - 1, 0)
        left = j - zeros[word]
        bits, place = ~self.high[np.minimum(word, len(self.high) - 1)], np.zeros(len(j), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= n
            left = np.where(up, left - n, left)
            place += np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), bits)
        return np.where(j < 0, 0, word * 64 + place - j)

    def successor(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in [start, end) with a value of at least x; end if there is none. The high part leads to a short run."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.l)).astype(np.int64)
        lo = np.clip(self._below(high), start, end).astype(np.int64)
        hi = np.clip(self._below(high + 1), start, end).astype(np.int64)
        low = x & np.uint64((1 << self.l) - 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._joined(np.zeros(len(mid), np.uint64), mid) < low[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo


def quantised(x: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(x, LOWEST, HIGHEST) - LOWEST) / (HIGHEST - LOWEST) * LEVELS).astype(np.uint16)


def loosened(q: np.ndarray) -> np.ndarray:
    return q / LEVELS * (HIGHEST - LOWEST) + LOWEST


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(v) + w)


def triple_key(u: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return mixed(mixed(u ^ np.uint64(0xA0761D6478BD642F)) + pair)


class Counts:
    """Sorted keys with counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], -1)


class Model:
    """What all tasks know: N, V, the number of training texts, and the exact counts of hot n-grams by order."""

    def __init__(self, order: int, n: int, v: int, texts: int, hot: list[Counts], shards: list[int]):
        self.order, self.n, self.v, self.texts, self.hot, self.shards = order, n, v, texts, hot, shards
        self.total = n + ALPHA * (v + 1)
        self.a, self.b = (A, B) if order == 3 else (0.0, B2)

    def p(self, count: np.ndarray) -> np.ndarray:
        return (count + ALPHA) / self.total

    def num(self, low: np.ndarray, two: np.ndarray, three: np.ndarray | int = 0) -> np.ndarray:
        """Logarithms of numerators: low is b * P(w), two and three the counts of the last two and of all three."""
        return np.log10(low + (self.a * two + three if self.order == 3 else two))

    def den(self, one: np.ndarray, two: np.ndarray | int) -> np.ndarray:
        """Logarithms of denominators of what follows: one and two count its last word, and its last two."""
        return np.log10((self.a * one + two if self.order == 3 else one) + self.b)

    def routed(self, names: np.ndarray, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The shard of each n-gram: by its word; if that is hot, by its last two; if those are, by all three."""
        route = mixed(names)[w]
        hot = np.flatnonzero((self.hot[0].get(names) >= 0)[w])
        pair = pair_key(names[v[hot]], names[w[hot]])
        route[hot] = mixed(pair)
        if self.order == 3:
            of = self.hot[1].get(pair) >= 0
            route[hot[of]] = mixed(triple_key(names[u[hot[of]]], pair[of]))
        shard = (route >> np.uint64(32)) * np.uint64(len(self.shards)) >> np.uint64(32)
        return shard.astype(np.uint16 if len(self.shards) < 1 << 16 else np.int64)


class Trie:
    """The n-grams of a shard. names: all its words; then levels of words, words before them, and words before those."""

    LEVELS_OF = ("names", "words", "first2", "keys2", "first3", "keys3")
    VALUES = ("count", "num2", "den2", "num3")

    def __init__(self, names: np.ndarray, w: np.ndarray, v: np.ndarray, u: np.ndarray, n: np.ndarray, model: Model):
        """names sorted; w, v, u their numbers, n counts, sorted by (w, v, u) without repeats."""
        step = len(names)
        words, top = np.unique(w, return_inverse=True)
        pair = first_of(w, v)
        owner = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(w))))
        count = np.bincount(top, n, len(words)).astype(np.int64)
        known = model.hot[0].get(names[words])
        count = np.where(known >= 0, known, count)
        count2 = np.bincount(owner, n, len(pair)).astype(np.int64)
        known = model.hot[1].get(pair_key(names[v[pair]], names[w[pair]]))
        count2 = np.where(known >= 0, known, count2)
        up = top[pair]
        low = model.b * model.p(count)
        self.step = step
        self.names = EliasFano(names, 1 << 64)
        self.words = EliasFano(words, step + 1)
        self.first2 = EliasFano(np.searchsorted(up, np.arange(len(words) + 1)), len(pair) + 1)
        self.keys2 = EliasFano(up.astype(np.uint64) * np.uint64(step) + v[pair].astype(np.uint64), max(1, len(words)) * step)
        self.count = count.astype(np.uint64)
        self.num2 = quantised(model.num(low[up], count2))
        if model.order == 2:
            pair, owner, u, top, n = pair[:0], owner[:0], u[:0], top[:0], n[:0]
        self.den2 = quantised(model.den(count[up], count2)) if model.order == 3 else np.zeros(0, np.uint16)
        self.first3 = EliasFano(np.append(pair, len(u)), len(u) + 1)
        self.keys3 = EliasFano(owner.astype(np.uint64) * np.uint64(step) + u.astype(np.uint64), max(1, len(pair)) * step)
        self.num3 = quantised(model.num(low[top], count2[owner], n))

    def to_bytes(self) -> bytes:
        said, blobs, at = {"step": self.step}, [], 0
        for o, names in [(getattr(self, k), EliasFano.PARTS) for k in self.LEVELS_OF] + [(self, self.VALUES)]:
            said.setdefault("levels", []).append([o.n, o.l] if o is not self else [])
            for k in names:
                a = getattr(o, k)
                said.setdefault("at", []).append([at, a.dtype.str, len(a)])
                blob = a.tobytes()
                blobs += [blob, bytes(-len(blob) % 8)]
                at += len(blob) + -len(blob) % 8
        head = json.dumps(said).encode()
        head += b" " * (-(len(head) + 8) % 8)
        return len(head).to_bytes(8, "little") + head + b"".join(blobs)

    @classmethod
    def mapped(cls, blob: bytes) -> Trie:
        """The trie with its levels mapped from a scratch file without a name."""
        self, size = cls.__new__(cls), int.from_bytes(blob[:8], "little")
        said = json.loads(bytes(blob[8 : 8 + size]))
        self.file, self.step = tempfile.TemporaryFile(), said["step"]
        self.file.write(blob)
        self.file.flush()
        spots = iter(said["at"])

        def fill(o: object, names: tuple) -> None:
            for k in names:
                at, kind, n = next(spots)
                setattr(o, k, np.memmap(self.file, kind, "r", 8 + size + at, (n,)) if n else np.zeros(0, kind))

        for k, (n, low) in zip(self.LEVELS_OF, said["levels"], strict=False):
            level = EliasFano.__new__(EliasFano)
            level.n, level.l = n, low
            fill(level, EliasFano.PARTS)
            setattr(self, k, level)
        fill(self, self.VALUES)
        self.name, self.word = self.names.all(), self.words.all()  # looked up by many: decoded once
        return self

    @staticmethod
    def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(sorted_, x), max(0, len(sorted_) - 1))
        return np.where(sorted_[at] == x, at, -1) if len(sorted_) else np.full(len(x), -1)

    def ids(self, names: np.ndarray) -> np.ndarray:
        """The numbers of names, -1 where there is none."""
        return self._find(self.name, names)

    def nodes(self, w: np.ndarray) -> np.ndarray:
        """The nodes of word numbers."""
        return np.where(w >= 0, self._find(self.word, np.maximum(w, 0).astype(np.uint64)), -1)

    def child(self, level: str, node: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The children of nodes for context numbers, -1 where there is none, by successor search between two pointers."""
        out = np.full(len(node), -1)
        at = np.flatnonzero((node >= 0) & (context >= 0))
        first, keys = (self.first2, self.keys2) if level == "2" else (self.first3, self.keys3)
        lo, hi = first.at(node[at]).astype(np.int64), first.at(node[at] + 1).astype(np.int64)
        key = node[at].astype(np.uint64) * np.uint64(self.step) + context[at].astype(np.uint64)
        found = keys.successor(key, lo, hi)
        there = found < hi
        there[there] = keys.at(found[there]) == key[there]
        out[at[there]] = found[there]
        return out


def ask(trie: Trie | None, model: Model, names: np.ndarray, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of words, and quantised numerators and denominators, of n-grams sorted by (w, v, u), given by numbers into names."""
    c = np.zeros(len(names), np.int64)
    if trie:
        ids = trie.ids(names)
        node = trie.nodes(ids)
        c[node >= 0] = trie.count[node[node >= 0]]
    hot = model.hot[0].get(names)
    c = np.where(hot >= 0, hot, c)
    pair = first_of(w, v)
    owner = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(w))))
    pw, pv = w[pair], v[pair]
    low = model.b * model.p(c[pw])
    num, den = quantised(np.log10(low)), quantised(model.den(c[pw], 0))
    known = model.hot[1].get(pair_key(names[pv], names[pw]))
    of = known >= 0
    num[of], den[of] = quantised(model.num(low[of], known[of])), quantised(model.den(c[pw[of]], known[of]))
    if not trie:
        return c[w], num[owner], den[owner]
    node2 = trie.child("2", node[pw], ids[pv])
    there = node2 >= 0
    num[there] = trie.num2[node2[there]]
    if model.order == 2:
        return c[w], num, den  # the n-grams are pairs
    den[there] = trie.den2[node2[there]]
    num, den = num[owner], den[owner]
    node3 = trie.child("3", node2[owner], ids[u])
    there = node3 >= 0
    num[there] = trie.num3[node3[there]]
    return c[w], num, den


class Part:
    """Texts as numbers of words."""

    def __init__(self, order: int):
        self.order, self.index, self.held, self.size = order, defaultdict(itertools.count().__next__), [], 0
        self.start, self.end = self.index[0], self.index[1]  # words are bytes

    def add(self, text: str | None) -> None:
        words = lowered(text or "").split()
        ids = np.fromiter(itertools.chain(map(self.index.__getitem__, words), (self.end,)), np.int32, len(words) + 1)
        self.held.append(ids)
        self.size += len(ids)

    def grams(self) -> tuple[np.ndarray, ...]:
        """The sorted hashes of all words; the numbers in them of the tokens, of the ones before and of those before them (the
        start for all in a model of pairs); tokens of each text."""
        words = list(self.index)[2:]
        data, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        names = np.concatenate((np.array([START, END]), span_hashes(data, ends - size, ends))) if words else np.array([START, END])
        order = np.argsort(names)
        rank = np.empty(len(names), np.int32)
        rank[order] = np.arange(len(names))
        n = np.array([len(x) for x in self.held], np.int64)
        w = rank[np.concatenate(self.held)]
        first = np.cumsum(n) - n
        v = np.concatenate((rank[:1], w[:-1]))
        v[first] = rank[0]
        if self.order == 2:
            u = np.full(len(w), rank[0])
        else:
            u = np.concatenate((rank[:1], v[:-1]))
            u[first] = rank[0]
        return names[order], w, v, u, n


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first ones first, which compress better so."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind: type, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    a = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
    return np.ascontiguousarray(a).view(kind).reshape(n), at + n * size


def packed(names: np.ndarray, w: np.ndarray, v: np.ndarray, u: np.ndarray, n: np.ndarray | None = None) -> bytes:
    """N-grams (numbers into names) sorted by (w, v, u), with counts or without, and the names that they use."""
    there = np.zeros(len(names), bool)
    for x in (w, v, u):
        there[x] = True
    to = np.cumsum(there, dtype=np.uint32) - np.uint32(1)
    used = names[there]
    parts = [np.array([len(used), len(w)], np.int64).tobytes(), _planes(np.diff(used, prepend=np.uint64(0)))]
    parts += [_planes(x) for x in (np.diff(to[w], prepend=np.uint32(0)), to[v], to[u])]
    parts += [_planes(n.astype(np.uint32))] if n is not None else []
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes, counts: bool) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    m, k = np.frombuffer(raw, np.int64, 2).tolist()
    steps, at = _unplaned(raw, np.uint64, m, 16)
    out = [np.cumsum(steps, dtype=np.uint64)]
    for j in range(3 + counts):
        x, at = _unplaned(raw, np.uint32, k, at)
        out.append(np.cumsum(x, dtype=np.int64) if j == 0 else x.astype(np.int64))
    return tuple(out)


def sorted_grams(w: np.ndarray, v: np.ndarray, u: np.ndarray, m: int, order: int, extra: np.ndarray | None = None, most: int = 1) -> tuple[np.ndarray, ...]:
    """N-grams (numbers below m) sorted by (w, v, u) and extra (below most), which is the last of the columns that return. One
    sort of one number each where these fit 64 bits."""
    extra = np.zeros(len(w), np.uint64) if extra is None else extra.astype(np.uint64)
    w, v = w.astype(np.uint64), v.astype(np.uint64)
    big, size, none = np.uint64(m), np.uint64(most), u[:1]
    if order == 2 and m * m * most < 1 << 64:
        pair, extra = np.divmod(np.sort((w * big + v) * size + extra), size)
        w, v = np.divmod(pair, big)
        u = np.repeat(none, len(w))
    elif most == 1 and m**3 < 1 << 64:
        pair, u = np.divmod(np.sort((w * big + v) * big + u.astype(np.uint64)), big)
        w, v = np.divmod(pair, big)
    else:
        by = np.lexsort((extra, u, v, w))
        w, v, u, extra = w[by], v[by], u[by], extra[by]
    return w.astype(np.int64), v.astype(np.int64), u.astype(np.int64), extra


def first_of(*columns: np.ndarray) -> np.ndarray:
    """Where a new value starts in sorted columns."""
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new)) if len(columns[0]) else np.zeros(0, np.int64)


def _flushed(batches: Iterator[pa.RecordBatch], order: int, only_training: bool, f, end=lambda: ()) -> Iterator[pa.RecordBatch]:
    """f(ids, train, part) for every FLUSH tokens or so, and end() at last."""
    ids, train, part = [], [], Part(order)
    for b in batches:
        for doc, text, learnt in zip(b["doc_id"].to_pylist(), strings(b["text"]), b["train"].to_pylist(), strict=True):
            if only_training and not learnt:
                continue
            ids.append(doc)
            train.append(bool(learnt))
            part.add(text)
            if part.size >= FLUSH:
                yield from f(ids, train, part)
                ids, train, part = [], [], Part(order)
    if ids:
        yield from f(ids, train, part)
    yield from end()


def _rows(kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def _count(order: int, shards: int):
    """Rows (shard, level, keys, counts): words at level 0, hot n-grams of what a task holds at 1 to 3."""
    kinds = [("shard", pa.int32()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]

    def out(_: list, __: list, part: Part) -> Iterator[pa.RecordBatch]:
        names, w, v, u, _n = part.grams()
        n = np.bincount(w, minlength=len(names))
        h, n1 = names[n > 0], n[n > 0]
        least = HOT / 2 * len(w)
        named = [(0, h, n1), (1, h[n1 >= least], n1[n1 >= least])]
        if order == 3:
            hot = np.flatnonzero((n >= least)[w])
            k2, of2, n2 = np.unique(pair_key(names[v[hot]], names[w[hot]]), return_inverse=True, return_counts=True)
            hot3 = (n2 >= least)[of2]
            k3, n3 = np.unique(triple_key(names[u[hot[hot3]]], k2[of2[hot3]]), return_counts=True)
            named += [(2, k2[n2 >= least], n2[n2 >= least]), (3, k3[n3 >= least], n3[n3 >= least])]
        rows = []
        for level, keys, counts in named:
            shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            keys, counts, cut = keys[by], counts[by], np.searchsorted(shard[by], np.arange(shards + 1))
            rows += [(k, level, keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
        yield _rows(kinds, rows)

    return lambda batches: _flushed(batches, order, True, out)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (level, key, n, named, types): tokens, texts and types at level 0; at 1 to 3 the n-grams that tasks named, how often
    they did, and for words the exact count."""
    keys, counts = [[] for _ in range(4)], [[] for _ in range(4)]
    for b in batches:
        for level, k, n in zip(b["level"].to_pylist(), b["keys"].to_pylist(), b["counts"].to_pylist(), strict=True):
            keys[level].append(np.frombuffer(k, np.uint64))
            counts[level].append(np.frombuffer(n, np.uint32))
    words = Counts(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for level in range(4):
        if keys[level]:
            k, to = np.unique(np.concatenate(keys[level]), return_inverse=True)
            n = np.bincount(to, np.concatenate(counts[level])).astype(np.int64)
            if level == 0:
                words = Counts(k, n)
                cols = [[int(max(0, words.get(np.array([END]))[0]))], [int(n.sum())], [0], [len(k)]]
            else:
                cols = [k.view(np.int64), words.get(k) if level == 1 else n, n, np.zeros(len(k), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([level] * len(cols[0]), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)], ["level", "key", "n", "named", "types"])


def _recount(order: int, sent):
    """Rows (level, key, n): exact counts of the hot n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = [Counts(np.sort(k), np.arange(len(k))) for k in sent.value]
        totals = [np.zeros(len(k.keys), np.int64) for k in hot]

        def add(_: list, __: list, part: Part) -> Iterator[pa.RecordBatch]:
            names, w, v, u, _n = part.grams()
            at = hot[0].get(names)[w]
            key = None
            for level in range(3):
                if level:
                    key = pair_key(names[v], names[w]) if level == 1 else triple_key(names[u], key)
                    at = hot[level].get(key)
                totals[level] += np.bincount(at[at >= 0], minlength=len(totals[level]))
                w, v, u, key = w[at >= 0], v[at >= 0], u[at >= 0], None if key is None else key[at >= 0]
            return iter(())

        def end() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate([np.full(len(t), k + 1) for k, t in enumerate(totals)]), np.concatenate([h.keys for h in hot]).view(np.int64), np.concatenate(totals)]
            some = cols[2] > 0
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][some], pa.int32()), pa.array(cols[1][some], pa.int64()), pa.array(cols[2][some], pa.int64())], ["level", "key", "n"])

        yield from _flushed(batches, order, True, add, end)

    return run


def learn(docs: DataFrame, order: int = ORDER) -> Model:
    """N, V and the counts of hot n-grams of docs (doc_id, text, train). The driver gets two sums and at most 2 / HOT counts an order."""
    spark = docs.sparkSession
    shards = width(spark)
    docs = docs.select("doc_id", "text", "train")
    counted = map_batches(docs, _count(order, shards), "shard int, level int, keys binary, counts binary")
    sums = stash(map_batches(counted.repartitionById(shards, F.col("shard")).select("level", "keys", "counts"), _sum_counts, "level int, key long, n long, named long, types long"), "counts")
    all_ = sums.where("level = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "types", "key"))).first()
    got = sums.where(F.col("level") > 0).where(F.col("named") >= HOT / 2 * all_.n).select("level", "key", "n").toArrow()
    level, key, n = got["level"].to_numpy(), got["key"].to_numpy().view(np.uint64), got["n"].to_numpy()
    hot = [Counts(key[level == k], n[level == k]) for k in (1, 2, 3)]
    if order == 3:
        sent = spark.sparkContext.broadcast([h.keys for h in hot])
        exact = map_batches(docs, _recount(order, sent), "level int, key long, n long").groupBy("level", "key").agg(F.sum("n").alias("n")).toArrow()
        level, key, n = exact["level"].to_numpy(), exact["key"].to_numpy().view(np.uint64), exact["n"].to_numpy()
        hot = [Counts(key[level == k], n[level == k]) for k in (1, 2, 3)]
    return Model(order, all_.n, all_.types, all_.key, hot, shard_ids(spark, shards))


def _parts(model: Model, names: np.ndarray, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams in the order of their shards, and where each shard starts."""
    shard = model.routed(names, w, v, u)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(len(model.shards) + 1))


def _deal(sent):
    """Rows (shard, grams): the distinct n-grams of training texts with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value

        def out(_: list, __: list, part: Part) -> Iterator[pa.RecordBatch]:
            names, w, v, u, _n = part.grams()
            w, v, u, _ = sorted_grams(w, v, u, len(names), model.order)
            first = first_of(w, v, u)
            n = np.diff(np.append(first, len(w)))
            w, v, u = w[first], v[first], u[first]
            order, cut = _parts(model, names, w, v, u)
            rows = [(model.shards[k], packed(names, *(x[order[a:b]] for x in (w, v, u, n)))) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
            yield _rows([("shard", pa.int32()), ("grams", pa.binary())], rows)

        yield from _flushed(batches, model.order, True, out)

    return run


def _build(sent):
    """The n-grams of a shard to its trie."""

    def made(shard: int, blobs: list[bytes], model: Model) -> pa.RecordBatch:
        parts = [unpacked(b, True) for b in blobs]
        names = np.unique(np.concatenate([p[0] for p in parts]))
        w, v, u, n = (np.concatenate([np.searchsorted(names, p[0])[p[k]] if k < 4 else p[k] for p in parts]) for k in (1, 2, 3, 4))
        parts.clear()
        if model.order == 2 and len(names) ** 2 < 1 << 63:
            by = np.argsort(w * len(names) + v)
        else:
            by = np.lexsort((u, v, w))
        w, v, u, n = w[by], v[by], u[by], n[by]
        first = first_of(w, v, u)
        trie = Trie(names, w[first], v[first], u[first], np.add.reduceat(n, first) if len(n) else n, model)
        return _rows([("shard", pa.int32()), ("trie", pa.large_binary())], [(shard, trie.to_bytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for shard, grams in zip(b["shard"].to_pylist(), b["grams"].to_pylist(), strict=True):
                held.setdefault(shard, []).append(grams)
        for shard in list(held):
            yield made(shard, held.pop(shard), sent.value)

    return run


def build(docs: DataFrame, model: Model) -> DataFrame:
    """shard, trie: the tries of docs (doc_id, text, train), written once, a bucket a shard."""
    shards = len(model.shards)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    dealt = map_batches(docs.select("doc_id", "text", "train"), _deal(sent), "shard int, grams binary").repartition(shards, "shard")
    return bucketed(map_batches(dealt, _build(sent), "shard int, trie binary"), "shard", shards, "tries")


def _asked(sent):
    """Rows (shard, part, grams, about): the distinct n-grams of a part; one row of a part has what is needed to sum the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def out(ids: list, train: list[bool], part: Part) -> Iterator[pa.RecordBatch]:
            nonlocal number
            names, w, v, u, n = part.grams()
            w, v, u, doc = sorted_grams(w, v, u, len(names), model.order, np.repeat(np.arange(len(n)), n), len(n))
            first = first_of(w, v, u)
            runs = np.diff(np.append(first, len(w)))
            w, v, u = w[first], v[first], u[first]
            sums = np.zeros((3, len(n)))  # of hot triples: logarithms of counts, scores, known ones
            cold = np.ones(len(w), bool)
            if model.order == 3:
                maybe = np.flatnonzero(model.hot[0].get(names)[w] >= 0)
                pair = pair_key(names[v[maybe]], names[w[maybe]])
                n3 = model.hot[2].get(triple_key(names[u[maybe]], pair))
                hot = n3 >= 0
                g, n3 = maybe[hot], n3[hot]
                n2, n1 = model.hot[1].get(pair[hot]), model.hot[0].get(names[w[g]])
                cold[g] = False
                value = np.zeros((3, len(w)))
                value[0, g], value[2, g] = np.log10(model.p(n1)), 1
                value[1, g] = model.num(model.b * model.p(n1), n2, n3) - np.where(names[w[g]] == END, 0, model.den(n1, n2))
                sums = np.array([np.bincount(doc.astype(np.int64), np.repeat(x, runs), len(n)) for x in value])
            kept = np.flatnonzero(cold)
            order, cut = _parts(model, names, w[kept], v[kept], u[kept])
            kept = kept[order]
            some = np.repeat(first[kept] - np.cumsum(runs[kept]) + runs[kept], runs[kept]) + np.arange(runs[kept].sum())
            about = [np.array([len(n), len(kept), len(some)], np.int64).tobytes(), np.array([0 if x is None else x for x in ids], np.int64).tobytes(), np.array([x is None for x in ids], np.int64).tobytes(), np.array(train, np.int64).tobytes(), n.tobytes(), sums.tobytes()]
            about += [_planes(doc[some].astype(np.uint32)), _planes(runs[kept].astype(np.uint32))]
            mine = ((number >> 32) + number) % len(model.shards)
            rows = []
            for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if a < b or k == mine:
                    rows.append((model.shards[k], number, k, packed(names, *(x[kept[a:b]] for x in (w, v, u))), zstandard.ZstdCompressor(level=1).compress(b"".join(about)) if k == mine else None))
            number += 1
            yield _rows([("shard", pa.int32()), ("part", pa.int64()), ("nth", pa.int32()), ("grams", pa.binary()), ("about", pa.binary())], rows)

        yield from _flushed(batches, model.order, False, out)

    return run


def _answer(sent):
    """A shard's trie and the questions to it, to rows (part, nth, values, about)."""

    def run(tries: pa.Table, asked: pa.Table) -> pa.Table:
        model: Model = sent.value
        trie = Trie.mapped(tries["trie"][0].as_py()) if len(tries) else None
        rows = []
        for part, nth, grams, about in zip(*(asked[c].to_pylist() for c in ("part", "nth", "grams", "about")), strict=True):
            names, w, v, u = unpacked(grams, False)
            c, num, den = ask(trie, model, names, w, v, u)
            den[names[w] == END] = 0  # nothing follows
            rows.append((part, nth, zstandard.ZstdCompressor(level=1).compress(b"".join((_planes(c.astype(np.uint64)), _planes(num), _planes(den)))), about))
        kinds = [("part", pa.int64()), ("nth", pa.int32()), ("values", pa.binary()), ("about", pa.binary())]
        return pa.Table.from_batches([_rows(kinds, rows)])

    return run


def _gather(sent):
    """Sorted answers of parts to documents."""

    def out(values: list[bytes], about: bytes, model: Model) -> pa.RecordBatch:
        loose = zstandard.ZstdDecompressor().decompress
        raw = loose(about)
        size, grams, asked = np.frombuffer(raw, np.int64, 3).tolist()
        ids, null, train, n = np.frombuffer(raw, np.int64, 4 * size, 24).reshape(4, size)
        sums = np.frombuffer(raw, np.float64, 3 * size, 24 + 32 * size).reshape(3, size)
        doc, at = _unplaned(raw, np.uint32, asked, 24 + 56 * size)
        runs, at = _unplaned(raw, np.uint32, grams, at)
        got = []
        for v in map(loose, values):
            k = len(v) // 12
            c, at = _unplaned(v, np.uint64, k, 0)
            num, at = _unplaned(v, np.uint16, k, at)
            den, at = _unplaned(v, np.uint16, k, at)
            got.append(np.array([np.log10(model.p(c)), loosened(num) - np.where(den > 0, loosened(den), 0), c > 0]))
        value = np.repeat(np.concatenate(got, 1), runs, 1)
        base, score, known = (s + np.bincount(doc, x, size) for s, x in zip(sums, value, strict=True))
        score = score - model.den(model.texts, model.texts)
        cols = [pa.array(ids, mask=null.astype(bool)), pa.array(train.astype(bool)), pa.array(n), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values, about = None, [], None
        for b in batches:
            for part, v, a in zip(b["part"].to_pylist(), b["values"].to_pylist(), b["about"].to_pylist(), strict=True):
                if part != key:
                    if key is not None:
                        yield out(values, about, sent.value)
                    key, values, about = part, [], None
                values.append(v)
                about = a or about
        if key is not None:
            yield out(values, about, sent.value)

    return run


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score, train_tokens for docs (doc_id, text, train)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "train")
    model = learn(docs, order)
    tries, shards = build(docs, model), len(model.shards)
    sent = spark.sparkContext.broadcast(model)
    asked = map_batches(docs, _asked(sent), "shard int, part long, nth int, grams binary, about binary")
    reach_workers(spark)
    answers = tries.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_answer(sent), "part long, nth int, values binary, about binary")
    to = F.expr(f"cast(pmod((part >> 32) + 7919 * (part & 4294967295), {shards}) as int)")
    answers = answers.repartitionById(shards, to).sortWithinPartitions("part", "nth")
    out = map_batches(answers, _gather(sent), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.n).cast("long"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", F.coalesce(crc_mod(F.col("doc_id"), 10) != 0, F.lit(False)))
    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    return scored(docs).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
