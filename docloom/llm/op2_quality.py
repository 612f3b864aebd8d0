"""Quality rules: base counts, and a linear-chain conditional random field over the lines of a text.

Viterbi decoding marks each line as content or boilerplate; the share of a text's words that stand in content lines
decides retention. The field is trained here, on the driver, on at most TRAIN_DOCS labelled documents of at most
TRAIN_CHARS characters (those with the smallest hash of doc_id). Only documents are labelled, so lines of good documents
count as content, and lines of bad ones as boilerplate unless the field, refitted a few times, says otherwise; the most
doubtful line of a bad document stays boilerplate.

Defined results: null or empty text, or one without words: all counts 0, base_failed, not kept. Lines without words have
no label. Without usable labels (empty tables) every line is content. Ties decode as content. Repeated rows are answered
each; labels that contradict each other or are null are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, span_hashes, strings, table

TRAIN_DOCS = 800
TRAIN_CHARS = 20_000
MIN_CONTENT = 0.5
#: Lines, padding counted, that training holds as numbers at once; features wait as bits.
GROUP = 50_000
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Kinds of characters: 0 other, 1 letter, 2 capital, 3 digit, 4 symbol, 5 punctuation, 6 word separator.
_KIND: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    if not _KIND:
        k = np.zeros(0x110000, np.uint8)
        for c in range(0x30000):
            s = chr(c)
            k[c] = 2 if s.isupper() else 1 if s.isalpha() else 3 if s.isdigit() else 0
        k[[ord(c) for c in SYMBOLS]] = 4
        k[[ord(c) for c in ".,;:!?'\"()-"]] = 5
        k[[32, *range(9, 14)]] = 6
        _KIND.append(k)
    return _KIND[0]


def repeated_words(text: str) -> tuple[int, int]:
    """Number of words, and of those that lie in a window of WINDOW words found twice or more."""
    data = b" ".join(text.encode("utf-8", "surrogatepass").split())
    if not data:
        return 0, 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    n = len(starts)
    if n <= WINDOW:
        return n, 0
    h = span_hashes(data, starts[: n - WINDOW + 1], ends[WINDOW - 1 :])
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return n, 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return n, int(np.count_nonzero(np.cumsum(step[:n])))


FEATURES = 24


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray, dict]:
    """Features (lines x FEATURES, 0 or 1) and word counts of the lines that have a word, and the text's own counts."""
    kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lines = text.split("\n")
    size = np.array([len(x) for x in lines])
    first = np.cumsum(size + 1) - size - 1
    by = np.zeros((7, len(lines)), np.int64)
    for k in (1, 2, 3, 4, 5, 6):
        total = np.concatenate(([0], np.cumsum(kinds == k)))
        by[k] = total[first + size] - total[first]
    seen: set[str] = set()
    dup = np.zeros(len(lines), bool)
    has = size > by[6]
    words = np.zeros(len(lines), np.int64)
    distinct = np.zeros(len(lines), np.int64)
    ends = np.zeros(len(lines), bool)
    for i in np.flatnonzero(has):
        line = lines[i]
        dup[i] = line in seen
        seen.add(line)
        w = line.encode("utf-8", "surrogatepass").split()
        words[i], distinct[i] = len(w), len(set(w))
        ends[i] = w[-1][-1:] in b".!?\"'"
    counts = {"word_chars": int((size - by[6]).sum()), "n_symbols": int(by[4].sum()), "n_dup_lines": int(dup.sum())}
    size, by, words, distinct, dup, ends = size[has], by[:, has], words[has], distinct[has], dup[has], ends[has]
    chars = np.maximum(size - by[6], 1)
    letters = np.maximum(by[1] + by[2], 1)
    symbol, upper, digit, other = by[4] / chars, by[2] / letters, by[3] / chars, (chars - by[1] - by[2] - by[3]) / chars
    x = [np.ones(len(size)), dup, ends, distinct < 0.6 * words]
    x += [words <= 2, (words > 2) & (words <= 5), (words > 5) & (words <= 15), words > 15]
    x += [symbol == 0, (symbol > 0) & (symbol < 0.04), (symbol >= 0.04) & (symbol < 0.1), symbol >= 0.1]
    x += [upper < 0.2, (upper >= 0.2) & (upper < 0.6), upper >= 0.6, digit >= 0.2]
    x += [other < 0.06, (other >= 0.06) & (other < 0.15), (other >= 0.15) & (other < 0.3), other >= 0.3]
    x += [chars < 3 * words, (chars >= 3 * words) & (chars < 10 * words), chars >= 10 * words, by[4] >= words * 0.5]
    return np.array(x, np.float64).T.reshape(-1, FEATURES), words, counts


class Field:
    """A linear-chain conditional random field with the states 0 content, 1 boilerplate."""

    def __init__(self, unary: np.ndarray, moves: np.ndarray):
        self.unary, self.moves = unary, moves

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most probable states, by Viterbi; ties go to content."""
        score = (x @ self.unary).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        a, b = score[0]
        for u, v in score[1:]:
            back.append((int(b + m10 > a + m00), int(b + m11 > a + m01)))
            a, b = max(a + m00, b + m10) + u, max(a + m01, b + m11) + v
        state = int(b > a)
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return np.array(states[::-1])


def _chains(docs: list[np.ndarray], bad: list[bool]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features (bits), places that hold a line, and classes of documents of like length, padded to at most GROUP lines a group."""
    order = sorted(range(len(docs)), key=lambda k: len(docs[k]))
    groups: list[list[int]] = []
    for k in order:
        if groups and (len(groups[-1]) + 1) * len(docs[k]) <= GROUP:
            groups[-1].append(k)
        else:
            groups.append([k])
    out = []
    for g in groups:
        longest = len(docs[g[-1]])
        x, there = np.zeros((len(g), longest, FEATURES), bool), np.zeros((len(g), longest), bool)
        for i, k in enumerate(g):
            x[i, : len(docs[k])], there[i, : len(docs[k])] = docs[k], True
        out.append((x, there, np.array([bad[k] for k in g])))
    return out


def _marginals(x: np.ndarray, there: np.ndarray, unary: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of states (docs x lines x 2) and the expected number of each move."""
    score = x @ unary
    n = score.shape[1]
    fore, back = np.zeros_like(score), np.zeros_like(score)
    fore[:, 0] = score[:, 0]
    for t in range(1, n):
        step = np.logaddexp.reduce(fore[:, t - 1, :, None] + moves, axis=1) + score[:, t]
        fore[:, t] = np.where(there[:, t, None], step, fore[:, t - 1])
    for t in range(n - 2, -1, -1):
        step = np.logaddexp.reduce(moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
        back[:, t] = np.where(there[:, t + 1, None], step, 0)
    total = np.logaddexp.reduce(fore[:, -1], axis=1)[:, None, None]
    p = np.exp(fore + back - total) * there[..., None]
    pair = fore[:, :-1, :, None] + moves + (score + back)[:, 1:, None, :] - total[..., None]
    return p, (np.exp(pair) * there[:, 1:, None, None]).sum((0, 1))


def fit(docs: list[np.ndarray], bad: list[bool], rounds: int = 3, steps: int = 80) -> Field | None:
    """The field fitted by gradient ascent with step sizes from squared gradients; None if a class has no example."""
    if not docs or all(bad) or not any(bad):
        return None
    groups = _chains(docs, bad)
    states = [np.where(is_bad[:, None], 1, 0) * there for _, there, is_bad in groups]
    unary, moves = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    for _ in range(rounds):
        seen, pairs = np.zeros_like(unary), np.zeros_like(moves)
        for (x, there, _), y in zip(groups, states, strict=True):
            want = np.stack(((y == 0) & there, (y == 1) & there), axis=-1).astype(float)
            seen += np.einsum("dtf,dts->fs", x.astype(float), want)
            pairs += np.einsum("dti,dtj->ij", want[:, :-1], want[:, 1:])
        sq_u, sq_m = np.full_like(unary, 1e-8), np.full_like(moves, 1e-8)
        for _ in range(steps):
            g_u, g_m = seen.copy(), pairs.copy()
            for x, there, _ in groups:
                real = x.astype(float)
                p, expected = _marginals(real, there, unary, moves)
                g_u -= np.einsum("dtf,dts->fs", real, p)
                g_m -= expected
            g_u, g_m = g_u / len(docs) - 1e-3 * unary, g_m / len(docs) - 1e-3 * moves
            sq_u += g_u**2
            sq_m += g_m**2
            unary = unary + 0.5 * g_u / np.sqrt(sq_u)
            moves = moves + 0.5 * g_m / np.sqrt(sq_m)
        states = []
        for x, there, is_bad in groups:
            p = np.where(there, _marginals(x.astype(float), there, unary, moves)[0][..., 1], -1)
            states.append((((p > 0.5) | (p == p.max(1, keepdims=True))) & is_bad[:, None] & there).astype(int))
    return Field(unary, moves)


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field from docs (doc_id, text) and labels (doc_id, quality)."""
    pick = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    # the sample is at most 2 x TRAIN_DOCS rows, a proven size
    sample = pick.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * TRAIN_DOCS).select("doc_id", "quality")
    texts = docs.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_DOCS).collect()
    made = [(lines_of(r.text)[0].astype(bool), r.quality == 0) for r in rows]
    made = [m for m in made if len(m[0])]
    return fit([m[0] for m in made], [m[1] for m in made])


def judge(text: str | None, field: Field | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content share."""
    text = text or ""
    n, again = repeated_words(text)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0, True, False, 0.0
    x, words, counts = lines_of(text)
    failed = n < 20 or 100 * again > 30 * n
    share = float(words[field.decode(x) == 0].sum() / words.sum()) if field else 1.0
    return n, counts["word_chars"], counts["n_symbols"], counts["n_dup_lines"], again, failed, not failed and share >= MIN_CONTENT, share


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "content_share": "double"}


def rate(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id and COLUMNS for docs (doc_id, text)."""
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*[judge(t, field) for t in strings(b["text"])], strict=True)) or [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(v, kinds[k]) for v, k in zip(got, COLUMNS.values(), strict=True))], ["doc_id", *COLUMNS])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


def keep(docs: DataFrame, field: Field | None) -> DataFrame:
    """The documents that stay, with their columns; each row is judged by its own text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(t, field)[6] for t in strings(b["text"])], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rate(docs, train(docs, table(spark, sf_dir, "labels")))
