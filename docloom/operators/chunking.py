"""Chunks of pages: paragraphs packed greedily to a token budget, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches

SCHEMA = "doc_id long, chunk_index int, page_number int, text string, token_count int, source_pages array<int>"


def words_of(text: str) -> list[str]:
    """The default tokenizer: words; a chunk's text is its words joined by spaces."""
    return text.split()


def chunks_of(pages: list[tuple[int, str]], size: int, overlap: int, tokenize: Callable[[str], list] = words_of, join: Callable[[list], str] = " ".join) -> list[tuple[int, str, int, list[int]]]:
    """page, text, tokens, source pages of each chunk."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap at least 0 and less than size")

    def parts(page: int, text: str) -> Iterator[tuple[int, str, int]]:
        tokens = tokenize(text)
        if len(tokens) <= size:
            yield page, text, len(tokens)
            return
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        if len(sentences) > 1:
            for s in sentences:
                yield from parts(page, s.strip())
        else:
            for k in range(0, len(tokens), size):
                yield page, join(tokens[k : k + size]), len(tokens[k : k + size])

    units = [u for page, text in pages for raw in re.split(r"\n\s*\n+", text or "") if raw.strip() for u in parts(page, " ".join(raw.split()))]
    out: list[tuple[int, str, int, list[int]]] = []
    held: list[tuple[int, str, int]] = []

    def close() -> None:
        text = "\n\n".join(u[1] for u in held)
        found = sorted({u[0] for u in held})
        out.append((held[0][0], text, len(tokenize(text)), found if len(found) > 1 else []))

    for unit in units:
        if held and sum(u[2] for u in held) + unit[2] > size:
            close()
            tail, total = len(held), 0
            while tail and total + held[tail - 1][2] <= overlap:
                tail -= 1
                total += held[tail][2]
            held = held[tail:]
        held.append(unit)
    if held:
        close()
    return out


def chunked(docs: DataFrame, size: int = 500, overlap: int = 75) -> DataFrame:
    """SCHEMA for docs (doc_id, pages: array<struct<page_number int, text string>>); a document is one row, so nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, p, t, n, s) for d, pages in zip(b["doc_id"], b["pages"], strict=True) for k, (p, t, n, s) in enumerate(chunks_of([(x["page_number"], x["text"]) for x in (pages if pages is not None else [])], size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "page_number", "text", "token_count", "source_pages"])

    return docs.select(F.col("doc_id"), "pages").mapInPandas(run, SCHEMA)


# ---- chunks by tokens of a byte-pair vocabulary ----

OFFSETS = "doc_id long, chunk_index int, start int, fresh int, end int, tokens int, text string"
PARAGRAPH, SENTENCE = re.compile(r"\n\s*\n\s*"), re.compile(r"[.!?][\"')\]]*\s+")
_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(ranks: str, pattern: str):
    """The encoder of a file of ranks and its split pattern, read once a worker."""
    if (ranks, pattern) not in _ENCODINGS:
        import base64

        import tiktoken

        with open(ranks) as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        _ENCODINGS[ranks, pattern] = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _ENCODINGS[ranks, pattern]


def token_ends(text: str, encoder) -> list[tuple[int, bool]]:
    """For each token of a text the whole characters up to its end, and whether it ends with one rather than within one."""
    out, at, left = [], 0, 0
    for t in encoder.encode_ordinary(text):
        for b in encoder.decode_single_token_bytes(t):
            if b < 0x80 or b >= 0xC0:  # the first byte of a character says how many follow
                left = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            left -= 1
            at += left == 0
        out.append((at, left == 0))
    return out


def spans(text: str, tokens: list[tuple[int, bool]], size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """start, fresh, end (code points) and tokens of each chunk of a text with such tokens (token_ends).

    A chunk has at most size tokens and ends, if its second half holds one, after the last paragraph in it, else after the last sentence, else
    between tokens, never within a character. The next one starts at most overlap tokens before that; fresh is where it goes beyond the one before it, so the
    stretches from fresh to end are the text. A character of more than size tokens is a chunk of its own, the one case over the budget."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap at least 0 and less than size")
    ends, ends_whole = [e for e, _ in tokens], [w for _, w in tokens]
    place = [0, *ends]  # place[k]: code points before token k
    cuts = [k for k in range(len(place)) if k in (0, len(ends)) or ends_whole[k - 1]]
    by_place = {place[k]: k for k in cuts}
    ranks = [{by_place[m.end()] for m in p.finditer(text) if m.end() in by_place} for p in (PARAGRAPH, SENTENCE)]
    out, first, done = [], 0, 0
    while done < len(ends):
        soonest = cuts[bisect_right(cuts, done)]
        first = min(done, max(first, cuts[bisect_left(cuts, soonest - size)]))  # less overlap where the next character would not fit
        last = max(soonest, cuts[bisect_right(cuts, first + size) - 1])
        if last < len(ends):
            half = max(done, first + size // 2)
            better = next((best for r in ranks if (best := max((k for k in r if half < k <= last), default=None)) is not None), None)
            last = last if better is None else better
        out.append((place[first], place[done], place[last], last - first))
        done = last
        first = max(first, cuts[bisect_left(cuts, max(0, last - overlap))])
    return out


#: Characters of chunks that are put into a batch before it is sent on.
BATCH_CHARS = 1 << 22


def chunked_by_tokens(docs: DataFrame, ranks: str, pattern: str, size: int = 500, overlap: int = 75) -> DataFrame:
    """OFFSETS for docs (doc_id, text): each text is encoded once and cut between its tokens; null and empty texts have no chunk.

    A worker holds one text with its tokens, its batch and some BATCH_CHARS of chunks, whatever the number of rows."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int32()) for c in ("chunk_index", "start", "fresh", "end", "tokens")], ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, held = encoding(ranks, pattern), [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

        for b in batches:
            for d, t in zip(b["doc_id"], b["text"], strict=True):  # a row at a time: the batch itself stays in Arrow
                d, t = d.as_py(), t.as_py()
                for k, (s, f, e, n) in enumerate(spans(t, token_ends(t, encoder), size, overlap) if t else ()):
                    rows.append((d, k, s, f, e, n, t[s:e]))
                    held += e - s
                    if held >= BATCH_CHARS:
                        yield sent()
                        rows, held = [], 0
        if rows:
            yield sent()

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, OFFSETS)
