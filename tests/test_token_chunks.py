"""Chunks by tokens: within the budget, together the text, cut where a plain search over all cuts would cut."""

from __future__ import annotations

import random

import pytest

from docloom.operators import chunking


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return chunking.encoding(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def test_token_ends(encoder) -> None:
    for text in ("", "a b", "é\U0001f600 ß漢字", "x" * 50, "\U0001f9ea" * 5 + "\n\n."):
        tokens = encoder.encode_ordinary(text)
        want = []
        for k in range(1, len(tokens) + 1):
            raw = b"".join(encoder.decode_single_token_bytes(t) for t in tokens[:k])
            cut = raw.decode("utf-8", "ignore")
            want.append((len(cut), cut.encode() == raw))
        assert chunking.token_ends(text, encoder) == want


def plain(text, tokens, size, overlap):
    """The same rule, by looking at every cut."""
    n = len(tokens)
    place = [0, *(e for e, _ in tokens)]
    ok = [k == 0 or tokens[k - 1][1] for k in range(n + 1)]
    after = lambda p, k: any(m.end() == place[k] for m in p.finditer(text))
    out, first, done = [], 0, 0
    while done < n:
        soonest = next(k for k in range(done + 1, n + 1) if ok[k])
        while first < done and soonest - first > size:
            first += 1
            while not ok[first]:
                first += 1
        fits = [k for k in range(done + 1, n + 1) if ok[k] and k <= first + size]
        if not fits:
            last = next(k for k in range(done + 1, n + 1) if ok[k])
        else:
            last = fits[-1]
            if last < n:
                for p in (chunking.PARAGRAPH, chunking.SENTENCE):
                    good = [k for k in fits if k > max(done, first + size // 2) and after(p, k)]
                    if good:
                        last = good[-1]
                        break
        out.append((place[first], place[done], place[last], last - first))
        done = last
        first = max(first, next(k for k in range(max(0, last - overlap), n + 1) if ok[k]))
    return out


def test_against_every_cut(encoder) -> None:
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "Sentence. ", "\n\n", "é", "\U0001f600", "漢", "x" * 9, '"Yes!" ', "\n \n", " "]) for _ in range(rng.randint(0, 60)))
        tokens = chunking.token_ends(text, encoder)
        for size, overlap in ((8, 3), (20, 0), (13, 12), (200, 50)):
            got = chunking.spans(text, tokens, size, overlap)
            assert got == plain(text, tokens, size, overlap)
            assert "".join(text[f:e] for _, f, e, _ in got) == text and all(t <= size for *_, t in got) and all(s <= f < e for s, f, e, _ in got)
    with pytest.raises(ValueError):
        chunking.spans("a", [(1, True)], 5, 5)


def test_odd_texts(spark) -> None:
    import public_tokenizers

    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "wordy " * 20_000), (4, "x")], "doc_id long, text string")
    got = chunking.chunked_by_tokens(df, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, 100, 10).collect()
    assert {r.doc_id for r in got} == {3, 4} and all(r.tokens <= 100 for r in got) and max(r.end for r in got) == 120_000
