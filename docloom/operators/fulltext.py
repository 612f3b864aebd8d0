"""English full text: lexemes with positions, web-style queries, matches, cover-density ranks.

A text's tokens are its runs of letters and digits, lower-cased. Stop words are dropped but keep their positions; every
other token is stemmed by the published Snowball English algorithm, as the database's ``english`` configuration does. Compound
tokens of that parser (hyphenated words as a whole, addresses) are not made; their parts are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stop words of the english configuration; a fixed value.
STOP_WORDS = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split())

# Fixed values of the published stemmer.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
LATE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
V = "aeiouy"
_VOWEL, _RUN, _PREFIX, _POSSESSIVE = re.compile(f"[{V}]"), re.compile(f"[{V}][^{V}]"), re.compile("gener|commun|arsen"), re.compile("('s'|'s|')$")
_TOKEN, _CONSONANT_Y, _SHORT, _SHORT_WORD, _DOUBLE, _LAST_Y = re.compile("[a-z0-9]+"), re.compile(f"(?<=[{V}])y|^y"), re.compile(f"[^{V}][{V}][^{V}wxY]$"), re.compile(f"[{V}][^{V}]"), re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), re.compile(f"[^{V}][yY]$")


def _after_vowel_run(w: str, start: int) -> int:
    """The place after the first consonant that follows a vowel, from start on; the end if there is none."""
    m = _RUN.search(w, start)
    return m.end() if m else len(w)


def _regions(w: str) -> tuple[int, int]:
    m = _PREFIX.match(w)
    r1 = m.end() if m else _after_vowel_run(w, 0)
    return r1, _after_vowel_run(w, r1)


def _short_end(w: str) -> bool:
    return bool(_SHORT.search(w) or _SHORT_WORD.fullmatch(w))


def _longest(w: str, endings) -> str | None:
    return next((w[-n:] for n in range(min(7, len(w)), 0, -1) if w[-n:] in endings), None)


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The Snowball English stem of a lower-case word."""
    if len(word) <= 2 or word.isdigit():
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word in UNCHANGED:
        return word
    w = word.lstrip("'")
    w = _CONSONANT_Y.sub("Y", w) if "y" in w else w
    r1, r2 = _regions(w)
    w = _POSSESSIVE.sub("", w) if "'" in w else w
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in LATE:
        return w.replace("Y", "y")
    # past and continuous forms
    end = _longest(w, ("eedly", "eed", "edly", "ed", "ingly", "ing"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if _LAST_Y.search(w) and len(w) > 2:
        w = w[:-1] + "i"
    # derived forms
    end = _longest(w, STEP2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if not (end == "ogi" and not before.endswith("l")) and not (end == "li" and not before.endswith(tuple("cdeghkmnrt"))):
            w = before + STEP2[end]
    end = _longest(w, STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]
    end = _longest(w, STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    # a final e or l
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexemes_of(text: str | None) -> list[tuple[int, str]]:
    """Position (from 1) and lexeme of a text's tokens but its stop words."""
    return [(k, stem(t)) for k, t in enumerate(_TOKEN.findall((text or "").lower()), 1) if t not in STOP_WORDS]


Phrase = tuple[tuple[int, str], ...]
Query = list[tuple[list[Phrase], list[Phrase]]]


def parse(text: str | None) -> Query:
    """A web-style query as alternatives of (required, excluded) phrases, each of (offset, lexeme). Never fails."""
    out: Query = [([], [])]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text or ""):
        if plain.lower() == "or" and not minus:
            out.append(([], []))
            continue
        found = lexemes_of(quoted or plain)
        if found:
            out[-1][1 if minus else 0].append(tuple((p - found[0][0], w) for p, w in found))
    return [a for a in out if a[0] or a[1]]


def _starts(at: dict[str, list[int]], phrase: Phrase) -> list[int]:
    """Where a phrase begins, ascending."""
    (_, first), *others = phrase
    if not others:
        return at.get(first, [])
    sets = [(d, set(at.get(w, ()))) for d, w in others]
    return [p for p in at.get(first, ()) if all(p + d in s for d, s in sets)]


def rank_at(at: dict[str, list[int]], query: Query) -> float | None:
    """Cover density of a text from the ascending positions of its lexemes; None if the query does not match.

    Each shortest stretch that satisfies the query gives 0.1 / (1 + the tokens in it that the query does not name). Each
    phrase is looked up once; the ends of a stretch are found among the places of phrases by bisection."""
    ways = [([(_starts(at, p), p[-1][0]) for p in yes], [(_starts(at, p), p[-1][0]) for p in no]) for yes, no in query]
    if not any(all(s for s, _ in yes) and not any(s for s, _ in no) for yes, no in ways):
        return None
    named = {w for yes, no in query for p in yes + no for _, w in p}
    places = sorted(p for w in named for p in at.get(w, ()))

    def soonest(phrase: tuple[list[int], int], start: int) -> float:
        """The least end of an occurrence that begins at start or later."""
        k = bisect_left(phrase[0], start)
        return phrase[0][k] + phrase[1] if k < len(phrase[0]) else inf

    def latest(phrase: tuple[list[int], int], end: int) -> float:
        """The greatest begin of an occurrence that ends at end or earlier."""
        k = bisect_right(phrase[0], end - phrase[1])
        return phrase[0][k - 1] if k else -inf

    score, start = 0.0, 0
    while start < len(places):
        begin = places[start]
        ends = [(max((soonest(p, begin) for p in yes), default=begin), no) for yes, no in ways]
        last = min((e for e, no in ends if all(soonest(p, begin) > e for p in no)), default=inf)
        if last == inf:
            break
        firsts = [(min((latest(p, last) for p in yes), default=last), no) for yes, no in ways]
        first = max(f for f, no in firsts if f >= begin and all(latest(p, last) < f for p in no))
        at_first, at_last = bisect_left(places, first), bisect_left(places, last)
        score += 0.1 / (1 + (last - first) - (at_last - at_first))
        start = at_first + 1
    return score


def rank(entries: list[tuple[int, str]], query: Query) -> float | None:
    """rank_at() of (position, lexeme) entries."""
    named = {w for yes, no in query for p in yes + no for _, w in p}
    at: dict[str, list[int]] = {}
    for p, w in entries:
        if w in named:
            at.setdefault(w, []).append(p)
    return rank_at(at, query) if query else None


def ranks(text: Column, query: str) -> Column:
    """rank() of a text column, null where the query does not match; one Arrow pass, nothing is shuffled."""
    parsed = parse(query)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([rank(lexemes_of(t), parsed) for t in s], dtype="float64")

    return run(text)


def search(docs: DataFrame, key: str, text: str, query: str, limit: int | None = 50) -> DataFrame:
    """key and score of the documents that match, the best limit of them (None: all); ties go to the smallest key.

    A blank query gives none, as does one of stop words alone."""
    if not parse(query):
        return docs.select(key, F.lit(0.0).alias("score")).where("false")
    hits = docs.select(key, F.round(ranks(F.col(text), query), 9).alias("score")).where("score is not null and not isnan(score)")
    return hits if limit is None else hits.orderBy(F.desc("score"), key).limit(limit)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, lexeme, positions: a text's vector, a row a lexeme."""

    @F.pandas_udf("array<struct<lexeme:string,position:int>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([[{"lexeme": w, "position": p} for p, w in lexemes_of(t)] for t in s])

    each = docs.select(key, F.explode(run(F.col(text))).alias("x")).select(key, "x.*")
    return each.groupBy(key, "lexeme").agg(F.sort_array(F.collect_list("position")).alias("positions"))
