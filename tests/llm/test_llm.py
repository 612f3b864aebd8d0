"""The corpus operators against brute force, and on odd input: nulls, empty and long texts, ties, copies, empty tables, other columns."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from docloom.llm import op1_langid, op2_quality, op3_html, op4_jaccard, op5_mixing, op6_licenses, op7_lm, op8_packing, op9_pii, op10_embeddings, queries
from docloom.llm.common import table

LONG = "wordy " * 20000
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "x", "de", "b"), (5, LONG, "en", "a"), (5, LONG, "en", "a"), (6, "a@b.co 1.2.3.4 +1 (743) 555-3824, 4785380592391139", "fr", "b"), (7, "\U0001f600 é  ß", None, "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n", F.lit(1)).withColumn("row", F.lit(1)).withColumn("size", F.lit("x")).withColumn("rate", F.lit(0))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_langid(spark, sf, docs, odd) -> None:
    r = {x.doc_id: x for x in op1_langid.op1_langid(spark, sf).collect()}
    lang = {x.doc_id: x.lang for x in docs.collect()}
    held = [i for i, x in r.items() if x.held_out]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == x.held_out for i, x in r.items())
    assert np.mean([r[i].lang_pred == lang[i] for i in held]) > 0.95
    f = op1_langid.train(odd)
    got = {x.doc_id: (x.lang_pred, x.score) for x in op1_langid.identify(odd, f).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5][0] == "en"
    assert op1_langid.identify(odd, op1_langid.train(odd.where("false"))).where("lang_pred <> 'und'").count() == 0


def base_counts(t):
    t = t or ""
    w = words(t)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def test_quality(spark, sf, docs, odd) -> None:
    field = op2_quality.train(docs, table(spark, sf, "labels"))
    for df in (docs, odd):
        texts = {x.doc_id: x.text for x in df.collect()}
        for x in op2_quality.rate(df, field).collect():
            t = texts[x.doc_id]
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base_counts(t)
            assert not (x.base_failed and x.kept)
    good = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = {x.doc_id for x in op2_quality.rate(docs, field).where("kept or base_failed").collect()}
    assert all(i in kept for i, q in good.items() if q == 1)
    assert op2_quality.keep(odd, None).columns == odd.columns


def test_viterbi_is_exact() -> None:
    rng = np.random.default_rng(0)
    f = op2_quality.Field(rng.normal(size=(op2_quality.FEATURES, 2)), rng.normal(size=(2, 2)))
    x = rng.integers(0, 2, (7, op2_quality.FEATURES)).astype(float)
    s = x @ f.unary
    best = max(range(2**7), key=lambda m: sum(s[t, m >> t & 1] for t in range(7)) + sum(f.moves[m >> t & 1, m >> (t + 1) & 1] for t in range(6)))
    assert f.decode(x).tolist() == [best >> t & 1 for t in range(7)]


def test_html(spark, sf) -> None:
    html = {x.page_id: x.html for x in table(spark, sf, "pages").collect()}
    for x in op3_html.op3_html(spark, sf).collect():
        body = re.search(r"<article>(.*?)</article>", html[x.page_id], re.S)[1]
        import html as h

        parts = [" ".join(h.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", body)]
        assert x.text == "\n\n".join(p for p in parts if p) and x.n_chars == len(x.text)
    tree = op3_html.small_tree()
    assert op3_html.main_text(None, tree) == op3_html.main_text("", tree) == op3_html.main_text("<nav><a href=x>Home</a></nav><script>x", tree) == ""
    assert op3_html.main_text("<article><p>One &amp; two three four five.<div class=comments>nice post</div></article>", tree) == "One & two three four five."


def test_html_of_other_pages() -> None:
    """Link density and neighbours tell where tags and class names do not."""
    tree = op3_html.small_tree()

    def splits(t):
        return set() if isinstance(t, int) else {t[0]} | splits(t[2]) | splits(t[3])

    used = {op3_html.FEATURES[k] for k in splits(tree)}
    assert "link density" in used and used & {"words before", "link density before"} | used & {"words after", "link density after"}
    text = " ".join(f"word{k}" for k in range(40))
    links = "".join(f"<li><a href=x>More of this {k}</a></li>" for k in range(4))
    keep = lambda page: op3_html.main_text(page, tree).split("\n\n")
    assert keep(f"<article><p>{text}</p><ul>{links}</ul></article>") == [text]
    assert keep(f"<body><ul>{links}</ul><h1>A short heading</h1><p>{text}</p><h2>Then another</h2><p>{text}</p></body>") == ["A short heading", text, "Then another", text]
    assert keep(f'<body><p class="ad-free share-price">{text}</p><p class="text ad">{text}</p></body>') == [text]
    assert keep(f"<body><div class=widget><p>{text} {text} {text}</p><p>{text} {text} {text}</p></div></body>") == [f"{text} {text} {text}"] * 2


def test_html_keeps_sentences_that_begin_like_notices() -> None:
    tree = op3_html.small_tree()
    keep = lambda page: op3_html.main_text(page, tree)
    said = ["Subscribe models have changed the media industry a lot.", "Advertisements shape consumption in many quiet ways.", "By using continuing care, we keep cookies fresh for bakers.", "Log in the river floated past us.", "Sponsored by the king, he sailed.", "Share this moment with those who came."]
    assert keep("<article>" + "".join(f"<p>{p}</p>" for p in said) + "</article>") == "\n\n".join(said)
    text = " ".join(f"word{k}" for k in range(40))
    assert keep(f"<article><h1>Share this moment: a history of cameras</h1><p>{text}</p></article>").startswith("Share this moment")
    assert keep(f"<article><p>Intro.</p><h2><a href=x>A linked heading here</a></h2><p>{text}</p></article>") == f"Intro.\n\nA linked heading here\n\n{text}"
    for gone in ("<p hidden>Not shown to anyone at all.</p>", "<div style='color:red; display: none'><p>Not shown to anyone at all.</p></div>", "<div>&copy; 2024 The Paper. All rights reserved.</div>", f"<div class=gdpr><p>We and our partners store things on your device, {text}</p></div>", f'<div class="user-comments"><p>{text} indeed</p></div>', f'<div id="comment-12"><p>{text} indeed</p></div>', "<p>Subscribe to our letter</p>"):
        assert keep(f"<article><p>{text}</p>{gone}<p>{text}</p></article>") == f"{text}\n\n{text}", gone
    assert keep(f'<article><p aria-hidden=false>{text}</p><p class="hidden-gem commentary">{text}</p></article>') == f"{text}\n\n{text}"


def test_html_of_real_markup() -> None:
    """Names that only look like side names, headings in containers, elements that close themselves, broken tags."""
    tree = op3_html.small_tree()
    keep = lambda page: op3_html.main_text(page, tree).split("\n\n")
    text = " ".join(f"word{k}" for k in range(40))
    for page in (f'<article class="post share-enabled"><p>{text}', f'<article class="post comments-open"><p>{text}</p></article>', f'<div class="site has-sidebar"><p>{text}</p></div>', f'<div class="sidebar layout"><main><p>{text}</p></main></div>', f"<form><article><p>{text}</p></article></form>"):
        assert keep(page) == [text]
    assert keep("<div><p>Short text here.</p></div>") == ["Short text here."]
    assert keep(f'<article><div class="entry-header"><h1>The title</h1></div><p>{text}</p></article>') == ["The title", text]
    assert keep(f"<article><ul><li class=share>tw<li><p>Second item of it</ul><p>{text}</p></article>") == ["Second item of it", text]
    assert keep(f"<article><p>{text}</p><div>We use cookies.</div><p>{text}</p></article>") == [text, text]
    assert keep(f"<table><tr><td>one<td>two<tr><td>three</table><dl><dt>a<dd>b<dt>c<dd>{text}</dl>") == ["one", "two", "three", "a", "b", "c", text]
    assert keep('<p><b class="x"><b>one two</b> three</b> four</p>') == ["one two three four"]
    assert keep("<p>a < b and c &lt; d &amp;amp; &am<b>p;</b> <a title='x > y'>e</a> f g</p>") == ["a < b and c < d &amp; &amp; e f g"]
    assert keep(f'<main><p>{text}</p><section class="comments-area"><article class="comment"><p>{text} {text} {text}</p></article></section></main>') == [text]
    assert keep(f"<aside><p>{text} {text} {text}</p></aside><p>{text}</p><footer>{text} {text}</footer>") == [text]
    assert keep(f"<p>{text}</p><p class='x>never closed</p>")[0] == text
    assert keep(f"<title>x<p>{text}</p>")[-1] == text


def test_html_odd_input(spark) -> None:
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>Same one two three</p></article>"), (3, "u", "<article><p>Same one two three</p></article>"), (4, "u", "<div>" * 50_000 + "deep " * 30 + "</div>" * 50_000), (5, "u", "<p>" + "long " * 200_000), (6, "u", "<p>\U0001f600 é a b c d</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(7)).withColumn("n_chars", F.lit("x"))
    got = op3_html.extract(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 0), (3, 18), (3, 18), (4, 149), (5, 999_999), (6, 11)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert op3_html.extract(df.where("false")).count() == 0


def test_html_is_linear() -> None:
    tree = op3_html.small_tree()
    for bad in ('<a "', "<a ", "<b><i>", "<div>", "<ul><li>", "</p>", "<title>", "<i><div><b>", "<a href=x>y<div>"):
        start = time.process_time()
        op3_html.main_text(bad * 30_000, tree)
        assert time.process_time() - start < 5


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, shared = [], list(rng.choice(vocabulary, 60))
    for g in range(14):
        base = list(rng.choice(vocabulary, int(rng.integers(4, 260))))
        if g % 3 == 0:
            base += shared
        for _ in range(int(rng.integers(1, 7))):
            t = list(base)
            for _ in range(int(rng.integers(0, 1 + len(t) // 40))):
                t[int(rng.integers(0, len(t)))] = "changed"
            rows.append((len(rows) * 7 + 1, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard(spark, odd, seed) -> None:
    rows = near_copies(seed) + [(9001, None), (9002, ""), (9003, "one Two"), (9004, "ONE two"), (9005, "a b c d e"), (9006, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("rep", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op4_jaccard.join(df).collect()}
    assert got == brute_components(rows)
    assert op4_jaccard.join(odd).count() == len(ODD)
    assert op4_jaccard.join(odd.where("false")).count() == 0
    assert op4_jaccard.deduplicated(df).count() == len({c for _, c in got.values()})


def test_quality_training_is_bounded(monkeypatch) -> None:
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 2, (int(n), op2_quality.FEATURES)).astype(bool) for n in [3000, *rng.integers(1, 40, 60)]]
    bad = [k % 3 == 0 for k in range(len(docs))]
    whole = op2_quality.fit(docs, bad, 1, 5)
    monkeypatch.setattr(op2_quality, "GROUP", 200)
    parts = op2_quality._chains(docs, bad)
    assert sum(len(x) for x, _, _ in parts) == len(docs) and all(x.shape[0] * x.shape[1] <= 200 or len(x) == 1 for x, _, _ in parts)
    cut = op2_quality.fit(docs, bad, 1, 5)
    assert np.allclose(whole.unary, cut.unary) and np.allclose(whole.moves, cut.moves)


def test_quality_without_usable_rows(spark, odd) -> None:
    labels = spark.createDataFrame([(1, None), (4, 1), (4, 0), (None, 0), (99, 1)], "doc_id long, quality int")
    assert op2_quality.train(odd, labels) is None and op2_quality.train(odd.where("false"), labels) is None and op2_quality.train(odd, labels.where("false")) is None


def test_jaccard_rows_of_one_id_are_one_vertex(spark) -> None:
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "ABCDE"}
    near = lambda k: text[k] + " end"
    rows = [(1, text["A"]), (5, text["A"]), (5, text["B"]), (7, near("B")), (8, text["C"]), (8, text["D"]), (9, near("C")), (10, near("D")), (11, text["E"])]
    got = op4_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8, 10: 8, 11: 11}
    assert got.count() == len(rows)


@pytest.mark.parametrize("hub", [0, 50, 1000])
def test_jaccard_verifies_a_document_with_many_partners(spark, monkeypatch, hub) -> None:
    monkeypatch.setattr(op4_jaccard, "PORTION", 3)
    base = [f"w{k}" for k in range(60)]
    texts = {hub: base} | {k: base[: 60 - k % 25] for k in range(1, 41)}
    pairs = [(min(hub, k), max(hub, k)) for k in texts if k != hub] + [(k, k + 1) for k in range(1, 40)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    got = op4_jaccard.verified(spark.createDataFrame(pairs, "a long, b long"), docs).collect()
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in texts.items()}
    want = {(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert sorted((min(r), max(r)) for r in map(tuple, got)) == sorted(want) and 0 < len(want) < len(pairs)


def test_jaccard_tree_loses_nothing() -> None:
    rng = np.random.default_rng(1)
    points = rng.poisson(2, (300, 32)).astype(np.int32)
    points[150:] = points[:150] + rng.integers(0, 2, (150, 32))
    tree = op4_jaccard.RTree(points)
    for q in points[:50]:
        total, n = q.sum(), points.sum(1)
        want = {int(k) for k in np.flatnonzero((9 * np.minimum(points, q).sum(1) >= 4 * (total + n)) & (5 * n >= 4 * total) & (4 * n <= 5 * total))}
        assert want <= set(tree.search(q)[0].tolist())


def test_mixing(spark, sf, odd, docs) -> None:
    r = op5_mixing.mix(docs).collect()
    again = op5_mixing.mix(docs).collect()
    assert sorted((x.doc_id, x.taken) for x in r) == sorted((x.doc_id, x.taken) for x in again)
    text = {x.doc_id: (x.text, x.source) for x in docs.collect()}
    assert all(x.size == len(words(text[x.doc_id][0])) and x.taken <= 3 * x.size for x in r)
    size, taken, target = Counter(), Counter(), {}
    for x in r:
        s = text[x.doc_id][1]
        size[s] += x.size
        taken[s] += x.taken
        target[s] = x.target
    names = sorted(size)
    weight = dict(zip(names, (5, 2, 1) * len(names), strict=False))
    want, full = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        want = {s: 3 * size[s] if s in full else rest * weight[s] / sum(weight[t] for t in names if t not in full) for s in names}
        over = {s for s in names if s not in full and want[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert math.isclose(want[s], target[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= max(50, 0.05 * target[s])
    assert op5_mixing.mix(odd).count() == len(ODD) and op5_mixing.mix(odd.where("false")).count() == 0
    assert set(op5_mixing.mixed_rows(odd).columns) == set(odd.columns)


def test_mixing_solves_the_dual(spark, docs) -> None:
    """Rates against bisection on single documents, by source."""
    by: dict = {}
    for x in op5_mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        by.setdefault(x.source, []).append(x)
    tilted = 0
    for rows in by.values():
        total, target = sum(x.size for x in rows), rows[0].target
        mean = total / len(rows)
        assert math.isclose(sum(x.size * x.rate for x in rows), target, rel_tol=1e-6)
        if target < 2.999 * total:
            lo, hi = -50.0, 50.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if sum(x.size * min(3, math.exp(min(50, mid * x.size / mean))) for x in rows) > target else (mid, hi)
            assert all(math.isclose(x.rate, min(3, math.exp(lo * x.size / mean)), rel_tol=1e-4) for x in rows)
            tilted += 1
    assert tilted


def test_mixing_rows_of_one_id(spark) -> None:
    """Rows are told apart by what they hold, not by doc_id alone."""
    rows = [(k // 2, f"s{k % 3}", f"w{k} " * (1 + k % 17)) for k in range(120)] + [(7, "s0", "same row"), (7, "s0", "same row"), (None, None, "x y"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("key", F.lit(1)).withColumn("copies", F.lit("x"))
    taken = Counter()
    for r in op5_mixing._planned(df).collect():
        taken[r.doc_id, r.size] += r.copies
    mixed = op5_mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    assert Counter((r.doc_id, len((r.text or "").split())) for r in mixed.collect()) == +taken


def test_licenses(odd) -> None:
    t = op6_licenses.Templates()
    mit = op6_licenses.TEMPLATES["MIT"][2]
    assert [m[2] for m in t.scan("Hello\nReleased under the MIT License.\nBye")] == ["MIT"]
    assert [m[2] for m in t.scan("Copyright (c) 2020 X\n" + mit.replace(". ", ".\n"))] == ["MIT"]
    assert t.scan("A plain text about a license and other things.") == [] == t.scan(None)
    for text in ("Licensed under the Apache License, Version 2.0.", mit[:400] + " changed words " + mit[400:]):
        g = op6_licenses.bigrams(text)
        best = max((2 * len(g & x) / (len(g) + n), name) for n, name, x in t.made)
        assert t.best(g) == best if best[0] >= op6_licenses.LEAST else t.best(g) == (0.0, "")
    assert op6_licenses.scan(odd).count() == len(ODD)


def test_licenses_anywhere() -> None:
    """Several paragraphs inside a longer text, a notice in the middle of a line, one word a line; BSD with three clauses is not BSD with two."""
    t = op6_licenses.Templates()
    mit, bsd = op6_licenses.TEMPLATES["MIT"][2], op6_licenses.TEMPLATES["BSD-3-Clause"][2]
    prose = " ".join(f"word{k}" for k in range(300))
    parts = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    assert parts.count("\n\n") == 2
    for body, name in ((parts, "MIT"), (bsd.replace(". ", ".\n\n"), "BSD-3-Clause"), ("Released under the MIT License.", "MIT"), ("Released\nunder\nthe\nMIT\nLicense.", "MIT")):
        for joint in (" ", "\n\n"):
            [(a, b, got, dice)] = t.scan(prose + joint + body + joint + prose)
            assert (got, dice) == (name, 1.0) and a == len(prose + joint) and abs(b - a - len(body)) <= 1
    for name in ("AGPL-3.0", "LGPL-3.0"):
        assert [m[2] for m in t.scan(op6_licenses.TEMPLATES[name][0])] == [name]
    assert [m[2] for m in t.scan(f"İ {prose}\n{mit}\n{prose}\n{bsd}")] == ["MIT", "BSD-3-Clause"]


def test_elias_fano() -> None:
    rng = np.random.default_rng(2)
    for n, u in ((1, 5), (700, 1 << 64), (900, 950), (500, 1 << 30)):
        x = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = op7_lm.EliasFano(x, u)
        assert (e.at(np.arange(n)) == x).all()
        q = rng.integers(0, u, 300, dtype=np.uint64)
        assert (e.successor(q, np.zeros(300), np.full(300, n)) == np.searchsorted(x, q)).all() and (e.all() == x).all()
        lo, hi = np.sort(rng.integers(0, n + 1, (2, 300)), axis=0)
        assert (e.successor(q, lo, hi) == np.clip(np.searchsorted(x, q), lo, hi)).all()


#: A token's error: half a step of the quantised numerator, and of the denominator.
STEP = 1.01 * (op7_lm.HIGHEST - op7_lm.LOWEST) / op7_lm.LEVELS


def brute_lm(rows, order):
    """What scored() gives for rows (doc_id, text, train), by dictionaries of counts."""
    cut = lambda t: [*(t or "").encode().lower().split(), None]
    grams = lambda t: list(zip(["", "", *t], ["", *t], t, strict=False))
    train = [g for _, t, learnt in rows if learnt for g in grams(cut(t))]
    c, c2, c3 = Counter(w for _, _, w in train), Counter((v, w) for _, v, w in train), Counter(train)
    before, before2 = Counter(v for _, v, _ in train), Counter((u, v) for u, v, _ in train)
    n, v_ = sum(c.values()), len(c)

    def score(u, v, w, p):
        if order == 2:
            return (c2[v, w] + op7_lm.B2 * p) / (before[v] + op7_lm.B2)
        return (c3[u, v, w] + op7_lm.A * c2[v, w] + op7_lm.B * p) / (before2[u, v] + op7_lm.A * before[v] + op7_lm.B)

    out = []
    for i, t, _ in rows:
        p = [(c[w] + 0.1) / (n + 0.1 * (v_ + 1)) for w in cut(t)]
        out.append((i, len(p), sum(c[w] > 0 for w in cut(t)), n, sum(map(math.log10, p)), sum(math.log10(score(*g, q)) for g, q in zip(grams(cut(t)), p, strict=True))))
    return out


@pytest.mark.parametrize(("order", "hot"), [(2, op7_lm.HOT), (2, 0.02), (3, op7_lm.HOT), (3, 0.02), (3, 1.1)])
def test_lm(spark, sf, docs, odd, monkeypatch, order, hot) -> None:
    """Scores equal those of plain counts, whatever counts as hot."""
    monkeypatch.setattr(op7_lm, "HOT", hot)
    rows = [(x.doc_id, x.text, zlib.crc32(str(x.doc_id).encode()) % 10 != 0) for x in docs.collect()]
    got = {r.doc_id: r for r in op7_lm.scored(docs.withColumn("train", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0), order).collect()}
    for i, size, known, n, base, score in brute_lm(rows, order):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (size, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(r.score - score) < STEP * size
    assert sum(r.score for r in got.values() if not r.train) > sum(r.base_score for r in got.values() if not r.train)
    if (order, hot) == (2, op7_lm.HOT):
        assert {(r.doc_id, r.score) for r in op7_lm.op7_lm(spark, sf).collect()} == {(i, r.score) for i, r in got.items()}
        for df in (odd, odd.where("false")):
            assert op7_lm.scored(df.withColumn("train", F.col("doc_id") > 1)).count() == df.count()
        assert op7_lm.scored(odd.withColumn("train", F.lit(False))).first().train_tokens == 0


@pytest.mark.parametrize("order", [2, 3])
def test_lm_keeps_rare_contexts(spark, order) -> None:
    """A word that is one of 120 000 tokens still tells the next; two copies tell more than one; a word of nearly all tokens is no other case."""
    rows = [(k, "wordy " * 20000, True) for k in range(6)] + [(6, "seldom heard", True), (7, "seldom heard", False), (8, "heard never", False), (9, "once upon a midnight", True), (10, "twice upon a noon", True), (10, "twice upon a noon", True), (11, None, False)]
    want = brute_lm(rows, order)
    got = [tuple(r) for r in op7_lm.scored(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), order).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    for a, b in zip(sorted(want), sorted(got), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9) and abs(a[5] - b[5]) < STEP * a[1]
    score = {r[0]: r[5] for r in got}
    assert score[10] > score[9] + 0.3


def test_lm_tries_are_written_once(spark, docs) -> None:
    """The tries are a table of one row a shard, read by the step that asks without another exchange of them."""
    train = docs.withColumn("train", F.lit(True))
    model = op7_lm.learn(train, 3)
    tries = op7_lm.build(train, model)
    rows = tries.collect()
    assert sorted(r.shard for r in rows) == sorted(model.shards)
    t = op7_lm.Trie.mapped(bytes(rows[0].trie))
    assert t.names.n and len(t.num3) == t.keys3.n and (t.names.at(np.arange(t.names.n)) == t.name).all()
    assert len(rows[0].trie) < 24 * t.keys3.n  # with its names; three hashes and a count would take 32


def test_packing(spark, sf, docs, odd) -> None:
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    for df in (docs, odd.withColumn("text", F.col("text"))):
        rows = {x.doc_id: x.text for x in df.collect()}
        got = op8_packing.pack(df, path).collect()
        places: dict = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            ids = [*t.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, 2][r.start : r.start + r.length]
            assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32 and len(ids) == r.length
        for p in places.values():
            at = 0
            for o, n in sorted(p):
                assert o == at
                at += n
            assert at <= 1024
        assert len(places) <= 1.05 * sum(r.length for r in got) / 1024 + 1
    assert op8_packing.pack(odd.where("false"), path).count() == 0


def test_plan_uses_each_piece_once() -> None:
    rng = np.random.default_rng(5)
    for size in (16, 64):
        counts = {int(k): int(n) for k, n in enumerate(rng.integers(0, 9, size + 1)) if k and n}
        used: Counter = Counter()
        for pattern, n in op8_packing.plan(counts, size):
            assert sum(pattern) <= size
            for x in pattern:
                used[x] += n
        assert used == counts


def best_fit(lengths, size):
    """Sequences of plain best-fit decreasing."""
    from bisect import bisect_left, insort

    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect_left(gaps, x)
        if k < len(gaps):
            gap = gaps.pop(k)
        else:
            gap, n = size, n + 1
        insort(gaps, gap - x)
    return n


@pytest.mark.parametrize("shape", ["full", "uniform", "middle", "lognormal", "thirds", "pairs"])
def test_plan_is_never_worse_than_best_fit(shape) -> None:
    rng = np.random.default_rng(1)
    lengths = {
        "full": lambda: [1024] * 600 + rng.integers(1, 1025, 900).tolist(), "uniform": lambda: rng.integers(1, 1025, 5000).tolist(), "middle": lambda: rng.integers(300, 1025, 5000).tolist(),
        "lognormal": lambda: np.clip(rng.lognormal(5.5, 1, 5000).astype(int) + 1, 1, 1024).tolist(), "thirds": lambda: [342, 341, 341] * 500 + [700, 200, 124] * 100, "pairs": lambda: [600, 424] * 300 + [500, 300, 224] * 200 + [400, 250, 200, 174] * 100,
    }[shape]()
    made = op8_packing.plan(Counter(lengths))
    used: Counter = Counter()
    for pattern, n in made:
        assert sum(pattern) <= 1024 and list(pattern) == sorted(pattern, reverse=True)
        for x in pattern:
            used[x] += n
    assert used == Counter(lengths) and sum(n for _, n in made) <= best_fit(lengths, 1024)


def test_packing_is_as_tight_as_best_fit(spark) -> None:
    import public_tokenizers

    df = table(spark, "/root/testdata/sf0.01", "documents")
    rows = op8_packing.pack(df, str(public_tokenizers.path("byte_bpe_50k.json"))).select("sequence_id", "length").collect()
    assert len({r.sequence_id for r in rows}) <= best_fit([r.length for r in rows], 1024) <= 964


def test_pii(spark, docs, odd) -> None:
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for k, (kind, pattern) in enumerate(kinds.items()):
            for m in re.finditer(pattern, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
                if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                    out.append((m.start(), k, m.end()))
        return hashlib.sha256(",".join(f"{list(kinds)[k]}:{a}:{b}" for a, k, b in sorted(out)).encode()).hexdigest()

    odds = ["a@b.c_x@d.e y@z.q", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004", "4785-3805-9239-1139 4785 3805 9239 1139 1", "9" * 30000, "a" * 30000 + "@b.c", ".a" * 20000, "1.2.3.4a@b.c.d+15551234567890", "0 " * 13 + "0"]
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odds)], "doc_id long, text string")
    for df in (docs, odd, extra):
        text = {x.doc_id: x.text for x in df.collect()}
        assert all(r.base_sha256 == brute(text[r.doc_id]) for r in op9_pii.report(op9_pii.find(df)).collect())
    clean = {r.doc_id: r.text for r in op9_pii.sanitise(odd).collect()}
    assert clean[6] == "[EMAIL] [IP] [PHONE], [CARD]" and clean[4] == "x" and clean[1] is None
    assert op9_pii.report(op9_pii.find(odd.where("false"))).count() == 0


def test_pii_terms(spark) -> None:
    rows = [(k, f"report by zephyrine who wrote to who@site{0}.org about the harbour matter number {'abcdefgh'[k]}") for k in range(5)] + [(10 + k, f"the harbour report about a matter number {'ijklmnopqrstuvwxyzabcdefghijklmnop'[k]} who wrote") for k in range(30)]
    got = {r.doc_id: r.text for r in op9_pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("zephyrine" not in got[k] and "harbour" in got[k] for k in range(5))
    assert all(got[i] == t for i, t in rows if i >= 10)


def test_pii_terms_of_rare_values_anywhere(spark) -> None:
    """One row is evidence enough, no distance is too far, and a term is marked in rows without the value too."""
    far = "common words stand between " * 10
    rows = [(0, f"Quillon said so. {far}mail to who@site.org"), (1, f"{far}and quillon came back"), (2, None)] + [(10 + k, far + "and said so came back mail") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in op9_pii.sanitise(df).collect()}
    n, text = len(rows), dict(rows)
    assert 1 + math.log(1 / 2) / math.log(n) < op9_pii.DISCLOSURE  # held by two rows of so few, quillon stays
    assert got == text | {0: text[0].replace("who@site.org", "[EMAIL]")}
    more = df.unionByName(spark.range(1000, 2500).select(F.col("id").alias("doc_id"), F.lit("common words").alias("text")))
    got = {r.doc_id: r.text for r in op9_pii.sanitise(more).where("doc_id < 1000").collect()}
    assert got == text | {0: f"[NAME] said so. {far}mail to [EMAIL]", 1: f"{far}and [WORD] came back"}  # two rows of so many: generalised


def test_pii_terms_are_those_of_plain_counts(spark, docs) -> None:
    """Term spans against the rule written out, over whole texts."""
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = {r.doc_id: r.spans for r in op9_pii.find(docs).collect()}
    spans = {i: {t[a:b].lower() for a, k, b in ((s.start, s.kind, s.end) for s in got[i]) if k == 4} for i, t in rows}
    words_of = {i: {w.lower() for w in regex.findall(r"\p{L}{3,}", t)} for i, t in rows}
    entities = {i: {(s.kind, t[s.start : s.end].lower()) for s in got[i] if s.kind < 4} for i, t in rows}
    n, n_t, n_e = len(rows), Counter(w for ws in words_of.values() for w in ws), Counter(e for es in entities.values() for e in es)
    n_te = Counter((w, e) for i in words_of for w in words_of[i] for e in entities[i])
    risk: dict = {}
    for (w, e), k in n_te.items():
        if n_e[e] < n:
            risk[w] = max(risk.get(w, 0), 1 + math.log(k / n_t[w]) / -math.log(n_e[e] / n))
    risky = {w for w, r in risk.items() if r >= op9_pii.DISCLOSURE - 1e-12}
    assert risky
    for i, t in rows:
        inside = [(s.start, s.end) for s in got[i] if s.kind < 4]
        free = {m[0].lower() for m in regex.finditer(r"\p{L}{3,}", t) if all(m.end() <= a or b <= m.start() for a, b in inside)}
        assert spans[i] == free & risky


def test_pii_of_long_texts(spark) -> None:
    """Thousands of values in one text, overlapping ones, and characters outside the basic plane; time grows with the text."""
    many = " ".join(f"u{k}@x{k % 7}.org \U0001f600" for k in range(6000))
    texts = [many, "a@1.2.3.4 b", "x " * 2500 + "+1 (743) 555-3824" + " y" * 2500, "\U0001f600" * 3000 + "a@b.co" + "\U0001f600" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r.text for r in op9_pii.sanitise(df).collect()}
    assert time.time() - start < 60
    assert got[0] == " ".join("[EMAIL] \U0001f600" for _ in range(6000)) and got[1] == "[EMAIL] b"
    assert got[2] == "x " * 2500 + "[PHONE]" + " y" * 2500 and got[3] == "\U0001f600" * 3000 + "[EMAIL]" + "\U0001f600" * 3000


def test_embeddings(spark, sf, odd) -> None:
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    rows = [(k, [float(v) for v in base[k % 40] + (rng.normal(size=16) * 0.05 if k >= 40 else 0)], k % 40 % 3) for k in range(200)]
    rows += [(900, rows[0][1], 0), (901, rows[0][1], None), (902, None, 0), (903, [0.0] * 16, 0), (904, [float("nan")] * 16, 0), (905, [1.0, None], 0), (906, [], 0), (907, [2.0, 0.0], 0), (908, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("cell", F.lit("x"))
    links: dict = {r[0]: set() for r in rows}
    ok = [(i, np.array(v, float), n) for i, v, n in rows if n is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for i, v, n in ok:
        for j, w, m in ok:
            if i != j and n == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i].add(j)
    least = {i: i for i in links}
    for _ in range(20):
        least = {i: min([least[i], *(least[j] for j in links[i])]) for i in links}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op10_embeddings.near_duplicates(df).collect()}
    assert got == {i: (len(links[i]), least[i], least[i] == i) for i in links}
    assert op10_embeddings.near_duplicates(df.where("false")).count() == 0
    for kind in ("string", "bigint", "decimal(20,2)"):
        big = F.when(F.col("label").isNotNull(), F.concat(F.lit("9000000000" if kind != "string" else "label "), F.col("label").cast("string"))).cast(kind)
        again = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op10_embeddings.near_duplicates(df.withColumn("label", big)).collect()}
        assert again == got


def test_queries_cover_all_thirteen() -> None:
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline(spark, sf) -> None:
    """Each stage against brute force over its own input."""
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns
    field = op2_quality.train(docs, table(spark, sf, "labels"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if op2_quality.judge(r.text, field)[6]}
    one = corpus_pipeline.jaccard_join(spark, kept, sf)
    assert {r.doc_id for r in one.collect()} == {c for _, c in brute_components([(r.doc_id, r.text) for r in kept.collect()]).values()}
    safe = corpus_pipeline.personal_data(spark, one, sf)
    assert safe.columns == docs.columns and safe.count() == one.count()
    assert op9_pii.report(op9_pii.find(safe)).where("n_email + n_ip + n_phone > 0").count() == 0
    mixed = corpus_pipeline.mixing(spark, safe, sf)
    copies = {r.doc_id: r.copies for r in op5_mixing.mix(safe).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, sf).count() > 0
