"""HTML extraction: a page as a flat run of text blocks, each classified by a decision tree.

A block ends at every block-level tag. Its features are its word count and link density, those of the block before and of
the block after, whether it lies in an article, how its containers are marked (not, weakly, strongly), whether it is a
heading and whether it is a notice by its words: a short block that begins with a statement on cookies or a copyright sign, or at most
CALL_WORDS words that call to act and are no sentence; never a heading. Elements that are hidden by attribute or by their own style are left out. The tree is grown here, by Gini impurity, from the small labelled pages
EXAMPLES below, most of which mark nothing by names; content blocks are joined in page order.

Marks: ``nav``, ``aside``, ``footer``, ``menu`` and ``dialog`` are strong, as are names of comments; other side names
count as whole tokens of class, id or role, strongly for blocks directly inside and weakly below a further container. Names
on an article, on ``main`` or on what they stand in say nothing of the blocks inside.

The scan is linear: a tag whose quotes never close switches to a plain reading of what follows, and the search for the
element that an end tag closes gives up what it has passed.

Defined results: null or empty html, or a page without content: empty text, 0. Unclosed elements end with their parent
(p, li, dt, dd, tr, td and th also with their next sibling, of those within LOOK open elements; of inline elements INLINE a block are told apart, text in deeper ones stays); what a parser would call broken markup never fails. Repeated
rows are answered each. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, strings, table

# Names of elements and of classes.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("audio button canvas datalist head math noscript object select svg template video".split())
RAW_NAMES = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SIDE = frozenset("nav footer aside menu dialog search".split())
BODY = frozenset("article main".split())
CONTAINERS = frozenset("div section center td table".split())
COMMENT_NAMES = frozenset("comment comments comment-area comment-body comment-content comment-form comment-list comment-respond comments-area comments-list commentlist disqus disqus_thread replies reply respond".split())
STRONG_NAMES = frozenset("ad ads advert advertisement adverts breadcrumb breadcrumbs complementary contentinfo cookie cookie-banner cookie-consent cookie-notice cookies copyright footer menu modal nav navbar navigation pager pagination popup sidebar site-footer site-header site-nav sponsored".split())
WEAK_NAMES = frozenset("disclaimer hidden login newsletter notice notices promo promoted recommended related share sharing signup social sponsor subscribe subscription tags toolbar widget widgets".split())
HEADER_NAMES = frozenset("banner header masthead".split())
#: Notices that say what they are, and calls to act, which count only if they are the whole of a short block that is no sentence.
NOTICE = re.compile(r"(?:we|this (?:web)?site|our (?:web)?site) uses? cookies\b|by (?:using|continuing to (?:use|browse)) (?:this|our) (?:web)?site\b|\u00a9", re.I)
CALL = re.compile(r"(?:accept(?: all)?(?: cookies)?|subscribe|sign (?:up|in)|log ?in|share (?:this|on|via)|follow us|advertisements?|sponsored|skip to|privacy policy|terms of (?:use|service)|related (?:posts|articles|stories)|you (?:may|might) also like|leave a (?:comment|reply)|[0-9]+ comments?$)\b", re.I)
NOTICE_WORDS, CALL_WORDS = 20, 5
#: Names that are made of others: an element for comments or consent, by whole parts of a token.
COMMENT_PARTS = re.compile(r"(?:user|reader|visitor|guest)-comments?|comments?-[0-9]+")
CONSENT_PARTS = re.compile(r"(?:cookies?|gdpr|consent)(?:-[a-z]+)*")

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: For what follows a tag that never closes by the rule above: it ends where the next one starts.
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)([^<>]*+)>?")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?", re.S)
NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
UNSHOWN = re.compile(r"(?<![\w-])style\s*=\s*(?:\"[^\"]*|'[^']*|)display\s*:\s*none", re.I)
RAW_END = {k: re.compile(rf"</{k}(?![\w-])[^>]*>?", re.I) for k in RAW_NAMES}
#: Which open siblings a start tag closes, and how far up it looks; open inline elements that one block tracks.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
BOUNDS = frozenset("ul ol menu dir dl table tbody thead tfoot select article main body".split())
LOOK, INLINE = 64, 512

#: The labelled table: pages in which +n stands for n words of content and -n for n words of anything else; written words
#: are not content either.
EXAMPLES = """
<body><nav><ul><li><a>-1</a></li><li><a>-2</a></li></ul></nav><article><h1>+6</h1><p>+45</p><p>+3</p><p>+80 <a>+4</a></p><h2>+2</h2><ul><li>+3</li><li>+7</li><li>+2</li></ul><p>+22</p></article><footer>-9</footer></body>
<header><a>-2</a> <p>-5</p></header><main><h1>+4</h1><p>+120</p><p>+4 <a>+9</a></p><p>+60</p></main><aside><h3>-2</h3><p>-130</p><ul><li><a>-4</a></li></ul></aside><footer><p>-40</p><p>-6</p></footer>
<body><ul><li><a>-1</a></li><li><a>-2</a></li><li><a>-1</a></li></ul><h1>+5</h1><p>+50</p><h2>+3</h2><p>+35</p><p>+4</p><p>+28</p></body>
<div><a>-1</a> <a>-1</a> <a>-2</a></div><div><h1>+3</h1><p>+9</p><p>+70</p></div><div><a>-2</a> -1 <a>-2</a></div>
<div><p>+3</p></div>
<p>+1</p>
<body>+7</body>
<body><h1>+2</h1><p>+5</p></body>
<body><p>+4</p><p>+6</p><p>+3</p></body>
<div>+12</div><div>+30</div><div>+5</div>
<article><p>+3</p></article>
<article><h2>+1</h2><p>+2</p><p>+2</p><p>+1</p></article>
<article><p>+40</p><h3>-2</h3><ul><li><a>-4</a></li><li><a>-5</a></li><li><a>-3</a></li><li><a>-6</a></li></ul></article>
<article><p>+40</p><ul><li><a>-4</a></li><li><a>-5</a></li><li><a>-3</a></li></ul><p>+25</p></article>
<article><p>+30</p><p>+1 <a>+8</a></p><p>+45</p><p><a>+12</a></p><p>+50</p></article>
<article><p>+18</p><p><a>+7</a></p><p>+33</p></article>
<article><p>+30</p><div>We use cookies here.</div><p>+20</p><p>Subscribe to our letter</p><p>+12</p><p>Share this</p></article>
<body><p>+30</p><div>We use cookies here.</div><p>+20</p><div>Terms of use</div></body>
<div class=widget><p>-3</p><p>-14</p></div><div class=widget><p>+120</p><p>+95</p></div><p>+40</p><div class=share>-1</div><p>+33</p><div class=related><h4>-2</h4><a>-6</a></div>
<div class=ad>-3</div><p>+40</p><div class=ad>-45</div><p>+30</p><div class=comments><p>-20</p><p>-140</p><div><div><p>-60</p></div></div></div>
<form><p>-3</p><p>-8</p></form><form><p>+70</p><p>+45</p><p>+90</p></form>
<div class=sidebar><p>-12</p><div><p>-9</p><p>-30</p></div><div><p>+100</p><p>+90</p></div></div>
<div><a>-3</a></div><div><a>-2</a></div><div>+25</div><div>+4</div><div>+60 <a>+5</a></div><div><a>-10</a></div><div><a>-14</a></div><div><a>-11</a></div>
<body><p>-2 <a>-3</a></p><ul><li><a>-2</a> -1</li><li><a>-2</a></li></ul><p>+16</p><table><tr><td>+1</td><td>+2</td></tr><tr><td>+1</td><td>+3</td></tr></table><p>+11</p></body>
<div><h2>-2</h2><ul><li><a>-5</a></li><li><a>-6</a></li></ul></div><div><h1>+7</h1><p>+26</p><blockquote>+8</blockquote><p>+19</p></div>
<body><p><a>-2</a> <a>-2</a></p><h1>+4</h1><p>+15</p></body>
<article><h1>+5</h1><p>+9</p></article><ul><li><a>-3</a></li><li><a>-2</a></li></ul>
<article><p>+1</p><h2><a>+4</a></h2><p>+60</p><p>+2</p><p><a>+6</a></p><p>+30</p></article>
<article><h1>+4</h1><p>+2</p><p><a>+9</a></p><p>+55</p></article>
<div><p>+14</p><p>+6</p></div><div><a>-2</a> <a>-3</a></div>
<aside><p>-70</p><p>-110</p><p>-200</p><p>-55</p><p>-80</p></aside><p>+66</p><footer><p>-75</p><p>-100</p><p>-300</p></footer>
<div class=widget><p>+75</p><p>+85</p><p>+160</p><p>+66</p><p>+300</p></div>
<div class=comments><p>-62</p><p>-90</p><p>-122</p><p>-170</p><p>-500</p><p>-4</p></div>
"""


class Block(tuple):
    """Text, words, link density in percent, in an article, mark of its containers, heading, starts like a notice."""


class _Frame:
    __slots__ = ("name", "block", "body", "side", "named", "comments", "skip")

    def __init__(self, name: str, block: bool, up: _Frame | None):
        self.name, self.block = name, block
        self.body, self.side, self.named, self.comments, self.skip = (up.body, up.side, up.named, up.comments, up.skip) if up else (0, 0, 0, 0, 0)


def _notice(text: str, n: int) -> bool:
    return bool(n <= NOTICE_WORDS and NOTICE.match(text) or n <= CALL_WORDS and text[-1] not in ".!?:;\u2026" and CALL.match(text))


def _unseen(attributes: str) -> bool:
    """Whether an element says that it is not shown."""
    return bool(HIDDEN.search(QUOTED.sub("", attributes)) or UNSHOWN.search(attributes))


def _marked(f: _Frame, up: _Frame | None, said: set[str]) -> None:
    """side: marks that elements give, 0 to 2; named: marks that names give, which weaken below a further container."""
    if f.name in ("html", "body"):
        return
    if said & COMMENT_NAMES or any(COMMENT_PARTS.fullmatch(w) for w in said):
        f.side, f.comments = 2, 1
        return
    if f.name in BODY:
        if not f.comments:
            f.named = 0
            f.side = f.side if f.side == 2 else 0
            f.body = 1
        return
    if up and up.named and f.name in CONTAINERS:
        f.named = 1
    if f.name in SIDE or (said & {"navigation", "contentinfo", "complementary"} and f.name != "div"):
        f.side = 2
    elif f.name == "form" or (f.name == "header" and not f.body):
        f.side = max(f.side, 1)
    if said & STRONG_NAMES or any(CONSENT_PARTS.fullmatch(w) for w in said):
        f.named = 2
    elif said & WEAK_NAMES or (said & HEADER_NAMES and not f.body):
        f.named = max(f.named, 1)


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text."""
    out: list[Block] = []
    stack: list[_Frame] = []
    open_: Counter = Counter()
    parts: list[str] = []
    linked = 0
    within = 0  # inline elements open in the innermost block
    at, end, tag = 0, len(page), TAG
    missing: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            n = text.count(" ") + 1
            f = next((f for f in reversed(stack) if f.block), None)
            head = int(any(x.name in HEADINGS for x in stack[-LOOK:]))
            out.append(Block((text, n, min(100.0, 100.0 * linked / n), f.body if f else 0, max(f.side, f.named) if f else 0, head, int(not head and _notice(text, n)))))
        parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal within
        for f in stack[k:]:
            open_[f.name] -= 1
        del stack[k:]
        within = 0
        for f in reversed(stack):
            if f.block or within > INLINE:
                break
            within += 1

    def innermost() -> int:
        k = len(stack) - 1
        while k >= 0 and not stack[k].block:
            k -= 1
        return k

    while at < end:
        lt = page.find("<", at)
        text = page[at : lt if lt >= 0 else end]
        if text and not (stack and stack[-1].skip):
            text = entities.unescape(text)
            parts.append(text)
            if open_["a"]:
                linked += len(text.split())
        if lt < 0:
            break
        after = page[lt + 1 : lt + 3]
        if after[:1] in ("!", "?"):
            at = COMMENT.match(page, lt).end()
            continue
        if not re.match(r"/?[A-Za-z]", after):
            if after[:1] == "/":  # an end tag without a name
                gt = page.find(">", lt)
                at = gt + 1 if gt >= 0 else end
            else:
                if not (stack and stack[-1].skip):
                    parts.append("<")
                at = lt + 1
            continue
        m = tag.match(page, lt)
        if not m:
            tag = LOOSE_TAG
            m = tag.match(page, lt)
        at = m.end()
        name = m[2].lower()
        block = name in BLOCKS or name in SKIPPED
        if name in BLOCKS:
            flush()
        if m[1]:
            if not open_[name]:
                continue
            k = len(stack) - 1
            while stack[k].name != name and (block or not stack[k].block):
                k -= 1
                if k < 0:
                    break
            if k >= 0 and stack[k].name == name:
                pop_to(k)
            continue
        if name in VOID or m[3].endswith("/"):
            if name == "br":
                parts.append(" ")
            continue
        if name in RAW_NAMES:
            over = None if name in missing else RAW_END[name].search(page, at)
            if over:
                at = over.end()
            elif name in ("script", "style"):
                at = end
            else:
                missing.add(name)
            continue
        if name in BLOCKS:
            k = innermost()
            if k >= 0 and stack[k].name == "p":
                pop_to(k)
            if name in CLOSES:
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - LOOK), -1):
                    if stack[k].name in BOUNDS:
                        break
                    if stack[k].name in CLOSES[name]:
                        pop_to(k)
                        if name != "tr" or not any(f.name == "tr" for f in stack[-2:]):
                            break
        elif name == "a" and open_["a"]:
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - LOOK), -1):
                if stack[k].name == "a":
                    pop_to(k)
                    break
        if not block and within >= INLINE:
            continue
        up = stack[-1] if stack else None
        f = _Frame(name, block, up)
        f.skip = f.skip or int(name in SKIPPED or bool(m[3]) and _unseen(m[3]))
        if block:
            # only whole tokens count; role="x" is read like a name
            _marked(f, up, {w for g in NAMES.findall(m[3]) for w in (g[1] or g[2] or g[3]).lower().split()} if m[3] else set())
        within = 0 if block else within + 1
        open_[name] += 1
        stack.append(f)
    flush()
    return out


PAD = Block(("", 0, 0.0, 0, 0, 0, 0))
FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in an article", "mark", "heading", "notice")


def features(found: list[Block]) -> list[tuple]:
    return [(b[1], b[2], before[1], before[2], after[1], after[2], *b[3:]) for before, b, after in zip([PAD, *found], found, [*found[1:], PAD], strict=False)]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple | int:
    """A tree of (feature, threshold, at most, above); a leaf is the class. Ties go to the first feature and threshold."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            gini = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(cut), left)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, cut, left = best
    return f, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of the blocks of EXAMPLES."""
    x, y = [], []
    for page in EXAMPLES.strip().split("\n"):
        found = blocks(re.sub(r"([+-])([0-9]+)", lambda m: " ".join(["k" if m[1] == "+" else "d"] * int(m[2])), page))
        x += features(found)
        y += [int(b[0][0] == "k") for b in found]
    return np.array(x, float), np.array(y)


def small_tree() -> tuple | int:
    return grow(*labelled())


def classify(tree: tuple | int, x: tuple) -> bool:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return bool(tree)


def main_text(page: str | None, tree: tuple | int) -> str:
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, x in zip(found, features(found), strict=True) if classify(tree, x))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with text and n_chars."""
    tree = small_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, tree) for p in strings(b["html"])]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
