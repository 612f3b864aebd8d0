"""Personal data: pattern spans, and terms that disclose them, in DataFrame operations only.

Spans of the four base kinds come from patterns; every found value is a protected entity. Then the corpus says which terms
give an entity away: for a term t and an entity e, with n(t, e) the rows that hold both, n(t) the rows that hold t, n(e)
those with e, and N all rows,

    PMI(t; e) / IC(e) = 1 + log(n(t, e) / n(t)) / -log(n(e) / N)

is the part of the entity's information that the term discloses. From DISCLOSURE on the term is a span of kind ``term``
wherever it occurs, in rows without an entity too. Every term of a row counts, however far from the value, and every
entity, however rare: one that occurs in a single row is disclosed by each term that few other rows hold.
Sanitising replaces a base span by its kind in brackets. A term is generalised to its class ([NAME] if capitalised, [ACRONYM]
if all its letters are capitals, else [WORD]); from REMOVAL on it is removed, which [TERM] marks.

Counts cover the whole corpus: document frequencies are map-side sums over all texts, then joined with the terms of rows
that hold an entity. Entities of the very same rows disclose alike, so they are put together before they meet terms: a row
with thousands of addresses that occur nowhere else gives its terms once. Terms so frequent that no entity of this corpus
lets them reach DISCLOSURE are left out first, which changes no result. Positions are running sums over blocks of matches,
and texts are cut by blocks of characters, so the work grows with the text and hardly with its square. No pattern backtracks
without bound or recurses with the text's length.

Defined results: null text is empty: no spans, the digest of the empty string. Spans are in code points, end exclusive;
term spans that would overlap a base span are dropped. An entity of all rows has no information to disclose. Repeated rows
are found alike, each a row of evidence. Other columns are kept by sanitise() and ignored by find().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

DISCLOSURE, REMOVAL = 0.9, 0.97
KINDS = ("email", "ip", "card", "phone", "term")

# The patterns of the base kinds, possessive and anchored to where a leftmost match must start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"\p{L}{3,}"

#: Matches that a block of a running sum holds, and characters of a block of text.
RUN, CUT = 64, 2048

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid_ip(m: Column) -> Column:
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    small = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255
    return F.forall(F.split(m, r"\."), lambda p: part(p) & small(p))


def _valid_card(m: Column) -> Column:
    digits = F.split(F.reverse(_digits(m)), "(?<=.)(?=.)")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's integers, op over 0 and those before it; within blocks, then over blocks."""
    zero = F.lit(0)

    def before(array: Column, first: Column) -> Column:
        return F.aggregate(array, F.array(first), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(zero, F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / RUN).cast("int")), lambda k: F.slice(v, k * RUN + 1, RUN))

    def joined(b: Column) -> Column:
        heads = before(F.transform(b, lambda c: F.aggregate(c, zero, op)), zero)
        return F.flatten(F.zip_with(b, F.slice(heads, 1, F.size(b)), lambda c, h: F.slice(before(c, h), 1, F.size(c))))

    return let(values, lambda v: let(blocks(v), joined))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost matches that do not overlap, by the lengths of the parts between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.zip_with(found, between, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), (F.length(g) + F.length(m)).alias("step")))
    span = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["step"]).alias("end"), x["m"].alias("value"))
    return let(F.filter(parts, lambda x: x["m"].isNotNull()), lambda p: F.zip_with(p, running(F.transform(p, lambda x: x["step"]), lambda a, x: a + x), span))


def base_spans(text: Column) -> Column:
    """The base spans of a text, ordered by start, then kind."""
    def passing(spans: Column, valid) -> Column:
        return F.filter(spans, lambda s: valid(s["value"])) if valid else spans

    def of_kind(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    found = []
    for kind, (pattern, hint, valid) in enumerate(((EMAIL, r"@[A-Za-z0-9-]+\.", None), (IP, r"[0-9]\.[0-9]+\.[0-9]", _valid_ip), (CARD, r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", _valid_card), (PHONE, r"\+[0-9]", _valid_phone))):
        found.append(F.when(F.rlike(text, F.lit(hint)), of_kind(passing(matches(text, pattern), valid), kind)).otherwise(F.array().cast(_SPANS)))
    return F.array_sort(F.concat(*found))


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _places(text: Column, terms: Column) -> Column:
    """The spans of a text's words that are among terms."""
    hits = F.filter(matches(text, TERM), lambda m: F.array_contains(terms, F.lower(m["value"])))
    return F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(4).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))


def _risky(docs: DataFrame) -> DataFrame:
    """_pii_key, _pii_terms, _pii_removed: the terms in each row of docs (_pii_key, text) that disclose an entity of the corpus, and those of them past REMOVAL."""
    text = F.coalesce("text", F.lit(""))
    entity = lambda s: F.sha2(F.concat_ws(":", s["kind"], F.lower(s["value"])), 256)
    spans = docs.select(text.alias("text")).withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    rows = stash(spans.select(F.monotonically_increasing_id().alias("row"), F.array_distinct(F.transform("spans", entity)).alias("entities"), _words(F.col("text")).alias("terms")), "entities")
    n = docs.count()
    # entities of the very same rows have the same count and sum of the rows' hashes
    per = rows.select("row", F.explode("entities").alias("entity"))
    like = per.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("rows")).where(F.col("n_e") < n)
    classes = stash(per.join(like, "entity").select("row", "n_e", "rows").distinct().groupBy("row").agg(F.collect_list(F.struct("n_e", "rows")).alias("classes")), "classes")
    held = docs.where("text is not null").select("_pii_key", F.explode(_words(F.col("text"))).alias("term"))
    n_t = stash(held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "n_t")
    # n_te is at most n_e, so no term of more rows than this is risky; of terms in over a thousandth of all rows there are at
    # most a thousand times the mean number of terms of a row
    most = (classes.agg(F.max(F.array_max(F.transform("classes", lambda c: c["n_e"]))).alias("m")).first().m or 0) ** DISCLOSURE * max(n, 1) ** (1 - DISCLOSURE)
    frequent = F.broadcast(n_t.where((F.col("n_t") > most * 1.001) & (F.col("n_t") > n / 1000)).select("term"))
    both = rows.select("row", "terms").join(classes, "row").select("classes", F.explode("terms").alias("term")).join(frequent, "term", "left_anti")
    n_te = both.select("term", F.explode("classes").alias("c")).groupBy("c", "term").agg(F.count(F.lit(1)).alias("n_te"))
    part = 1 + F.log(F.col("n_te") / F.col("n_t")) / -F.log(F.col("c.n_e") / F.lit(float(max(n, 1))))
    risky = stash(n_te.join(n_t, "term").withColumn("part", part).where(F.col("part") >= DISCLOSURE - 1e-12).groupBy("term").agg((F.max("part") >= REMOVAL - 1e-12).alias("removed")), "risky")
    found = held.join(frequent, "term", "left_anti").join(risky, "term")
    return found.groupBy("_pii_key").agg(F.collect_set("term").alias("_pii_terms"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("_pii_removed"))


def _spanned(docs: DataFrame) -> DataFrame:
    """docs with _pii_spans, base and term spans, ordered, and _pii_removed, the terms that go.

    The key of a row is a hash of its id and text. Rows of one key would share their terms, of which each takes those it holds."""
    keyed = docs.withColumn("_pii_key", F.xxhash64("doc_id", "text"))
    both = keyed.join(_risky(keyed.select("_pii_key", "text")), "_pii_key", "left").drop("_pii_key")
    text = F.coalesce("text", F.lit(""))
    both = both.withColumn("_pii_base", base_spans(text)).withColumn("_pii_places", F.when(F.col("_pii_terms").isNotNull(), _places(text, F.col("_pii_terms"))))
    clear = F.filter("_pii_places", lambda t: ~F.exists("_pii_base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    spans = F.when(F.col("_pii_places").isNull(), F.col("_pii_base")).otherwise(F.array_sort(F.concat("_pii_base", clear)))
    return both.withColumn("_pii_spans", spans).drop("_pii_base", "_pii_places", "_pii_terms")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, kind, end; base and term spans, ordered) for docs (doc_id, text)."""
    return _spanned(docs.select("doc_id", "text")).select("doc_id", F.transform("_pii_spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("spans"))


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])), F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count(4).alias("n_term"), F.size("spans").cast("long").alias("n_spans"))


def _replaced(text: Column, spans: Column, removed: Column) -> Column:
    """text with its spans (ordered, perhaps overlapping) replaced: a span that starts inside another one goes with it."""
    shape = lambda v: F.when(v == F.lower(v), "[WORD]").when((v == F.upper(v)) & (F.length(v) > 1), "[ACRONYM]").when(F.substring(v, 1, 1) != F.lower(F.substring(v, 1, 1)), "[NAME]").otherwise("[WORD]")
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    name = lambda s: F.when((s["kind"] == 4) & ~F.coalesce(F.array_contains(removed, F.lower(s["value"])), F.lit(False)), shape(s["value"])).otherwise(F.element_at(kinds, s["kind"] + 1))

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        """The characters from a to b, of the blocks that hold them."""
        first = F.floor(a / CUT).cast("int")
        some = F.slice(blocks, first + 1, F.floor((b - 1) / CUT).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a - first * CUT + 1, b - a)).otherwise("")

    def joined(blocks: Column, spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        parts = F.zip_with(spans, ends, lambda s, at: F.concat(cut(blocks, at, s["start"]), F.when(s["start"] >= at, name(s)).otherwise("")))
        return F.concat(F.array_join(parts, ""), cut(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0)), lambda blocks: let(spans, lambda s: joined(blocks, s)))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced, and n_chars, where there is one, counted anew."""
    both = _spanned(docs)
    clean = F.when(F.col("text").isNull() | (F.size("_pii_spans") == 0), F.col("text")).otherwise(_replaced(F.col("text"), F.col("_pii_spans"), F.col("_pii_removed")))
    out = both.withColumn("text", clean).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(table(spark, sf_dir, "documents")))
