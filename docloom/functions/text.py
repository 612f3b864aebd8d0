"""Text columns: keys, slugs, snippets, redaction, hashes, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"
#: Legal suffixes of company names; a fixed value.
SUFFIXES = (" pvt ltd", " pvt. ltd.", " private limited", " ltd.", " ltd", " limited", " inc.", " inc", " incorporated", " l.l.c.", " llc", " corp.", " corp", " corporation", " plc", " gmbh", " s.a.", " sa", " n.v.", " nv", " b.v.", " bv", " co.", " co")


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(c, rf"(?U)^\s+|\s+$", "")


def alias_key(c: Column) -> Column:
    """Stripped, lower-cased, runs of white space as one space."""
    return strip(F.regexp_replace(F.lower(c), rf"{SPACE}+", " "))


def slug(c: Column) -> Column:
    """Lower-case key of a name: one legal suffix dropped, other runs of signs as one underscore; empty: unknown."""
    bare = strip(F.lower(c))
    ends = "|".join(s.replace(".", r"\.") for s in sorted(SUFFIXES, key=len, reverse=True))
    cut = F.regexp_replace(bare, f"(?:{ends})$", "")
    out = F.regexp_replace(F.regexp_replace(cut, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(out, "^$", "unknown")  # not by a condition, which would make it twice


def canonical_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), slug(c))


def snippet(c: Column, size: int = 280) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


#: What is redacted, in this order; fixed values.
SECRETS = (("API_KEY", r"\b(sk|gsk|pk|api)[-_][A-Za-z0-9]{16,}\b"), ("BEARER_TOKEN", r"(?i)Bearer\s+[A-Za-z0-9._-]{16,}"), ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))


def redacted(c: Column) -> Column:
    for name, pattern in SECRETS:
        c = F.regexp_replace(c, pattern, f"[REDACTED_{name}]")
    return c


def contract_literal(c: Column) -> Column:
    return F.regexp_replace(F.upper(strip(c)), r"[^\p{L}\p{N}/-]", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def extension(name: Column) -> Column:
    """The last extension with its point, lower-cased; empty if there is none or the name begins or ends with it."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^./]+)$", 1))


def display_name(name: Column) -> Column:
    out = F.regexp_replace(F.substring(F.regexp_replace(strip(name), "\u0000", ""), 1, 512), r"[^A-Za-z0-9._ ()\[\]-]", "_")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("upload")).otherwise(out)


def paragraphs(c: Column) -> Column:
    """Non-empty paragraphs, white space within each as one space."""
    parts = F.transform(F.split(c, r"\n\s*\n+"), lambda p: strip(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda p: p != "")


def word_count(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, rf"{SPACE}+"))).cast("int")


def mention(text: Column, raw: Column, reach: int = 60) -> tuple[Column, Column]:
    """Offset of raw in text, whatever the case, and the text around it; null and raw itself if it is not there."""
    at = F.call_function("locate", F.lower(raw), F.lower(text)) - 1
    start = F.greatest(F.lit(0), at - reach)
    around = F.substring(text, start + 1, at + F.length(raw) + reach - start)
    return F.when(at >= 0, at), F.when(at >= 0, around).otherwise(raw)


def query_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9][A-Za-z0-9.\-]*"), F.lit(0))


def kind_of_id(c: Column) -> Column:
    """What stands before the first colon of a canonical id; unknown without one."""
    return F.when(F.contains(c, F.lit(":")), F.element_at(F.split(c, ":"), 1)).otherwise("unknown")


def candidate_keys(c: Column) -> Column:
    """Alias keys to look up in order: the whole text, then each word, a dollar sign apart and marks at the ends dropped."""
    words = F.split(strip(F.replace(c, F.lit("$"), F.lit(" $ "))), rf"{SPACE}+")
    return F.concat(F.array(alias_key(c)), F.transform(words, lambda w: alias_key(F.regexp_replace(w, r"^[().,]+|[().,]+$", ""))))


def keys_of_words(c: Column) -> Column:
    """The alias keys of the whole text and of each word between ASCII white space, a dollar sign apart and marks at the ends of words dropped.

    By patterns on the whole text, a line for each key: a function over arrays, which is not compiled, would ask each word for itself."""
    lines = F.regexp_replace(F.trim(F.regexp_replace(c, r"\$", r" \$ ")), r"\s+", "\n")
    bare = F.regexp_replace(lines, r"(?<![^\n])[().,]+|[().,]+(?=[\x85\u2028\u2029]?(?:\n|\z))", "")
    spaced = F.regexp_replace(F.lower(bare), r"(?U)[\s&&[^\n]]+", " ")
    return F.split(F.concat(alias_key(c), F.lit("\n"), F.regexp_replace(spaced, r"(?<![^\n]) | (?=\n|\z)", "")), "\n")
