"""Tables of record: changes of rows, embedding upserts, corpus builds, registries, prompts, signed keys, document metadata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pdf_date
from ..functions.text import alias_key, word_count


def updated(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """rows with the values that changes (key, some columns; one row a key) gives for them; rows without a change stay, nulls are values."""
    names = [c for c in changes.columns if c not in key]
    j = rows.join(changes.select(*key, F.struct(*names).alias("_new")), key, "left")
    return j.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns))


def deleted(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """rows but those whose key is among keys, which may come from another table."""
    return rows.join(keys.select(*key).distinct(), key, "left_anti")


def appended(df: DataFrame, path: str) -> None:
    """Many rows in one write."""
    df.write.mode("append").parquet(path)


def of_dimension(vectors: DataFrame, column: str, dimension: int) -> DataFrame:
    """vectors; a row of another dimension fails the job."""
    said = F.concat(F.lit(f"{column} has "), F.size(column).cast("string"), F.lit(f" dimensions, not {dimension}"))
    return vectors.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == dimension), F.col(column)).otherwise(F.raise_error(said)))


def embedded(items: DataFrame, store: DataFrame, embed: Column) -> DataFrame:
    """The store (source_id, hash, vector) row of each item (seq, source_id, text) in input order, made by embed where new or changed.

    fresh tells which were embedded; words counts what was sent for them."""
    now = items.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    j = now.join(store.select("source_id", F.col("hash").alias("_old"), F.col("vector").alias("_vector")), "source_id", "left")
    fresh = ~F.col("_old").eqNullSafe(F.col("hash"))
    return j.select("seq", "source_id", "hash", F.when(fresh, embed).otherwise(F.col("_vector")).alias("vector"), fresh.alias("fresh"), F.when(fresh, word_count(F.col("text"))).otherwise(0).alias("words")).orderBy("seq")


def accounting(rows: DataFrame) -> DataFrame:
    """chunks, embedded, skipped, words of a cycle; rows as embedded() gives them."""
    return rows.agg(F.count("*").alias("chunks"), F.count_if("fresh").alias("embedded"), F.count_if(~F.col("fresh")).alias("skipped"), F.sum("words").alias("words"))


def company_registry(nodes: DataFrame) -> DataFrame:
    """registry, alias, canonical_id, canonical_name of the live company nodes (canonical_id, node_type, display_name, aliases, status); a key goes to its first id."""
    n = nodes.where("node_type = 'company' and status = 'active'")
    keys = n.select("canonical_id", "display_name", F.explode(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    best = keys.withColumn("alias", alias_key(F.col("a"))).where("alias <> ''").groupBy("alias").agg(F.min_by("display_name", "canonical_id").alias("canonical_name"), F.min("canonical_id").alias("canonical_id"))
    return best.select(F.lit("company").alias("registry"), "alias", "canonical_id", "canonical_name")


def entries(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (canonical_id, ...) with canonical_name and aliases of that id, null where it is unknown; a registry's row an alias."""
    by_id = registry.groupBy("canonical_id").agg(F.first("canonical_name").alias("canonical_name"), F.array_sort(F.collect_set("alias")).alias("aliases"))
    return rows.join(by_id, "canonical_id", "left")


def prompt_hash(system: Column, template: Column) -> Column:
    return F.sha2(F.concat(system, F.lit("\n---\n"), template), 256)


def _version(c: Column) -> Column:
    part = F.split(c, r"\.")
    return F.struct(F.get(part, F.lit(0)).cast("int").alias("major"), F.get(part, F.lit(1)).cast("int").alias("minor"))


def registered(prompts: DataFrame, new: DataFrame) -> DataFrame:
    """prompts (name, version, ...) and new ones; a version that is there already fails, for versions do not change."""
    seen = prompts.select("name", "version").distinct().withColumn("_seen", F.lit(True))
    j = new.join(seen, ["name", "version"], "left")
    name = F.when(F.col("_seen").isNull(), F.col("name")).otherwise(F.raise_error(F.concat("name", F.lit(" "), "version", F.lit(" is already registered"))))
    return prompts.unionByName(j.withColumn("name", name).drop("_seen"))


def latest_prompts(prompts: DataFrame) -> DataFrame:
    """The prompt of each name with the greatest version, by its numbers."""
    return prompts.groupBy("name").agg(F.max_by(F.struct(*[c for c in prompts.columns if c != "name"]), _version(F.col("version"))).alias("_p")).select("name", "_p.*")


def signed_key(key: Column, expires_at: Column, secret: str) -> Column:
    """Hexadecimal HMAC-SHA256 of key:expires_at, in the JVM."""
    raw = secret.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in raw))
    message = F.concat_ws(":", key, expires_at.cast("string")).cast("binary")
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def signature_holds(key: Column, expires_at: Column, signature: Column, now: Column, secret: str) -> Column:
    return (expires_at >= now) & signature.eqNullSafe(signed_key(key, expires_at, secret))


def layout_summary(pages: DataFrame) -> DataFrame:
    """run_id and a map from page number to is_multi_column and column_count; a run's pages are one row, as in its record."""
    entry = F.struct(F.col("page_number").cast("string").alias("k"), F.struct("is_multi_column", "column_count").alias("v"))
    return pages.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("layout"))


def metadata(documents: DataFrame, pages: DataFrame, language: Column) -> DataFrame:
    """doc_id, title, author, creation_date, language, page_count, word_count.

    documents: doc_id, title, author, created (a D: date). pages: doc_id, page_number, text. language: of a column called text."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    per = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum(word_count(F.col("text"))).alias("word_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), " ").alias("text"))
    per = per.select("doc_id", "page_count", "word_count", language.alias("language"))
    return documents.select("doc_id", blank("title").alias("title"), blank("author").alias("author"), pdf_date(F.col("created")).alias("creation_date")).join(per, "doc_id", "left")


#: Frequent short words of languages, for a first guess; fixed values.
FREQUENT = {"de": "der die das und ist nicht ein eine zu den mit von auf", "en": "the and of to in is that it was for with on as", "es": "el la de que y en los las un una por con del", "fr": "le la les de et des un une du que est pour dans"}


def language(text: Column) -> Column:
    """The language most of whose frequent words a text holds; null below 20 characters or without any; ties go to the first code."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(*known.split())))
    counts = [F.struct(hits(v).alias("n"), F.lit(-k).alias("k"), F.lit(c).alias("code")) for k, (c, v) in enumerate(sorted(FREQUENT.items()))]
    best = F.array_max(F.array(*counts))
    return F.when((F.length(F.trim(text)) >= 20) & (best["n"] > 0), best["code"])


def token_counts(text: Column, ranks: str, pattern: str) -> Column:
    """Tokens of a byte-pair vocabulary (a file of ranks) and its split pattern; null counts 0."""

    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(ranks) as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        for s in texts:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return run(text)


def sampled(df: DataFrame, share: float, seed: int) -> DataFrame:
    """A random share of the rows; the same for the same seed and files."""
    return df.sample(False, share, seed)


def synthetic_paragraphs(ids: DataFrame, words: list[str], most: int, seed: int) -> DataFrame:
    """id and a text of 1 to most words drawn by hashes of the id and seed: the same however rows are dealt."""
    draw = lambda k, n: F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(n)).cast("int")
    table = F.array(*map(F.lit, words))
    n = draw(F.lit(-1), most) + 1
    return ids.select("id", F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.element_at(table, draw(k, len(words)) + 1)), " ").alias("text"))

