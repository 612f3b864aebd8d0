"""Pages: native or recognised text, bands, blocks, tables, and where a value stands on a page.

Spans, blocks and cells come as tables; what one page holds is gathered into one row, as a page bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_key, strip

#: Text shorter than this is taken from recognition; share of a page's height that is header or footer; words of a window. Fixed values.
MIN_NATIVE, BAND, MAX_WINDOW = 20, 0.08, 12
#: Pages, blocks of a page and characters of a block that a summary shows; fixed values.
SHOWN_PAGES, SHOWN_BLOCKS, SHOWN_CHARS = 5, 40, 80


def page_text(native: Column, recognised: Column) -> Column:
    """The native text, or the recognised one where that is too short; no text is empty."""
    native = F.coalesce(native, F.lit(""))
    return F.when(F.length(strip(native)) < MIN_NATIVE, F.coalesce(recognised, F.lit(""))).otherwise(native)


def recognised(words: DataFrame) -> DataFrame:
    """page, text and confidence (0 to 1) of words (page, pos, word, conf in percent): blank words dropped, confidences below 0 not counted; 0 if none is left."""
    w = words.where(F.length(strip(F.coalesce("word", F.lit("")))) > 0)
    rows = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return w.groupBy("page").agg(F.array_join(F.transform(rows, lambda x: x["word"]), " ").alias("text"), F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100, F.lit(0.0)).alias("confidence"))


def recall(truth: Column, found: Column) -> tuple[Column, Column]:
    """Shares of the words and of the numbers of truth, repeats counted, that found holds; 0 if truth has none."""

    def share(pattern: str) -> Column:
        tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
        # One struct in an array, so that each step is made once a row and not once an element.
        step = lambda xs, f: F.transform(xs, f)
        x = F.array(F.struct(F.array_distinct(tokens(found)).alias("have"), tokens(truth).alias("want")))
        x = step(x, lambda b: F.struct(b["want"].alias("want"), F.array_except(b["want"], b["have"]).alias("miss"), F.array_intersect(b["want"], b["have"]).alias("hit"), F.ceil(F.sqrt(F.greatest(F.lit(1), F.size(b["want"])))).cast("int").alias("n")))
        few = lambda b: F.when(F.size(b["miss"]) <= F.size(b["hit"]), b["miss"]).otherwise(b["hit"])
        # the fewer of what is missed and what is met, dealt by hash to as many lists as the root of the words: a word is looked for in one of them
        x = step(x, lambda b: F.struct(b["want"].alias("want"), b["n"].alias("n"), (F.size(b["miss"]) <= F.size(b["hit"])).alias("of_miss"), few(b).alias("few")))
        lists = lambda b: F.transform(F.sequence(F.lit(0), b["n"] - 1), lambda k: F.filter(b["few"], lambda w: F.pmod(F.hash(w), b["n"]) == k))
        x = step(x, lambda b: F.struct(b["want"].alias("want"), b["n"].alias("n"), b["of_miss"].alias("of_miss"), lists(b).alias("lists")))
        inside = lambda b: F.size(F.filter(b["want"], lambda w: F.array_contains(F.get(b["lists"], F.pmod(F.hash(w), b["n"])), w)))
        part = step(step(x, lambda b: F.struct(F.size(b["want"]).alias("of"), inside(b).alias("in"), b["of_miss"].alias("of_miss"))), lambda c: F.when(c["of_miss"], c["of"] - c["in"]).otherwise(c["in"]) / F.greatest(F.lit(1), c["of"]))
        return F.get(part, F.lit(0))

    return share(r"[a-z0-9]+(?:\.[0-9]+)?"), share(r"[0-9]+(?:\.[0-9]+)?")


def bands(blocks: DataFrame) -> DataFrame:
    """page, header, footer of blocks (page, pos, text, y0, y1, height): texts that end in the top band, or begin in the bottom one; null if none."""
    text = strip(F.coalesce("text", F.lit("")))
    b = blocks.where(text != "").withColumn("text", text)
    top = F.col("y1") <= F.col("height") * BAND
    joined = lambda hit: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("pos", "text")))), lambda x: x["text"]), " "), F.lit(""))
    return b.groupBy("page").agg(joined(top).alias("header"), joined(~top & (F.col("y0") >= F.col("height") * (1 - BAND))).alias("footer"))


def block_summary(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, page, lines: the first blocks of the first pages that have any, one line each (pos, box, start of the text)."""
    pages = Window.partitionBy(doc).orderBy("page")
    few = blocks.select(doc, "page").distinct().withColumn("_n", F.row_number().over(pages)).where(F.col("_n") <= SHOWN_PAGES).drop("_n")
    rank = F.row_number().over(Window.partitionBy(doc, "page").orderBy("pos"))
    box = F.concat_ws(",", *(F.format_string("%.0f", F.rint(c)) for c in ("x0", "y0", "x1", "y1")))
    line = F.concat(F.lit("block "), F.col("pos").cast("string"), F.lit(" ("), box, F.lit(") "), F.translate(F.substring("text", 1, SHOWN_CHARS), "\n", " "))
    shown = blocks.join(few, [doc, "page"]).withColumn("_r", rank).where(F.col("_r") <= SHOWN_BLOCKS)
    return shown.groupBy(doc, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def filled_rows(grid: Column) -> Column:
    """Rows of a grid (array of arrays of text) with any text in a cell; null if none has."""
    rows = F.filter(grid, lambda r: F.exists(r, lambda c: F.length(F.coalesce(c, F.lit(""))) > 0))
    return F.when(F.size(rows) > 0, rows)


def grid_text(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def grounded_cells(tables: DataFrame, boxes: DataFrame, read: DataFrame) -> DataFrame:
    """page, ordinal, row, column, raw_value, box, value, confidence of the cells of tables (page, ordinal, grid).

    boxes (page, ordinal, row, column, box) give places, read (page, ordinal, row, column, value, confidence) a reading; cells without either keep nulls and confidence 0."""
    key = ["page", "ordinal", "row", "column"]
    rows = tables.select("page", "ordinal", F.posexplode("grid").alias("row", "_cells"))
    cells = rows.select("page", "ordinal", "row", F.posexplode("_cells").alias("column", "raw_value"))
    return cells.join(boxes, key, "left").join(read, key, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def grounded(values: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """values (key, page, raw_value) with x0, y0, x1, y1 of the words that hold the value: the shortest window of spans (page, pos, word, x0, y0, x1, y1), then the first; null if none of MAX_WINDOW words does."""
    words = spans.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", F.split(alias_key(F.coalesce("word", F.lit(""))), " ").alias("ts"), "x0", "y0", "x1", "y1"))).alias("_w"))
    v = standing(values, words.withColumn("words", F.transform("_w", lambda x: F.array_join(x["ts"], " "))))
    v = v.withColumn("_h", F.slice("_w", F.col("at.i") + 1, F.col("at.size")))
    side = lambda f, c: f(F.transform("_h", lambda x: x[c]))
    return v.select(key, "page", "raw_value", side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1"))


def standing(values: DataFrame, words: DataFrame) -> DataFrame:
    """values (page, raw_value, ...) with at, the size and the first word (i, from 0) of the shortest, then first, window of a page's words that holds the value; null if none of MAX_WINDOW words does.

    words (page, words, ...) has a row a page; its other columns follow. Where each word of a page is one token, as on most pages, every window of a
    value has its number of tokens, so the first place in the text is asked for, by compiled code; other pages are walked token by token."""
    text = F.lower(F.array_join("words", " ", ""))
    plain = ~F.contains("_s", F.lit("  ")) & ~F.startswith("_s", F.lit(" ")) & ~F.endswith("_s", F.lit(" ")) & (_spaces(F.col("_s")) == F.col("_n") - 1) & (~F.rlike("_s", F.lit("[^!-~ ]")) | ~F.rlike("_s", F.lit(r"(?U)[\s&&[^ ]]")))
    w = words.select(*[c for c in words.columns if c != "words"], "words", text.alias("_s"), F.size("words").alias("_n")).withColumn("_plain", plain)
    w = w.withColumn("_s", F.when(F.col("_plain"), F.col("_s"))).withColumn("words", F.when(~F.col("_plain"), F.col("words"))).drop("_n", "_plain")
    v = values.join(w, "page", "left").withColumn("_t", alias_key(F.coalesce("raw_value", F.lit(""))))
    v = v.withColumn("_p", F.when(F.col("_t") != "", F.instr("_s", F.col("_t"))))
    first = F.struct((_spaces(F.col("_t")) + 1).alias("size"), _spaces(F.substring("_s", F.lit(1), F.col("_p") - 1)).alias("i"))
    v = v.withColumn("at", F.when(F.col("_p") > 0, first).when((F.col("_t") != "") & F.col("words").isNotNull(), _walked(F.col("words"), F.col("_t"))))
    return v.withColumn("at", F.when(F.col("at.size") <= MAX_WINDOW, F.col("at"))).drop("words", "_s", "_t", "_p")


def _spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def _walked(words: Column, value: Column) -> Column:
    """The smallest (size, i) of the windows of words that hold value, of any words."""
    # a value of k tokens stands in k tokens that follow each other, or nowhere; a token's window is that of the words it came from
    tokens = F.flatten(F.transform(words, lambda x, i: F.transform(F.split(alias_key(F.coalesce(x, F.lit(""))), " "), lambda t: F.struct(t.alias("t"), i.alias("i")))))
    # one struct in an array, so that tokens are made once a row and not once an element
    one = F.array(F.struct(F.filter(tokens, lambda x: x["t"] != "").alias("w"), value.alias("t"), F.split(value, " ").alias("q")))
    text = lambda w: F.array_join(F.transform(w, lambda x: x["t"]), " ")

    def hits(b: Column) -> Column:
        k = F.size(b["q"])
        last = F.size(b["w"]) - k + 1
        at = F.when((last >= 1) & F.contains(text(b["w"]), b["t"]), F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        begins = lambda s: F.when(k == 1, F.contains(F.element_at(b["w"], s)["t"], b["t"])).otherwise(F.endswith(F.element_at(b["w"], s)["t"], F.element_at(b["q"], 1)))
        found = F.filter(at, lambda s: begins(s) & F.contains(text(F.slice(b["w"], s, k)), b["t"]))
        first = lambda s: F.element_at(b["w"], s)["i"]
        return F.array_min(F.transform(found, lambda s: F.struct((F.element_at(b["w"], s + k - 1)["i"] - first(s) + 1).alias("size"), first(s).alias("i"))))

    return F.get(F.transform(one, hits), F.lit(0))


def with_page_tables(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """chunks (doc_id, page, chunk_index, ...) with the tables of their start page, at each page's first chunk only."""
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("chunk_index")) == 1
    t = tables.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ordinal", "grid"))).alias("tables"))
    return chunks.withColumn("_first", first).join(t, ["doc_id", "page"], "left").withColumn("tables", F.when(F.col("_first"), F.col("tables"))).drop("_first")
