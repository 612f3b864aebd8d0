"""Retrieval: nearest vectors, branches of a hybrid run, merging, reranking, citations, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, weighted
from ..functions.text import alias_key, snippet, strip
from ..functions.vectors import cosine_distance, dot, inner_product_distance, l2_distance, norm

METRICS = {"cosine": cosine_distance, "l2": l2_distance, "inner_product": inner_product_distance}
WEIGHTS = {"vector_similarity": 0.30, "bm25_score": 0.20, "graph_distance": 0.15, "entity_trust": 0.15, "relationship_confidence": 0.10, "recency": 0.05, "document_quality": 0.05}

def nearest(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", drop_self: bool = False) -> DataFrame:
    """query_id, vec_id, distance, rank of the k nearest items (vec_id, embedding, ...) of each query (query_id, q).

    queries is a stated set, sent to all tasks; each task keeps k a query before anything is shuffled."""
    if metric == "cosine":  # norms are made once a vector, not once a pair
        d = items.withColumn("_n", norm(F.col("embedding"))).crossJoin(F.broadcast(queries.withColumn("_m", norm(F.col("q")))))
        d = d.withColumn("distance", F.round(F.lit(1.0) - dot(F.col("embedding"), F.col("q")) / F.nullif(F.col("_n") * F.col("_m"), F.lit(0.0)), 9))
    else:
        d = items.crossJoin(F.broadcast(queries)).withColumn("distance", F.round(METRICS[metric](F.col("embedding"), F.col("q")), 9))
    if drop_self:
        d = d.where("vec_id <> query_id")
    order = [F.asc("distance"), F.asc("vec_id")]
    # a rank filter over a window is pushed below the exchange as a group limit
    ranked = d.select("query_id", "vec_id", "distance", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def label_metrics(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """hits, k, precision_at_k and recall_at_k with equal labels as judgements; precision divides by what was returned. Recall is NaN, as in the SQL, if a query's label is no other row's."""
    label = items.select("vec_id", "label")
    relevant = label.groupBy("label").agg((F.count("*") - 1).cast("double").alias("relevant"))
    q = label.join(relevant, "label").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"), "relevant")
    per = ranked.join(q, "query_id").join(label, "vec_id").groupBy("query_id").agg(F.count_if(F.col("label") == F.col("q_label")).cast("double").alias("hits"), F.count("*").cast("double").alias("k"), F.first("relevant").alias("relevant"))
    return per.agg(F.sum("hits").alias("hits"), F.sum("k").cast("long").alias("k"), F.round(F.avg(F.col("hits") / F.col("k")), 6).alias("precision_at_k"), F.round(F.avg(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(float("nan"))), 6).alias("recall_at_k"))


SOURCE_TYPES = ("document_chunk", "graph_node", "graph_edge", "canonical_entity", "ontology_definition")


def hybrid(query_id: str, text_hits: DataFrame, vector_hits: DataFrame, nodes: DataFrame, edges: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Candidates of the three branches, for merged() and reranked().

    text_hits: source_id, score. vector_hits: source_type, source_id, similarity, already limited, so the allow-list acts after
    that limit; text and graph are left out before. nodes: source_id, hops, recency. edges: source_id, confidence, recency."""
    signals = lambda **k: [k.get(s, F.lit(None)).cast("double").alias(s) for s in WEIGHTS]
    head = lambda kind, method, score, seq: [F.lit(query_id).alias("query_id"), kind.alias("source_type"), F.col("source_id").cast("string").alias("source_id"), F.lit(method).alias("method"), score.cast("double").alias("score"), F.lit(seq).alias("seq")]
    ok = lambda kind: allowed is None or kind in allowed
    score, sim, conf = F.col("score"), F.col("similarity"), F.col("confidence")
    out = vector_hits.select(*head(F.col("source_type"), "vector", sim, 2), *signals(vector_similarity=sim))
    if allowed is not None:
        out = out.where(F.col("source_type").isin(*allowed))
    if ok("document_chunk"):
        out = out.unionByName(text_hits.select(*head(F.lit("document_chunk"), "bm25", score, 1), *signals(bm25_score=score)))
    if ok("graph_node"):
        out = out.unionByName(nodes.select(*head(F.lit("graph_node"), "graph_expansion", 1 / (1 + F.col("hops")), 3), *signals(graph_distance=F.col("hops"), recency=F.col("recency"))))
    if ok("graph_edge"):
        out = out.unionByName(edges.select(*head(F.lit("graph_edge"), "graph_expansion", conf, 3), *signals(relationship_confidence=conf, recency=F.col("recency"))))
    return out


def cited(results: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, ontology: DataFrame) -> DataFrame:
    """results (source_type, source_id, final_rank, ...) with what each cites; a chunk, node or edge that is not there fails.

    chunks: chunk_id, document_id, document_title, page_number, text. nodes: node_id, canonical_id. edges: edge_id, source_node, target_node,
    relationship, confidence. evidence: evidence_id, edge_id, document_id, page_number, chunk_id, entity_id, in the order of ids.
    ontology: entity_type, description; a definition that is not there is left out of the context only."""
    is_ = lambda kind: F.col("source_type") == kind
    c = chunks.select(F.lit("document_chunk").alias("source_type"), F.col("chunk_id").alias("source_id"), F.struct("document_id", "document_title", "page_number", snippet(F.col("text")).alias("text_snippet")).alias("c"))
    n = nodes.select(F.lit("graph_node").alias("source_type"), F.col("node_id").alias("source_id"), F.col("canonical_id").alias("n"))
    name = lambda k: nodes.select(F.col("node_id").alias(f"{k}_node"), F.col("canonical_id").alias(f"_{k}"))
    wanted = results.where(is_("graph_edge")).select(F.col("source_id").alias("edge_id")).distinct()
    per = evidence.join(wanted, "edge_id").groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("evidence_id", "document_id", "page_number", "chunk_id", "entity_id"))).alias("v"))
    e = edges.join(wanted, "edge_id").join(name("source"), "source_node", "left").join(name("target"), "target_node", "left").join(per, "edge_id", "left")
    path = F.array(F.coalesce("_source", "source_node"), F.col("relationship"), F.coalesce("_target", "target_node"))
    e = e.select(F.lit("graph_edge").alias("source_type"), F.col("edge_id").alias("source_id"), F.struct(path.alias("path"), "confidence", F.get("v", F.lit(0)).alias("first"), F.coalesce(F.transform("v", lambda x: x["evidence_id"]), F.array().cast("array<string>")).alias("ids")).alias("e"))
    o = ontology.select(F.lit("ontology_definition").alias("source_type"), F.col("entity_type").alias("source_id"), F.col("description").alias("o"))
    key = ["source_type", "source_id"]
    all_ = results.join(c, key, "left").join(n, key, "left").join(e, key, "left").join(o, key, "left")
    found = F.when(is_("document_chunk"), F.col("c").isNotNull()).when(is_("graph_node"), F.col("n").isNotNull()).when(is_("graph_edge"), F.col("e").isNotNull()).otherwise(True)
    checked = F.when(found, F.col("source_id")).otherwise(F.raise_error(F.concat("source_type", F.lit(" "), "source_id", F.lit(" not found"))))
    return all_.select(
        *[x for x in results.columns if x != "source_id"],
        checked.alias("source_id"),
        F.coalesce("c.document_id", "e.first.document_id").alias("document_id"),
        F.col("c.document_title").alias("document_title"),
        F.coalesce("c.page_number", "e.first.page_number").alias("page_number"),
        F.when(is_("document_chunk"), F.col("source_id")).otherwise(F.col("e.first.chunk_id")).alias("chunk_id"),
        F.col("e.first.entity_id").alias("entity_id"),
        F.when(is_("canonical_entity"), F.col("source_id")).otherwise(F.col("n")).alias("canonical_id"),
        F.col("c.text_snippet").alias("text_snippet"),
        F.col("e.path").alias("graph_path"),
        F.col("e.ids").alias("evidence_ids"),
        F.col("e.confidence").alias("confidence"),
        (~is_("ontology_definition") | F.col("o").isNotNull()).alias("in_context"),
    )


#: The order of a context's buckets; a fixed value.
BUCKETS = ("document_chunk", "graph_node", "graph_edge", "canonical_entity", "ontology_definition")


def context(cites: DataFrame) -> DataFrame:
    """query_id, source_type, source_id, place and total_items of a query's context: buckets in their order, ranks within."""
    order = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("source_type"))
    w = Window.partitionBy("query_id")
    kept = cites.where("in_context")
    return kept.select("query_id", "source_type", "source_id", F.row_number().over(w.orderBy(order, "final_rank")).alias("place"), F.count(F.lit(1)).over(w).alias("total_items"))


def merged(candidates: DataFrame) -> DataFrame:
    """One row for each (query_id, source_type, source_id): the best score, hybrid where methods differ, signals overlaid."""
    signals = list(WEIGHTS)
    kinds = F.count_distinct("method")
    return candidates.groupBy("query_id", "source_type", "source_id").agg(F.max("score").alias("score"), F.when(kinds > 1, "hybrid").otherwise(F.min("method")).alias("method"), *(F.max_by(s, F.when(F.col(s).isNotNull(), F.col("seq"))).alias(s) for s in signals))


def normal_signal(name: str) -> Column:
    c = F.col(name)
    if name == "graph_distance":
        return F.when(c.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0), c)))
    if name == "bm25_score":
        return F.when(c.isNotNull(), F.when(c > 0, c / (F.lit(1.0) + c)).otherwise(0.0))
    return F.when(c.isNotNull(), clamp(c))


def reranked(candidates: DataFrame, top_k: int | None = None) -> DataFrame:
    """rerank_score, the weighted mean of the signals that are present, and final_rank within each query."""
    out = candidates.withColumn("rerank_score", F.round(weighted([(normal_signal(s), w) for s, w in WEIGHTS.items()]), 9))
    out = out.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "source_type", "source_id")))
    return out.where(F.col("final_rank") <= top_k) if top_k else out


def changed(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Items (source_type, source_id, hash) that are new or have another hash than the one embedded."""
    old = existing.select("source_type", "source_id", F.col("hash").alias("old"))
    return items.join(old, ["source_type", "source_id"], "left").where(F.col("old").isNull() | (F.col("old") != F.col("hash"))).drop("old")


#: Words that tell the intent of a query, in order, and first words of questions. Fixed values.
INTENTS = (("comparison", ("compare", "versus", " vs ", " vs.")), ("relationship", ("owns", "owned by", "operates", "relationship", "related to", "connected to")), ("listing", ("list ", "list all", "which ", "all of", "every ")), ("definition", ("what is ", "define ", "definition of", "meaning of")))
YES_NO = ("is", "are", "does", "do", "can", "did", "was", "were")


def intent(q: Column) -> Column:
    low = F.lower(F.coalesce(q, F.lit("")))
    out = None
    for name, words in INTENTS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.when(F.rlike(low, F.lit(r"\S")), F.lit("factual")).otherwise("unknown")


def question_type(q: Column) -> Column:
    low = strip(F.lower(F.coalesce(q, F.lit(""))))
    first = F.regexp_replace(F.element_at(F.split(low, " "), 1), r"\?+$", "")
    return F.when(first.isin("who", "what", "where", "when"), first).when(F.rlike(low, F.lit("^how (many|much)")), F.lit("how_many")).when(first.isin(*YES_NO), F.lit("yes_no")).otherwise("other")


def time_range(q: Column, now: Column) -> Column:
    """struct<start, end> from a quarter, ISO dates, a phrase relative to now, or a year; null if there is none."""
    low = F.lower(q)
    none = F.lit(None).cast("timestamp")
    day = lambda y, m="1": F.try_to_timestamp(F.format_string("%04d-%02d-01", y.cast("int"), m if isinstance(m, Column) else F.lit(int(m))))
    year = lambda pattern, k: F.regexp_extract(q, pattern, k).try_cast("int")
    pair = lambda a, b: F.struct(a.cast("timestamp").alias("start"), b.cast("timestamp").alias("end"))
    quarter = r"(?i)\bQ([1-4])[\s-]?(\d{4})\b"
    q_start = day(year(quarter, 2), year(quarter, 1) * 3 - 2)
    iso = F.regexp_extract_all(q, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))
    this_quarter, this_year, this_month = (F.date_trunc(u, now) for u in ("quarter", "year", "month"))
    any_year = r"\b((?:19|20)\d{2})\b"
    back = lambda c, n: F.add_months(c, n)
    return (
        F.when(F.rlike(q, F.lit(quarter)), pair(q_start, back(q_start, 3)))
        .when(F.size(iso) > 0, pair(F.try_to_timestamp(F.try_element_at(iso, F.lit(1))), F.try_to_timestamp(F.try_element_at(iso, F.lit(-1)))))
        .when(F.contains(low, F.lit("last quarter")), pair(back(this_quarter, -3), this_quarter))
        .when(F.contains(low, F.lit("last year")), pair(back(this_year, -12), this_year))
        .when(F.contains(low, F.lit("this year")), pair(this_year, none))
        .when(F.contains(low, F.lit("last month")), pair(back(this_month, -1), this_month))
        .when(F.rlike(q, F.lit(any_year)), pair(day(year(any_year, 1)), day(year(any_year, 1) + 1)))
    )


def query_entities(queries: DataFrame, aliases: DataFrame, most: int = 4) -> DataFrame:
    """query_id, entity_type, canonical_id, matched_text: longest spans first, then leftmost; a token serves one entity.

    aliases (alias, rank, entity_type, canonical_id) has keys as alias_key() makes them; of several types the lowest rank wins."""
    tokens = F.regexp_extract_all("query", F.lit(r"[A-Za-z0-9][A-Za-z0-9.\-]*"), F.lit(0))
    t = queries.select("query_id", tokens.alias("t")).where(F.size("t") > 0)
    spans = t.select("query_id", F.posexplode("t").alias("i", "_w"), "t").select("query_id", "i", "t", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("t") - F.col("i")))).alias("n"))
    spans = spans.select("query_id", "i", "n", F.array_join(F.slice("t", F.col("i") + 1, F.col("n")), " ").alias("matched_text"))
    hits = spans.withColumn("alias", alias_key(F.col("matched_text"))).join(aliases, "alias")
    best = hits.groupBy("query_id", "i", "n", "matched_text").agg(F.min_by(F.struct("entity_type", "canonical_id"), "rank").alias("e"))
    ordered = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "i", "n", "matched_text", "e"))).alias("s"))  # at most some spans a query
    empty = F.filter("s", lambda x: F.lit(False))
    free = lambda acc, x: ~F.exists(acc, lambda y: (x["i"] < y["i"] + y["n"]) & (y["i"] < x["i"] + x["n"]))
    kept = F.aggregate("s", empty, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return ordered.select("query_id", F.explode(kept).alias("x")).select("query_id", "x.e.entity_type", "x.e.canonical_id", "x.matched_text")
