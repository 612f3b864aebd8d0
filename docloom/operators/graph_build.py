"""Building the graph: which entities become nodes, what a node shows, hops of a path, texts to embed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import MIN_CONFIDENCE, cut, survivors
from .trust import given

#: Entity types that become nodes; fixed values.
NODE_TYPES = ("company", "country", "port", "commodity", "terminal", "contract", "vessel", "organization")


def _skipped() -> Column:
    return F.when(~F.col("entity_type").isin(*NODE_TYPES), "type").when(F.col("canonical_id").isNull(), "identity").when(F.col("overall").isNull(), "confidence")


def eligibility(entities: DataFrame, normalised: DataFrame, scores: DataFrame) -> DataFrame:
    """entities with canonical_id, overall and skipped: null, or why the entity becomes no node (type, identity, confidence), first reason only."""
    e = entities.join(normalised.select("entity_id", "canonical_id"), "entity_id", "left").join(scores.select("entity_id", "overall"), "entity_id", "left")
    return e.withColumn("skipped", _skipped())


def eligibility_of(scores: DataFrame) -> DataFrame:
    """The same for entities of trust.scored(), from their own rows."""
    return scores.withColumn("canonical_id", F.col("normal.canonical_id")).withColumn("skipped", _skipped())


def node_plans(eligible: DataFrame, nodes: DataFrame) -> DataFrame:
    """canonical_id, display_name, node_type, aliases, state of the nodes that eligible entities make or change.

    The first entity (seq) names a new node; aliases are all its values, sorted, with those of an existing node (nodes: canonical_id, display_name, node_type, aliases);
    state is new, updated (aliases were added) or same."""
    value = given()
    plan = eligible.where("skipped is null").groupBy("canonical_id").agg(F.min_by(value, "seq").alias("_name"), F.min_by("entity_type", "seq").alias("_type"), F.collect_set(value).alias("_new"))
    old = nodes.select("canonical_id", "display_name", "node_type", F.col("aliases").alias("_old"))
    j = plan.join(old, "canonical_id", "left")
    both = F.array_sort(F.array_union(F.coalesce("_old", F.array().cast("array<string>")), "_new"))
    state = F.when(F.col("_old").isNull(), "new").when(F.size(both) > F.size(F.array_distinct("_old")), "updated").otherwise("same")
    return j.select("canonical_id", F.coalesce("display_name", "_name").alias("display_name"), F.coalesce("node_type", "_type").alias("node_type"), both.alias("aliases"), state.alias("state"))


def neighbour_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, n of the neighbours of each node, edges (a, b) taken either way and repeats counted."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x")).select("x.*")
    return ends.join(nodes.select(F.col("id").alias("other"), "type"), "other").groupBy("id", "type").agg(F.count("*").alias("n"))


def best_hops(path: DataFrame, edges: DataFrame) -> DataFrame:
    """hop, a, b, relationship, confidence: for each step of path (hop, node), the most confident edge between its nodes either way; ties take the first relationship."""
    steps = path.select("hop", F.col("node").alias("a"), F.lead("node").over(Window.orderBy("hop")).alias("b")).where("b is not null")
    key = (F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi"))
    best = edges.select(*key, "relationship", "confidence").groupBy("_lo", "_hi").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "relationship")).alias("_m"))
    best = best.select("_lo", "_hi", "_m.relationship", (-F.col("_m.c")).alias("confidence"))
    return steps.select("hop", "a", "b", *key).join(best, ["_lo", "_hi"], "left").drop("_lo", "_hi")


def first_mentions(mentions: DataFrame) -> DataFrame:
    """The first mention of each entity, by created_at, then mention_id."""
    return mentions.groupBy("entity_id").agg(F.min_by(F.struct(*[c for c in mentions.columns if c != "entity_id"]), F.struct("created_at", "mention_id")).alias("_m")).select("entity_id", "_m.*")


def provenance(findings: DataFrame, key: list[str]) -> DataFrame:
    """key and the provenance struct of its last finding (seq)."""
    return findings.groupBy(*key).agg(F.max_by("provenance", "seq").alias("provenance"))


def embeddable(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, entries: DataFrame, ontology: DataFrame) -> DataFrame:
    """source_type, source_id, text: chunks that aren't blank, active nodes, edges both ends of which are active, registry entries, ontology terms."""
    part = lambda df, kind, key, text: df.select(F.lit(kind).alias("source_type"), F.col(key).cast("string").alias("source_id"), text.alias("text"))
    live = nodes.where("deleted_at is null")
    end = lambda c: live.select(F.col("node_id").alias(c), F.col("display_name").alias(f"_{c}"))
    e = edges.join(end("a"), "a").join(end("b"), "b")
    named = lambda *c: F.concat_ws(" ", *c)
    parts = [
        part(chunks.where(F.length(F.trim("text")) > 0), "chunk", "chunk_id", F.col("text")),
        part(live, "node", "node_id", named("display_name", "node_type", "aliases")),
        part(e, "edge", "edge_id", named("_a", "relationship", "_b")),
        part(entries, "canonical_entity", "canonical_id", named("canonical_name", "aliases")),
        part(ontology, "ontology", "term", F.concat("term", F.lit(": "), "description")),
    ]
    return reduce(DataFrame.unionByName, parts)


def query_filters(found: Column, time_range: Column) -> Column:
    """Map of "<type>_ids" to sorted ids of found (array of structs type, id), and of "time_range" to its two ISO days; absent ones are left out."""
    kinds = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["type"])))
    ids = F.transform(kinds, lambda k: F.struct(F.concat(k, F.lit("_ids")).alias("key"), F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["type"] == k), lambda x: x["id"]))).alias("value")))
    span = F.when(time_range.isNotNull(), F.array(F.struct(F.lit("time_range").alias("key"), F.array(time_range["start"].cast("string"), time_range["end"].cast("string")).alias("value"))))
    return F.map_from_entries(F.concat(ids, F.coalesce(span, F.filter(ids, lambda x: F.lit(False)))))


def built(runs: DataFrame, mentions: DataFrame, merges: DataFrame, pair: tuple[str, str], relationship: str, base: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and one row of statistics of the runs (run_id, seq), in order, up to the first that fails; what came before it stays.

    mentions: run_id, chunk_id, seq, canonical_id, node_type, value, overall. A run fails if an overall of its lies outside 0 to 1.
    Mentions without identity or overall are skipped and counted. Identities follow merges (node, into) to their survivors. Source and
    target types of pair that share a chunk are related, base times their mean overall, MIN_CONFIDENCE at least. An upsert keeps the greatest
    confidence, all aliases, all evidence, and the first name, whatever the order of rows; so the state after many runs is built at once,
    and what each run has made or changed is told by the first run of each node, alias and edge."""
    off = F.col("overall").isNotNull() & ~((F.col("overall") >= 0) & (F.col("overall") <= 1))
    failing = mentions.where(off).select("run_id").distinct().join(runs, "run_id").agg(F.min(F.struct("seq", "run_id")).alias("f"))
    first = failing.first().f  # one row
    done = runs if first is None else runs.where(F.struct("seq", "run_id") < F.struct(*[F.lit(first[c]).cast(runs.schema[c].dataType).alias(c) for c in ("seq", "run_id")]))
    m = mentions.join(done.select("run_id", F.struct("seq", "run_id").alias("run")), "run_id")
    lives = survivors(merges).withColumnsRenamed({"node": "canonical_id"})
    usable = F.col("canonical_id").isNotNull() & F.col("overall").isNotNull()
    good = cut(m.where(usable).join(lives, "canonical_id", "left").withColumn("node", F.coalesce("survivor", "canonical_id")).drop("survivor"))

    aliases = good.groupBy("node", "value").agg(F.min("run").alias("run"), F.min(F.struct("run", "seq", "value")).alias("said"), F.min(F.struct("run", "seq", "node_type")).alias("typed"))
    nodes = aliases.groupBy("node").agg(F.min("said")["value"].alias("display_name"), F.min("typed")["node_type"].alias("node_type"), F.array_sort(F.collect_set("value")).alias("aliases"), F.min("run").alias("made"), (F.count_distinct("run") - 1).alias("updates"))

    ends = good.groupBy("run", "chunk_id", "node").agg(F.min("node_type").alias("node_type"), F.max("overall").alias("overall"))
    side = lambda k, name: ends.where(F.col("node_type") == pair[k]).select("run", "chunk_id", F.col("node").alias(name), F.col("overall").alias(f"_{name}"))
    found = side(0, "source").join(side(1, "target"), ["run", "chunk_id"]).where("source <> target")
    found = found.withColumn("confidence", F.round(F.lit(base) * (F.col("_source") + F.col("_target")) / 2, 9)).where(F.col("confidence") >= MIN_CONFIDENCE)
    proofs = cut(found.groupBy("source", "target", "run", "chunk_id").agg(F.max("confidence").alias("confidence")))
    by_run = proofs.groupBy("source", "target", "run").agg(F.max("confidence").alias("confidence"))
    chunks = proofs.groupBy("source", "target").agg(F.count_distinct("chunk_id").alias("evidence_count"))
    edges = by_run.groupBy("source", "target").agg(F.max("confidence").alias("confidence"), F.min("run").alias("made"), (F.count(F.lit(1)) - 1).alias("updates")).join(chunks, ["source", "target"])
    edges = edges.select("source", "target", F.lit(relationship).alias("relationship"), "confidence", "evidence_count", "made", "updates")

    sums = lambda df, name: df.agg(F.count(F.lit(1)).alias(f"{name}_created"), F.coalesce(F.sum("updates"), F.lit(0)).cast("long").alias(f"{name}_updated"))
    counts = done.agg(F.count(F.lit(1)).alias("runs_processed"))
    left = m.agg(F.count_if(~usable).alias("skipped"))
    stats = counts.join(left).join(sums(nodes, "nodes")).join(sums(edges, "edges"))  # a row each
    return nodes, edges, stats.withColumn("failed_run", F.lit(None if first is None else first.run_id).cast(runs.schema["run_id"].dataType))
