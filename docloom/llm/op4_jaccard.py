"""N-gram Jaccard join by count-vector R-trees.

A document's set holds its distinct shingles of SHINGLE words (64-bit hashes). Equal sets are put together first. A set's
shingles are hashed into groups; the group counts are its point. For two sets the sum of coordinate minima bounds their
overlap from above, and so does the sum of minima with a node's upper corner for all sets below it.

Where a pair may meet is settled by the same groups, without loss. Sets of similar size use the same number of groups.
If J >= 0.8, then |A xor B| <= (|A| + |B|) / 9 = t, so at most t groups differ: of their non-empty groups, each taken with
its content as a token, under any order of tokens the first t + 1 of either set contain a common one. Tokens are ordered by
number of shingles, largest first, those made of heavy shingles only last (a shingle is heavy if it is in more than HEAVY
of all documents; their list is bounded by the mean set size over HEAVY). Small sets use single shingles as tokens. Sets
that share a token make a cell; cells with the same members are one.

Round 1: in each cell an R-tree over the points gives each set its best partner that the bound allows; those pairs are
verified on whole sets. Linked sets get a label. Round 2: in the cells that still hold several labels, R-trees give all
pairs across labels that the bound allows and that were not tested; they are verified too. No link between different
components is missed, and a large group of near copies costs a few pairs a set instead of all. Cells over BLOCK sets are
cut into blocks (round 2: pairs of blocks). The set of the smaller id goes to the tasks of its partners, in portions.

The number of groups always exceeds t + 1 by many standard deviations of the hash; only a set that fails to fill them
could lose a token (chance below 1e-12 a set).

Defined results: null text, empty text or no words: empty set, its own component. With fewer than SHINGLE words the
sequence is the one shingle. Repeated rows have equal sets, so one component; rows with equal doc_id are one vertex. Other
columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, map_batches, mixed, span_hashes, stash, strings, table, width, word_spans
from .components import components

SHINGLE = 5
NUM, DEN = 4, 5  # the least Jaccard similarity
SMALL = 64
DIMS = 256
HEAVY = 1e-3
FLUSH = 2_000_000
#: Members of a cell that are compared with one another in one go, and partners that a set travels to at once.
BLOCK, PORTION = 400, 64
LEAF = 16


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    data, starts, ends = word_spans(text or "")
    if not len(starts):
        return np.zeros(0, np.uint64)
    k = min(SHINGLE, len(starts))
    return np.unique(span_hashes(data, starts[: len(starts) - k + 1], ends[k - 1 :]))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and DEN * both >= NUM * (len(a) + len(b) - both)


def point(s: np.ndarray) -> bytes:
    """Counts of DIMS groups, in one byte each if they fit, else in four."""
    n = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=DIMS)
    return n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes()


def counts_of(point: bytes) -> np.ndarray:
    return np.frombuffer(point, np.uint8 if len(point) == DIMS else np.uint32).astype(np.int32)


def _grouped(s: np.ndarray, heavy: np.ndarray, groups: int, t: int) -> np.ndarray:
    inner = mixed(s ^ np.uint64(0xA0761D6478BD642F))
    g = (inner % np.uint64(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    g, inner, heavy = g[order], inner[order], heavy[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    token = mixed(np.add.reduceat(mixed(inner), first) + np.uint64(groups * 0x9E3779B97F4A7C15 % (1 << 64)) + g[first].astype(np.uint64))
    n, light = np.diff(np.append(first, len(g))), ~np.logical_and.reduceat(heavy, first)
    return token[np.lexsort((token, -n, ~light))[: t + 1]]


def tokens_of(s: np.ndarray, heavy_list: np.ndarray) -> np.ndarray:
    """The tokens under which a set meets every set that it may be linked with."""
    n = len(s)
    if not n:
        return s
    heavy = np.zeros(n, bool)
    if len(heavy_list):
        at = np.minimum(np.searchsorted(heavy_list, s), len(heavy_list) - 1)
        heavy = heavy_list[at] == s
    t = (n + n * DEN // NUM) // 9
    least, band = -(-NUM * n // DEN), n.bit_length() - 1
    out = []
    if least < SMALL:
        single = mixed(s + np.uint64(0x1D8E4E27C47D124F))
        out.append(single[np.lexsort((single, heavy))[: n - least + 1]])
    if n >= SMALL:
        for b in {band, max(SMALL.bit_length() - 1, least.bit_length() - 1)}:
            out.append(_grouped(s, heavy, round(0.4 * (2 << b)), t))
    return np.concatenate(out)


def _describe(docs: DataFrame) -> DataFrame:
    """heavy, doc_id, n, fp1, fp2 (of the set), pt; rows with heavy hold a shingle in fp1 that many of a task's documents have, how many in n."""
    names = ["heavy", "doc_id", "n", "fp1", "fp2", "pt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            big = c >= max(2, HEAVY / 2 * n)
            held.clear()
            k = int(big.sum())
            return pa.RecordBatch.from_arrays([pa.array([True] * k, pa.bool_()), pa.nulls(k, pa.int64()), pa.array(c[big]), pa.array(h[big].view(np.int64)), pa.array([0] * k, pa.int64()), pa.nulls(k, pa.binary())], names)

        for b in batches:
            sets = [shingles(t) for t in strings(b["text"])]
            with np.errstate(over="ignore"):
                fp = [[int(mixed(s ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for s in sets] for k in (0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7)]
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(sets), pa.bool_()), b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(fp[0], pa.int64()), pa.array(fp[1], pa.int64()), pa.array([point(s) for s in sets], pa.binary())], names)
            held += sets
            size, n = size + sum(map(len, sets)), n + len(sets)
            if size >= 2 * FLUSH:
                yield flush()
                size = n = 0
        if held:
            yield flush()

    return map_batches(docs.select("doc_id", "text"), run, "heavy boolean, doc_id long, n long, fp1 long, fp2 long, pt binary")


def _heavy(about: DataFrame) -> np.ndarray:
    """Shingles in more than HEAVY of the documents, as far as tasks saw them; they only serve the order of tokens."""
    least = max(16.0, HEAVY * about.where("not heavy").count())
    got = about.where("heavy").groupBy("fp1").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("fp1").toArrow()
    return np.sort(got["fp1"].to_numpy().view(np.uint64))


def _deal(shards: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            t, doc = np.concatenate(held), np.repeat(np.array(ids, np.int64), [len(x) for x in held])
            shard = ((t >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            parts = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
            rows = [(k, t[o].tobytes(), doc[o].tobytes()) for k, o in parts]
            held.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "tokens", "docs"])

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), strings(b["text"]), strict=True):
                held.append(tokens_of(shingles(text), heavy.value))
                ids.append(doc)
                size += len(held[-1])
            if size >= FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed tokens of a shard to rows (cell, doc) of tokens that several documents have; equal memberships once."""
    tokens, docs = [], []
    for b in batches:
        tokens += [np.frombuffer(x, np.uint64) for x in b["tokens"].to_pylist()]
        docs += [np.frombuffer(x, np.int64) for x in b["docs"].to_pylist()]
    if not tokens:
        return
    t, d = np.concatenate(tokens), np.concatenate(docs)
    tokens.clear()
    docs.clear()
    order = np.argsort(t, kind="stable")
    t, d = t[order], d[order]
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    size = np.diff(np.append(first, len(t)))
    with np.errstate(over="ignore"):
        member = mixed(np.add.reduceat(mixed(d.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), first) + size.astype(np.uint64))
    many = np.flatnonzero(size > 1)
    _, one = np.unique(member[many], return_index=True)
    for part in np.array_split(many[one], max(1, int(size[many[one]].sum()) // 200_000)):
        n = size[part]
        at = np.repeat(first[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(member[part], n).view(np.int64)), pa.array(d[at])], ["cell", "doc"])


class RTree:
    """Points packed by their total into leaves of LEAF; a node keeps the upper corner of what is below it, and the least total."""

    def __init__(self, points: np.ndarray):
        self.order = np.argsort(points.sum(1), kind="stable")
        self.levels = [(points[self.order], points[self.order].sum(1))]
        while len(self.levels[-1][0]) > LEAF:
            p, n = self.levels[-1]
            cut = np.arange(0, len(p), LEAF)
            self.levels.append((np.maximum.reduceat(p, cut), np.minimum.reduceat(n, cut)))

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points whose bound allows a link with q, and the bounds as parts of the two totals."""
        total = int(q.sum())
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            p, n = self.levels[k][0][at], self.levels[k][1][at]
            bound = np.minimum(p, q).sum(1)
            ok = ((NUM + DEN) * bound >= NUM * (total + n)) & (bound > 0)
            if k == 0:
                ok &= (DEN * n >= NUM * total) & (NUM * n <= DEN * total)
                return self.order[at[ok]], bound[ok] / (total + n[ok])
            at = (at[ok][:, None] * LEAF + np.arange(LEAF)).reshape(-1)
            at = at[at < len(self.levels[k - 1][0])]
        raise AssertionError


def _candidates(across: bool):
    """Rows sorted by group (g1, g2, g3), with doc, label, pt, to pairs (a, b): best partners, or all across labels and (in pairs of blocks) sides."""

    def pairs(rows: list) -> Iterator[tuple[int, int]]:
        if len(rows) < 2:
            return
        docs, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        points = np.array([counts_of(r[2]) for r in rows])
        tree = RTree(points)
        for i in range(len(rows)):
            near, bound = tree.search(points[i])
            ok = labels[near] != labels[i] if across else near < i
            if across:
                for j in near[ok].tolist():
                    if docs[i] < docs[j]:
                        yield int(docs[i]), int(docs[j])
            elif ok.any():
                j = near[ok][bound[ok].argmax()]
                yield int(min(docs[i], docs[j])), int(max(docs[i], docs[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for b in batches:
            for k1, k2, k3, doc, label, pt in zip(*(b[c].to_pylist() for c in ("g1", "g2", "g3", "doc", "label", "pt")), strict=True):
                if (k1, k2, k3) != key:
                    found += pairs(rows)
                    key, rows = (k1, k2, k3), []
                rows.append((doc, label, pt))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])
            found = []
        found += pairs(rows)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _search(dealt: DataFrame, across: bool) -> DataFrame:
    keys = ["g1", "g2", "g3"]
    n = width(dealt.sparkSession)
    return map_batches(dealt.repartition(n, *keys).sortWithinPartitions(*keys, "doc"), _candidates(across), "a long, b long").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, doc, roles in zip(strings(b["text"]), b["doc"].to_pylist(), b["roles"].to_pylist(), strict=True):
            s = shingles(text).tobytes()
            rows += [(r["a"], r["portion"], doc, s) for r in roles]
            if len(rows) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["a", "portion", "doc", "set"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["a", "portion", "doc", "set"])


def _verify_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, own = None, {}  # rows of one id may have several sets
    for b in batches:
        out = []
        for a, portion, doc, s in zip(b["a"].to_pylist(), b["portion"].to_pylist(), b["doc"].to_pylist(), b["set"].to_pylist(), strict=True):
            if doc == a:
                key, own = (a, portion), own if key == (a, portion) else {}
                own.setdefault(s, np.frombuffer(s, np.uint64))
            elif key == (a, portion) and any(linked(o, np.frombuffer(s, np.uint64)) for o in own.values()):
                out.append((a, doc))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs (a < b) whose whole sets are linked; a's set travels once for every PORTION partners."""
    n = width(pairs.sparkSession)
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / PORTION).cast("int").alias("portions"))
    own = many.select(F.col("a").alias("doc"), "a", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))
    other = pairs.join(many, "a").select(F.col("b").alias("doc"), "a", F.pmod(F.xxhash64("b"), F.col("portions")).cast("int").alias("portion"))
    roles = own.unionByName(other).groupBy("doc").agg(F.collect_list(F.struct("a", "portion")).alias("roles"))
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(roles.hint("merge"), "doc")  # roles grow with the corpus, so they are never broadcast
    sets = map_batches(texts, _sets, "a long, portion int, doc long, set binary")
    dealt = sets.repartition(n, "a", "portion").sortWithinPartitions("a", "portion", "doc")
    return map_batches(dealt, _verify_sorted, "a long, b long").distinct()


def _release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shards = width(spark)
    about = held(_describe(docs))
    base = about.where("not heavy").drop("heavy")
    classes = base.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.first("pt").alias("pt"))
    reps = stash(classes, "classes")
    members = stash(base.drop("pt").join(reps.drop("pt"), ["fp1", "fp2", "n"], "left").select("doc_id", "n", "rep"), "members")
    heavy = spark.sparkContext.broadcast(_heavy(about))
    about.unpersist()
    packed = map_batches(docs.where("doc_id is not null"), _deal(shards, heavy), "shard int, tokens binary, docs binary")
    cells = map_batches(packed.repartition(shards, "shard").select("tokens", "docs"), _cells, "cell long, doc long")
    of = members.where("rep is not null").select(F.col("doc_id").alias("doc"), "rep").distinct()
    cells = stash(cells.distinct().join(of, "doc").select("cell", F.col("rep").alias("doc")).distinct(), "cells")
    many = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("pivot")).where("size > 1")
    cells = stash(cells.join(many, "cell"), "cells")
    _release(spark)
    points = reps.select(F.col("rep").alias("doc"), "pt")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    round1 = cells.withColumn("g2", F.explode(F.when((F.col("doc") == F.col("pivot")) & (blocks > 1), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(mine))))
    round1 = round1.join(points, "doc").select(F.col("cell").alias("g1"), "g2", F.lit(0).alias("g3"), "doc", F.col("doc").alias("label"), "pt")
    tested = stash(_search(round1, False), "pairs")
    # rows of one id are one vertex, so its classes are linked
    ids = of.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc", "a")
    same = of.join(ids, "doc").select("a", F.col("rep").alias("b")).where("a <> b")
    links = stash(verified(tested, docs).unionByName(same), "verified")
    _release(spark)
    found = components(links)
    labelled = cells.join(found.withColumnRenamed("id", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc"))
    mixed_cells = labelled.groupBy("cell").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("cell")
    open_ = labelled.join(mixed_cells, "cell").join(points, "doc").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    round2 = open_.select(F.col("cell").alias("g1"), F.least("mine", "other").alias("g2"), F.greatest("mine", "other").alias("g3"), "doc", "label", "pt")
    more = stash(_search(round2, True).join(tested, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        late = stash(verified(more, docs), "verified")
        if late.limit(1).count():
            found = components(links.unionByName(late))
    # copies share their rep, and what was found grows with the corpus: a merge join, whose hot keys Spark splits
    out = members.join(stash(found.withColumnRenamed("id", "rep"), "found").hint("merge"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) of one document a component, the one with the smallest id; rows without an id stay."""
    keep = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.select(docs.columns).unionByName(docs.where("doc_id is null"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
