"""Repair of conversations with the fewest edits, by a graph of tight arcs.

The graph of a conversation has a node for each place between its rows and each state of the pattern (s?(ua)+)? of role
initials: nothing yet, after s, after u, after a. Arcs keep, rerole or delete the next row, or insert one. Forward and backward
minimum costs tell which arcs are tight, that is on some cheapest path; a walk over the set of nodes reached by the letters
so far picks the least letter of their tight arcs at each step, so the letters are the least of all cheapest repairs.

Rows are reduced to one mark each (initial, and whether the row is sound, truncated or to be deleted) and dealt by ranges of
(conversation, turn, ...), so a conversation however long is cut into segments of at most one range. Minimum costs over a segment are
a 4 x 4 matrix, and these compose: a conversation in one segment is solved at once; of one that is cut, each segment gives its matrix,
the costs before and after each come from the matrices of the others (at most one a range), and each segment then walks from
every state that can enter it, of which the chain from the start picks one. No conversation is gathered but its audit, one letter an
edit. Texts are dealt once, at the end, and stream by conversation in order: the digest of a conversation is a chain over its rows, so
that last step takes them one after the other, in bounded memory.

Defined results: nulls count as one space in conv_id:turn, role and text, which makes such a text blank; null turns come first; null
conv_id are one conversation. Rows of one turn follow by role, then by a digest of the text, copies beside each other. A role
counts by its first character, case and all; an empty role has none and can't be kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, map_batches, stash, table, width

NOTHING, S, U, A = range(4)
#: The state after a role initial; pairs that are absent are not allowed.
NEXT = {(NOTHING, "s"): S, (NOTHING, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: The only role that can be put after each state.
PUT = {NOTHING: U, S: U, U: A, A: U}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 40
#: Marks of a row: s, u, a or another initial; upper case where truncated; - for rows that must go.
OTHER, GO = "x", "-"
ROLES = {U: "user", A: "assistant"}

Vector = tuple[int, int, int, int]


def moves(mark: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Letters, costs and states after a row with this mark."""
    yield "D", DELETE, state
    if mark != GO:
        more = TRUNCATED if mark.isupper() else 0
        to = NEXT.get((state, mark.lower()))
        if to is not None:
            yield "K", more, to
        yield "R", REROLE + more, PUT[state]


def after(mark: str, costs: Vector) -> Vector:
    """Minimum costs of the states after a row, from those before it, in which insertions are counted."""
    out = [FAR] * 4
    for q in range(4):
        if costs[q] < FAR:
            for _, c, to in moves(mark, q):
                out[to] = min(out[to], costs[q] + c)
    return inserted(tuple(out))


def inserted(costs: Vector) -> Vector:
    out = list(costs)
    for _ in range(3):
        for q in range(4):
            out[PUT[q]] = min(out[PUT[q]], out[q] + INSERT)
    return tuple(min(c, FAR) for c in out)


def left(costs: Vector) -> Vector:
    """Minimum costs to the end where insertions come first."""
    out = list(costs)
    for _ in range(3):
        for q in range(4):
            out[q] = min(out[q], INSERT + out[PUT[q]])
    return tuple(min(c, FAR) for c in out)


def before(mark: str, costs: Vector) -> Vector:
    """Minimum costs to the end from the states before a row, from those after it."""
    return left(tuple(min(c + costs[to] for _, c, to in moves(mark, q)) for q in range(4)))


START: Vector = inserted((0, FAR, FAR, FAR))
END: Vector = left((0, FAR, FAR, 0))


def backward(marks: str, end: Vector) -> list[Vector]:
    out = [end]
    for m in reversed(marks):
        out.append(before(m, out[-1]))
    return out[::-1]


def forward(marks: str, start: Vector) -> list[Vector]:
    out = [start]
    for m in marks:
        out.append(after(m, out[-1]))
    return out


def walk(marks: str, ahead: list[Vector], behind: list[Vector], best: int, states: set[int], last: bool) -> tuple[str, set[int]]:
    """The least letters along tight arcs from any of states, and the states they end in; last: the conversation ends here."""
    letters, at = [], 0
    while at < len(marks) or (last and not any(q in (NOTHING, A) and ahead[at][q] == best for q in states)):
        arcs = [("I", at, PUT[q]) for q in states if ahead[at][q] + INSERT + behind[at][PUT[q]] == best]
        if at < len(marks):
            arcs += [(x, at + 1, to) for q in states for x, c, to in moves(marks[at], q) if ahead[at][q] + c + behind[at + 1][to] == best]
        least = min(x for x, _, _ in arcs)
        letters.append(least)
        states = {to for x, _, to in arcs if x == least}
        at = next(k for x, k, _ in arcs if x == least)
    return "".join(letters), states


@lru_cache(4096)
def solve(marks: str) -> tuple[str, int]:
    """Audit and cost of a whole conversation."""
    ahead, behind = forward(marks, START), backward(marks, END)
    best = behind[0][NOTHING]
    return walk(marks, ahead, behind, best, {NOTHING}, True)[0], best


def crossing(marks: str) -> list[int]:
    """Minimum costs from each state before a segment to each state after it, by rows."""
    return [c for q in range(4) for c in forward(marks, inserted(tuple(0 if k == q else FAR for k in range(4))))[-1]]


# ---- tables ----

_ = F.col
ORDER = ("turn", "role", "text_key", "copy")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations (conv_id, turn, role, text) after the contract's damage, with copy; nulls of role and text as a space."""
    word = lambda c: F.coalesce(_(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(_("fault") == 1, "").when(_("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(_("text"))
    copies = F.when(_("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(_("fault") == 4, "user").otherwise(_("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text_key", F.sha2(_("text").cast("binary"), 256))


def _keys() -> list[Column]:
    return [_("conv_id").asc_nulls_first(), _("turn").asc_nulls_first(), _("role"), _("text_key"), _("copy")]


def marks(rows: DataFrame) -> DataFrame:
    """conv_id, pos, part, turn, initial, fault (blank, duplicate, truncated or null) and mark for rows (conv_id, turn, role, text, copy), in order."""
    ink = F.regexp_replace("text", f"[{SPACES}]+$", "")
    bare = _keyed(rows).select("conv_id", *ORDER, (F.length(ink) == 0).alias("blank"), (~F.substring(ink, -1, 1).isin(".", "!", "?")).alias("cut"))
    dealt = bare.repartitionByRange(width(rows.sparkSession), *_keys()).sortWithinPartitions(*_keys())
    placed = stash(dealt.withColumn("pos", F.monotonically_increasing_id()), "turns")
    firsts = placed.groupBy("conv_id", "role", "text_key").agg(F.min("pos").alias("first")).select("first")
    all_rows = placed.join(firsts, _("pos") == _("first"), "left")
    fault = F.when(_("blank"), "blank").when(_("first").isNull(), "duplicate").when(_("cut"), "truncated")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    out = all_rows.select("conv_id", "pos", F.shiftright("pos", 33).cast("int").alias("part"), "turn", initial.alias("initial"), fault.alias("fault"), known.alias("known"))
    return out.withColumn("mark", F.when(_("fault").isin("blank", "duplicate"), GO).when(_("fault").isNotNull(), F.upper("known")).otherwise(_("known"))).drop("known")


def segments(marked: DataFrame) -> DataFrame:
    """A row for each conversation and range: its marks in order, counts of faults, illegal pairs inside, first and last initial."""
    line = F.sort_array(F.collect_list(F.struct("pos", "mark", "initial")))  # at most the rows of one range
    counts = [F.count_if(_("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    s = marked.groupBy("conv_id", "part").agg(line.alias("line"), *counts)
    pair = lambda i: F.concat(F.get("line", i)["initial"], F.get("line", i + 1)["initial"])
    wrong = F.aggregate(F.sequence(F.lit(0), F.size("line") - 2), F.lit(0).cast("long"), lambda n, i: n + F.when(pair(i).isin("su", "ua", "au"), 0).otherwise(1))
    inside = F.when(F.size("line") < 2, F.lit(0).cast("long")).otherwise(wrong)
    return s.select("conv_id", "part", F.array_join(F.transform("line", lambda x: x["mark"]), "").alias("marks"), "blank", "duplicate", "truncated", inside.alias("illegal"), _("line")[0]["initial"].alias("head"), F.element_at("line", -1)["initial"].alias("tail"))


def _solved(whole: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [solve(m) if len(m) <= 64 else solve.__wrapped__(m) for m in b["marks"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["conv_id"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], ["conv_id", "audit", "cost"])

    return map_batches(whole.select("conv_id", "marks"), run, f"conv_id {whole.schema['conv_id'].dataType.simpleString()}, audit string, cost long")


def _by_conversation(df: DataFrame, f: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """f of the rows of each conversation by part: at most one row a range and entry state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["conv_id"] != r["conv_id"]:
                    yield from made(held)
                    held = []
                held.append(r)
        if held:
            yield from made(held)

    def made(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        out = f(rows)
        kinds = [kind_of[x.split()[1]] for x in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], k) for n, k in zip(names, kinds, strict=True)], names)

    kind_of = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return map_batches(df.repartition(width(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part"), run, schema)


def chained(rows: list[dict]) -> list[dict]:
    """The costs before and after each segment of a conversation, from the matrices of all."""
    through = [[r["crossing"][4 * q : 4 * q + 4] for q in range(4)] for r in rows]
    ahead = [START]
    for m in through[:-1]:
        ahead.append(tuple(min(ahead[-1][q] + m[q][to] for q in range(4)) for to in range(4)))
    behind = [END]
    for m in reversed(through[1:]):
        behind.append(tuple(min(m[q][to] + behind[-1][to] for to in range(4)) for q in range(4)))
    behind = behind[::-1]
    first = through[0]
    best = min(first[NOTHING][to] + behind[0][to] for to in range(4))
    return [{"conv_id": r["conv_id"], "part": r["part"], "ahead": list(a), "behind": list(z), "best": best, "last": k + 1 == len(rows)} for k, (r, a, z) in enumerate(zip(rows, ahead, behind, strict=True))]


def joined(rows: list[dict]) -> list[dict]:
    """The walks of a conversation's segments, each from the state that the one before ended in."""
    state, letters = NOTHING, []
    by_part: dict[int, dict[int, dict]] = {}
    for r in rows:
        by_part.setdefault(r["part"], {})[r["enter"]] = r
    for part in sorted(by_part):
        r = by_part[part][state]
        state = r["leave"]
        letters.append(r["letters"])
    return [{"conv_id": rows[0]["conv_id"], "audit": "".join(letters), "cost": rows[0]["best"]}]


def _walks(rows: DataFrame) -> DataFrame:
    """For each segment with its costs, the walk from every state that a cheapest path can enter it by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                ahead, behind = forward(r["marks"], tuple(r["ahead"])), backward(r["marks"], tuple(r["behind"]))
                for q in range(4):
                    if ahead[0][q] + behind[0][q] == r["best"]:
                        letters, ends = walk(r["marks"], ahead, behind, r["best"], {q}, r["last"])
                        out.append((r["conv_id"], r["part"], q, min(ends), letters, r["best"]))
            names = ["conv_id", "part", "enter", "leave", "letters", "best"]
            kinds = [b.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    return map_batches(rows, run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part int, enter int, leave int, letters string, best long")


def audits(segs: DataFrame) -> DataFrame:
    """conv_id, audit and cost of every conversation of segments."""
    kind = segs.schema["conv_id"].dataType.simpleString()
    many = segs.groupBy(_("conv_id").alias("_id")).count().where("count > 1").select("_id")  # at most one a range
    same = _("conv_id").eqNullSafe(_("_id"))
    whole = _solved(segs.join(many, same, "left_anti"))
    cut = stash(segs.join(many, same, "left_semi").select("conv_id", "part", "marks"), "cut")
    if cut.isEmpty():
        return whole

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["part"], pa.array([crossing(m) for m in b["marks"].to_pylist()], pa.list_(pa.int64()))], ["conv_id", "part", "crossing"])

    matrices = map_batches(cut, cross, f"conv_id {kind}, part int, crossing array<long>")
    ends = _by_conversation(matrices, chained, f"conv_id {kind}, part int, ahead array<long>, behind array<long>, best long, last boolean")
    ends = ends.withColumnsRenamed({"conv_id": "_id", "part": "_part"})
    walks = _walks(cut.join(ends, same & (_("part") == _("_part"))).drop("_id", "_part"))
    return whole.unionByName(_by_conversation(walks, joined, f"conv_id {kind}, audit string, cost long"))


def _emitted(letters: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of a conversation from its audit and its rows; both are read in step."""
    state = NOTHING
    for x in letters:
        if x == "I":
            state = PUT[state]
            yield ROLES[state], ""
            continue
        role, text = next(rows)
        if x == "K":
            state = NEXT[state, role[:1]]
            yield role, text
        elif x == "R":
            state = PUT[state]
            yield ROLES[state], text


def _streamed(rows: DataFrame, found: DataFrame, digest: bool) -> DataFrame:
    """Rows of each conversation in order behind its audit: its digest, or its repaired rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    keyed = _keyed(rows).select("conv_id", F.lit(1).alias("after"), *ORDER, "text")
    heads = found.select("conv_id", F.lit(0).alias("after"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text_key"), F.lit(0).alias("copy"), _("audit").alias("text"))
    keys = _keys()
    dealt = keyed.unionByName(heads).repartition(width(rows.sparkSession), "conv_id").sortWithinPartitions(keys[0], "after", *keys[1:]).select("conv_id", "after", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("conv_id", "after", "role", "text")), strict=True))
        head, out = next(flow, None), []

        def own() -> Iterator[tuple[str, str]]:
            """The rows up to the next audit, which stays at hand."""
            nonlocal head
            head = None
            for r in flow:
                if not r[1]:
                    head = r
                    return
                yield r[2], r[3]

        while head is not None:
            conv, audit = head[0], head[3]
            rest = own()
            hashed, n = hashlib.sha256(), 0
            for role, text in _emitted(iter(audit), rest):
                if digest:
                    hashed.update((("\n" if n else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                else:
                    out.append((conv, n, role, text))
                n += 1
                if len(out) >= 1024:
                    yield made(out)
                    out = []
            for _row in rest:  # rows after the last letter: none
                raise AssertionError("an audit is shorter than its conversation")
            if digest:
                out.append((conv, hashed.hexdigest()))
                if len(out) >= 1024:
                    yield made(out)
                    out = []
        yield made(out)

    names = ["conv_id", "repaired_sha256"] if digest else ["conv_id", "turn", "role", "text"]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[kind], pa.string()] if digest else [kinds[kind], pa.int64(), pa.string(), pa.string()]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

    return map_batches(dealt, run, f"conv_id {kind}, repaired_sha256 string" if digest else f"conv_id {kind}, turn long, role string, text string")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations (conv_id, turn from 0, role, text) of rows (conv_id, turn, role, text, copy)."""
    return _streamed(rows, stash(audits(stash(segments(marks(rows)), "segments")), "audits"), False)


def report(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id: gaps, faults, cost, audit and digest after the contract's damage."""
    rows = damaged(conversations)
    marked = marks(rows)
    segs = stash(segments(marked), "segments")
    found = stash(audits(segs), "audits")
    turns = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("one")).cast("long").alias("gaps"))
    ends = F.sort_array(F.collect_list(F.struct("part", "head", "tail")))  # at most one a range
    sums = segs.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], ends.alias("ends"))
    between = F.aggregate(F.sequence(F.lit(0), F.size("ends") - 2), F.lit(0).cast("long"), lambda n, i: n + F.when(F.concat(F.get("ends", i)["tail"], F.get("ends", i + 1)["head"]).isin("su", "ua", "au"), 0).otherwise(1))
    sums = sums.withColumn("illegal", _("illegal") + F.when(F.size("ends") < 2, 0).otherwise(between)).drop("ends")
    out = conversations.select("conv_id").distinct()
    for part in (turns, sums, found, _streamed(rows, found, True)):
        out = out.join(part.withColumnRenamed("conv_id", "_id"), _("conv_id").eqNullSafe(_("_id")), "left").drop("_id")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "conversations"))
