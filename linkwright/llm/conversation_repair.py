"""Conversation structure repair by a suffix-shared automaton.

A conversation becomes a signature: one symbol for each row, which says what its role and its fault let an edit do.
Signatures are cut into segments of a bounded number of rows, and equal segments of all conversations are one. They
form an automaton in which what ends alike is one node, shared from the end on. Each node has, for each
state of the grammar, the least cost from there to the end and the least string of edits that has it, made from
the node behind it; a node is worked out once, whatever number of conversations pass through it.
A segment that more segments follow is worked out for each state in which it can hand over, and a
conversation's segments are then put together from its last one on.

The grammar of role initials is (s?(ua)+)?. Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert 5; a
blank or duplicate row must go, a truncated one that stays costs 5 more.

Strings can be put together part by part: two of equal cost for the same rows and hand-over state are
never one the start of the other (they would differ by inserts, which cost), so the lesser stays the lesser
whatever follows.

Defined results: a null id, turn, role or text reads as one space in what is hashed, a null role or text is one
space, null turns come first and are left out of gaps; rows of a conversation with equal turns go by role and then by
the text's SHA-256; equal rows are duplicates of the first of them; an empty role has no initial, so that it
can be reroled or deleted and not kept; a conversation without rows has nothing to repair; texts may be as long as
memory holds one; an empty table gives no rows; other columns are ignored. Repair reads a conversation in
one stream, since its digest is one; only its string of edits is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.common import materialize
from linkwright.shipping import arrow_map

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar: start, after s, after u, after a. Where an initial leads; where a conversation may end.
GOES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Rows of a segment, at most.
SEGMENT_ROWS = 256
BLANKS = r"[\x20\x09-\x0D]"


# ---- rows and faults ----


def damaged_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that a row's hash names; all but dropped rows."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    changed = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"), changed.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with text_sha256, blank and cut (truncated); which are duplicates is known only among all of them."""
    shown = F.regexp_replace("text", f"{BLANKS}+$", "")
    return rows.select("*", F.sha2("text", 256).alias("text_sha256"), (F.length(shown) == 0).alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text_sha256, blank, cut, copies, again): one row for equal ones; ``again`` says that an earlier turn has it."""
    slim = rows.groupBy("conv_id", "turn", "role", "text_sha256", "blank", "cut").agg(F.sum("copies").alias("copies"))
    first = slim.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text_sha256").alias("_h")).agg(F.min(F.struct("turn")).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text_sha256") == F.col("_h"))
    return slim.join(first, same).withColumn("again", ~F.col("turn").eqNullSafe(F.col("_first.turn"))).drop("_c", "_r", "_h", "_first")


def counts(marks: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) by each row's first fault."""
    spare = F.when(F.col("again"), F.col("copies")).otherwise(F.col("copies") - 1)
    some = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint")
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return marks.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).cast("bigint").alias("gaps"),
        some(F.when(F.col("blank"), F.col("copies"))).alias("blank"),
        some(F.when(~F.col("blank"), spare)).alias("duplicate"),
        some(F.when(~F.col("blank") & ~F.col("again") & F.col("cut"), 1)).alias("truncated"),
    )


# ---- signatures ----


def symbols(marks: DataFrame) -> DataFrame:
    """Marks with ``initial`` (s, u, a or o for others) and ``symbol`` of the first copy: x must go; the initial, as a capital where truncated."""
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    gone = F.col("blank") | F.col("again")
    return marks.withColumn("initial", initial).withColumn("symbol", F.when(gone, F.lit("x")).when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial")))


def segments(marks: DataFrame, rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, part, seg, signature, front, back, illegal): pieces of conversations in the order of (part, seg).

    All rows are sorted as one, so that a conversation of any length is spread over tasks.
    """
    order = ["conv_id", "turn", "role", "text_sha256"]
    placed = symbols(marks).select(*order, "copies", "initial", "symbol").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("conv_id", "copies", "initial", "symbol", F.spark_partition_id().alias("part"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "seg", "signature", "front", "back", "illegal"]
        kinds = None
        at, seg, signature, initials, part = None, 0, [], [], 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal seg
            if signature:
                bad = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
                out.append((at, part, seg, "".join(signature), initials[0], initials[-1], bad))
                signature.clear()
                initials.clear()
                seg += 1

        def given() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        begun = False
        for batch in it:
            kinds = [batch.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            for conv, copies, initial, symbol, p in zip(*(batch[c].to_pylist() for c in ("conv_id", "copies", "initial", "symbol", "part"))):
                if not begun or conv != at:
                    close()
                    at, seg, begun = conv, 0, True
                part = p
                for k in range(copies):
                    signature.append(symbol if k == 0 else "x")
                    initials.append(initial)
                    if len(signature) == rows:
                        close()
                        if len(out) >= 4096:
                            yield given()
            if out:
                yield given()
        close()
        if out:
            yield given()

    kind = marks.schema["conv_id"].dataType.simpleString()
    return arrow_map(placed, batches, f"conv_id {kind}, part int, seg bigint, signature string, front string, back string, illegal bigint")


# ---- the automaton ----

Best = tuple[int, str] | None
Node = list[Best]


def _least(*some: Best) -> Best:
    return min((x for x in some if x is not None), default=None)


def _with_inserts(node: Node) -> Node:
    """Costs where texts may be inserted first; three go round all states, more never pay."""
    for _ in range(3):
        node = [_least(node[g], *((node[to][0] + INSERT, "I" + node[to][1]) for c, to in GOES[g].items() if c in ROLES and node[to] is not None)) for g in range(4)]
    return node


def end_node(at: int | None) -> Node:
    """The node behind the last symbol: a conversation's end, or the hand-over in a state."""
    if at is None:
        return _with_inserts([(0, "") if g in ENDS else None for g in range(4)])
    return [(0, "") if g == at else None for g in range(4)]


def node_before(symbol: str, rest: Node) -> Node:
    """The node that reads ``symbol`` and goes on as ``rest``."""
    edit = lambda best, cost, letter: None if best is None else (best[0] + cost, letter + best[1])
    out = []
    for g in range(4):
        some = [edit(rest[g], DELETE, "D")]
        if symbol != "x":
            more = TRUNCATED if symbol.isupper() else 0
            if (to := GOES[g].get(symbol.lower())) is not None:
                some.append(edit(rest[to], KEEP + more, "K"))
            some += [edit(rest[to], REROLE + more, "R") for c, to in GOES[g].items() if c in ROLES]
        out.append(_least(*some))
    return _with_inserts(out)


class Path:
    """The nodes that a signature passes through, from its end on; signatures come sorted by their reversed texts.

    In that order the signatures that pass through a node stand together, so only the present ones are held.
    """

    def __init__(self, at: int | None) -> None:
        self.back, self.nodes = "", [end_node(at)]

    def first(self, back: str) -> Node:
        """The first node of the signature that reads ``back`` from its end."""
        shared = next((k for k, (x, y) in enumerate(zip(self.back, back)) if x != y), min(len(self.back), len(back)))
        del self.nodes[shared + 1 :]
        for symbol in back[shared:]:
            self.nodes.append(node_before(symbol, self.nodes[-1]))
        self.back = back
        return self.nodes[-1]


def solved(parts: DataFrame) -> DataFrame:
    """(signature, last, costs, edits) of distinct (signature, last): for each state to begin in, of each state to hand over in if not last.

    Dealt out by ranges of reversed signatures: but for those at a border of ranges, nodes are worked out once.
    """
    texts = parts.select("last", F.reverse("signature").alias("back")).distinct().repartitionByRange("last", "back").sortWithinPartitions("last", "back")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ending, handing = Path(None), [Path(g) for g in range(4)]
        for batch in it:
            back, last = batch["back"].to_pylist(), batch["last"].to_pylist()
            best = [ending.first(b) if end else [x for path in handing for x in path.first(b)] for b, end in zip(back, last)]
            costs = [[None if x is None else x[0] for x in node] for node in best]
            edits = [[None if x is None else x[1] for x in node] for node in best]
            columns = [pa.array([b[::-1] for b in back], pa.string()), batch["last"], pa.array(costs, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["signature", "last", "costs", "edits"])

    return arrow_map(texts, batches, "signature string, last boolean, costs array<bigint>, edits array<string>")


def audits(parts: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of segments."""
    w = Window.partitionBy("conv_id").orderBy("part", "seg")
    met = F.concat(F.lag("back").over(w), F.col("front"))
    parts = parts.withColumn("last", F.lead("seg").over(w).isNull()).withColumn("illegal", F.col("illegal") + F.when(met.isNull() | met.isin("su", "ua", "au"), 0).otherwise(1))
    parts = materialize(parts)
    known = solved(parts).withColumnsRenamed({"signature": "_s", "last": "_l"})
    rows = parts.join(known, (F.col("signature") == F.col("_s")) & (F.col("last") == F.col("_l")))
    rows = rows.select("conv_id", "part", "seg", "illegal", "last", "costs", "edits").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
    names = ["conv_id", "illegal", "cost", "audit"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node: Node = []
        at, illegal, begun, kinds = None, 0, False, None
        out: list[tuple] = []
        for batch in it:
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string()]
            for conv, bad, last, costs, edits in zip(*(batch[c].to_pylist() for c in ("conv_id", "illegal", "last", "costs", "edits"))):
                best = [None if c is None else (c, e) for c, e in zip(costs, edits)]
                if last:
                    if begun:
                        out.append((at, illegal, *node[0]))
                    at, illegal, begun, node = conv, bad, True, best
                else:
                    illegal += bad
                    joined = lambda g, to, best=best, node=node: None if best[4 * to + g] is None or node[to] is None else (best[4 * to + g][0] + node[to][0], best[4 * to + g][1] + node[to][1])
                    node = [_least(*(joined(g, to) for to in range(4))) for g in range(4)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((at, illegal, *node[0]), kinds)], names)

    return arrow_map(rows, batches, f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, illegal bigint, cost bigint, audit string")


# ---- repair ----


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits and then its rows, in one stream."""
    none = lambda kind: F.lit(None).cast(kind)
    heads = found.select("conv_id", F.lit(True).alias("head"), none(rows.schema["turn"].dataType).alias("turn"), none("string").alias("role"), none("string").alias("text_sha256"), F.col("audit").alias("text"), F.lit(1).alias("copies"))
    body = rows.select("conv_id", F.lit(False).alias("head"), "turn", "role", "text_sha256", "text", "copies")
    both = heads.unionByName(body).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.desc("head"), "turn", "role", "text_sha256").select("conv_id", "head", "role", "text", "copies")


def repaired_rows(conv_rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, head, role, text) of a stream of ``_in_order``: its heads, and the rows as edited."""
    state, edits, roles = 0, iter(""), {2: "user", 3: "assistant"}

    def inserted() -> Iterator[tuple]:
        nonlocal state, edit
        while (edit := next(edits, "")) == "I":
            state = GOES[state]["a" if state == 2 else "u"]
            yield at, False, roles[state], ""

    edit, at = "", None
    for conv, head, role, text, copies in conv_rows:
        if head:
            state, edits, at = 0, iter(text), conv
            yield conv, True, role, text
            yield from inserted()
            continue
        for _ in range(copies):
            if edit == "K":
                state = GOES[state][role[:1]]
                yield conv, False, role, text
            elif edit == "R":
                state = GOES[state]["a" if state == 2 else "u"]
                yield conv, False, roles[state], text
            yield from inserted()


class Stream:
    """The rows of ``_in_order``, and the type of their ids."""

    def __init__(self, it: Iterator[pa.RecordBatch]) -> None:
        self.it, self.id_type = it, None

    def __iter__(self) -> Iterator[tuple]:
        for batch in self.it:
            self.id_type = batch.schema.field("conv_id").type
            yield from zip(*(batch[c].to_pylist() for c in ("conv_id", "head", "role", "text", "copies")))


def _table(rows: list[tuple], names: list[str], id_type: pa.DataType, *kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [id_type, *kinds])], names)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the rows that the edits leave and add."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, position = [], 0, 0
        make = lambda: _table(out, ["conv_id", "position", "role", "text"], stream.id_type, pa.int64(), pa.string(), pa.string())
        stream = Stream(it)
        for conv, head, role, text in repaired_rows(stream):
            if head:
                position = 0
                continue
            out.append((conv, position, role, text))
            position, size = position + 1, size + len(text)
            if len(out) >= 1000 or size > 4_000_000:
                yield make()
                out, size = [], 0
        if out:
            yield make()

    return arrow_map(_in_order(rows, found), batches, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position bigint, role string, text string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of role:text of the repaired rows, joined by newlines."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, some, at = [], None, False, None
        make = lambda: _table(out, ["conv_id", "repaired_sha256"], stream.id_type, pa.string())
        stream = Stream(it)
        for conv, head, role, text in repaired_rows(stream):
            if not head:
                digest.update((("\n" if some else "") + role + ":" + text).encode())
                some = True
                continue
            if digest is not None:
                out.append((at, digest.hexdigest()))
            digest, some, at = hashlib.sha256(), False, conv
            if len(out) >= 4096:
                yield make()
                out = []
        if digest is not None:
            out.append((at, digest.hexdigest()))
            yield make()

    return arrow_map(_in_order(rows, found), batches, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text, copies): the rows with faults, (conv_id, illegal, cost, audit), and the faults' counts."""
    rows = materialize(with_faults(rows))
    marks = materialize(marked(rows))
    return rows, materialize(audits(segments(marks, segment_rows))), counts(marks)


def report(conversations: DataFrame, rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row for every conv_id of ``conversations``: gaps, faults, cost, audit and repaired_sha256 of its ``rows``."""
    rows, found, faults = repair(rows, segment_rows)
    digests = repaired_digests(rows, found)
    out = conversations.select("conv_id").distinct()
    for k, more in enumerate((faults, found, digests)):
        out = out.join(more.withColumnRenamed("conv_id", f"_c{k}"), F.col("conv_id").eqNullSafe(F.col(f"_c{k}")), "left").drop(f"_c{k}")
    long = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *(long(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
