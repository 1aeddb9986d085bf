"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts earlier.

Which suffixes can match is found first. Every window of LENGTH bytes has an anchor, the run of GRAM bytes in it
with the least hash; equal windows have equal anchors at equal distances. Consecutive windows with one anchor
make a span of fewer than 2 * LENGTH bytes; texts are read SEGMENT window starts at a time. Spans with equal anchors
meet in one partition; copies of one span are settled there (all but the first go), and tasks combine the copies among
their own rows beforehand, so a passage that a third of all documents share sends one row from each batch. A task
streams through its anchors and holds HOT spans of one at most.

Only where different spans share an anchor can windows match in part. Those spans, once each, are dealt to
shards, groups of more than HOT of them to several. A shard's suffix array is built by Larsson-Sadakane
refinement in numpy: suffixes are sorted by eight bytes, and groups that are still tied are refined by the ranks
of the suffixes 8, 16, 32 and 64 bytes on. Common prefixes are taken in text order as Kasai does, up to LENGTH. Suffixes that
agree in LENGTH bytes are a class, of which the first stays. Sorted classes of shards that split a group are
merged by binary search of each list in the one before.

Whole spans are held equal if their anchors' hashes agree and so do their own, of 64 bits each; partial matches
are compared byte by byte.

Defined results: null text counts as empty; texts shorter than LENGTH are left alone; a null doc_id comes first;
rows with equal doc_ids and different texts are different documents, in the order of a hash of their texts; rows that
agree in doc_id and text are one document given again: they don't remove each other, and what is removed is removed in
each; very long texts are read in segments; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.bytewords import _RANDOM, groups, mix, powers
from linkwright.llm.common import body, materialize
from linkwright.shipping import arrow_map

LENGTH, GRAM = 100, 28
#: Spans of an anchor in one shard; bytes of a shard.
HOT, SHARD = 2048, 1_000_000
#: Window starts of a text that are read at a time.
SEGMENT = 1 << 24
#: Parts in which the classes of a split group are merged: many, as a group has no bound.
MERGE_PARTS = 1 << 16
NO_ID = -(2**63)
_AT = 26
_MASK = np.uint64((1 << _AT) - 1)


def spans(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor hash, span hash) of the spans of some texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_RANDOM[buf] * up[:n], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    least = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    width, goal = 1, LENGTH - GRAM + 1
    while width * 2 <= goal:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (goal - width)], least[goal - width :])
    anchor = (least & _MASK).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes - LENGTH + 1, 0))
    own = np.maximum(sizes - LENGTH + 1, 0)
    start = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin[:-1], own)
    a = anchor[start]
    if not len(a):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]))
    windows = np.diff(np.append(edge, len(a)))
    first = start[edge]
    last = first + windows - 1 + LENGTH
    span_hash = mix(((total[last] - total[first]) * down[first]) ^ (windows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return text[edge], first - begin[text[edge]], windows, mix(h[a[edge]] ^ np.uint64(0x5851F42D4C957F2D)), span_hash


def segments(text: bytes) -> list[bytes]:
    """Parts of a text that start SEGMENT bytes after one another, each with the bytes of its last window."""
    return [text[a : a + SEGMENT + LENGTH - 1] for a in range(0, max(1, len(text) - LENGTH + 1), SEGMENT)]


#: A document is named by doc and sub: its doc_id, and a hash of its text.
ROW = "ah long, sh long, doc long, sub long, pos int, n int, kind int"


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"ah": np.int64, "sh": np.int64, "doc": np.int64, "sub": np.int64, "pos": np.int32, "n": np.int32, "kind": np.int32}
    cast = {k: np.ascontiguousarray(v).view(np.int64) if v.dtype == np.uint64 else v.astype(kinds[k]) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(v) for v in cast.values()], list(cast))


def find_spans(docs: DataFrame) -> DataFrame:
    """ROW of every span; of those that agree within a batch only the first, the others as kind 1: to be removed."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, subs = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "sub"))
            texts, own, offset = [], [], []
            for k, text in enumerate(batch["body"].to_pylist()):
                for j, part in enumerate(segments(text)):
                    texts.append(part)
                    own.append(k)
                    offset.append(j * SEGMENT)
            own, offset = np.array(own, np.int64), np.array(offset, np.int64)
            lo, rows = 0, []
            for some in groups(texts):
                t, pos, n, ah, sh = spans(some)
                rows.append((ids[own[lo + t]], subs[own[lo + t]], pos + offset[lo + t], n, ah, sh))
                lo += len(some)
            doc, sub, pos, n, ah, sh = (np.concatenate(x) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 6
            if not len(doc):
                continue
            by = np.lexsort((pos, sub, doc, sh, ah))
            doc, sub, pos, n, ah, sh = doc[by], sub[by], pos[by], n[by], ah[by], sh[by]
            new = np.concatenate([[True], (ah[1:] != ah[:-1]) | (sh[1:] != sh[:-1])])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = differs(first, slice(None), doc, sub, pos)
            kept = ~later
            yield _batch(ah=ah[kept], sh=sh[kept], doc=doc[kept], sub=sub[kept], pos=pos[kept], n=n[kept], kind=np.zeros(kept.sum(), np.int64))
            if later.any():
                d, s, p, m = merge_ranges(doc[later], sub[later], pos[later], n[later])
                spread = mix(d.astype(np.uint64) ^ np.uint64(0xA5A5A5A5))
                yield _batch(ah=spread, sh=np.zeros(len(d), np.int64), doc=d, sub=s, pos=p, n=m, kind=np.ones(len(d), np.int64))

    return arrow_map(docs, batches, ROW)


def differs(a: np.ndarray | slice, b: np.ndarray | slice, *columns: np.ndarray) -> np.ndarray:
    """Where rows a and b differ in any of the columns."""
    return np.logical_or.reduce([c[a] != c[b] for c in columns])


def merge_ranges(doc: np.ndarray, sub: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join ranges of windows that follow one another in a document."""
    by = np.lexsort((pos, sub, doc))
    doc, sub, pos, n = doc[by], sub[by], pos[by], n[by]
    new = np.concatenate([[True], differs(slice(1, None), slice(None, -1), doc, sub) | (pos[1:] != pos[:-1] + n[:-1])])
    at = np.flatnonzero(new)
    return doc[at], sub[at], pos[at], np.add.reduceat(n, at)


def settle(spans_: DataFrame) -> DataFrame:
    """Kind 1: ranges to remove. Kind 2: spans that share their anchor with another one; n counts windows, sh their shard.

    Rows come sorted by ah, sh, doc, sub, pos. The different spans of the anchor that is still open are carried from
    batch to batch; when there are more than HOT of them, HOT go to a shard of their own.
    """
    names = ("ah", "sh", "doc", "sub", "pos", "n")

    def send(rows: list[np.ndarray], shard: np.ndarray) -> pa.RecordBatch:
        return _batch(**dict(zip(names, rows)) | {"sh": shard, "kind": np.full(len(shard), 2)})

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, sent = [np.zeros(0, np.int64)] * len(names), 0
        for batch in it:
            rows, kind = [batch[c].to_numpy() for c in names], batch["kind"].to_numpy()
            ready = kind == 1
            if ready.any():
                yield _batch(**{c: x[ready] for c, x in zip(names, rows)}, kind=kind[ready])
            if ready.all():
                continue
            rows = [np.concatenate([c, x[~ready]]) for c, x in zip(carry, rows)]
            ah, sh, doc, sub, pos, n = rows
            new_anchor = np.concatenate([[True], ah[1:] != ah[:-1]])
            new = new_anchor | np.concatenate([[True], sh[1:] != sh[:-1]])
            first = np.flatnonzero(new)
            later = differs(first[np.cumsum(new) - 1], slice(None), doc, sub, pos)
            if later.any():
                yield _batch(**{c: x[later] for c, x in zip(names, rows)}, kind=np.ones(later.sum(), np.int64))
            # of each different span the first; the last anchor stays open
            group = (np.cumsum(new_anchor) - 1)[first]
            rank = np.arange(len(first)) - np.searchsorted(group, group)
            many = np.bincount(group)[group]
            before = np.where((group == 0) & (len(carry[0]) > 0), sent, 0)
            closed = (group < group[-1]) & ((many > 1) | (before > 0))
            if closed.any():
                split = (many > HOT) | (before > 0)
                yield send([x[first[closed]] for x in rows], np.where(split, before + rank // HOT, -1)[closed])
            sent = int(before[-1])
            carry = [x[first[group == group[-1]]] for x in rows]
            while len(carry[0]) > HOT:
                yield send([x[:HOT] for x in carry], np.full(HOT, sent))
                carry, sent = [x[HOT:] for x in carry], sent + 1
        if len(carry[0]) > 1 or sent:
            yield send(carry, np.full(len(carry[0]), sent if sent else -1))

    return arrow_map(spans_, batches, ROW)


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(buf)].copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(buf: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes at least, and each suffix's rank; ties share a rank."""
    n = len(buf)
    key = words_at(buf)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[order] = head
    h = 8
    while h < depth:
        size = np.bincount(head, minlength=n)[head]
        tied = np.flatnonzero(size > 1)
        if not len(tied):
            break
        suffix = order[tied]
        next_rank = rank[np.minimum(suffix + h, n)]
        by = np.lexsort((next_rank, head[tied]))
        suffix, next_rank, old = suffix[by], next_rank[by], head[tied][by]
        order[tied] = suffix
        fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (next_rank[1:] != next_rank[:-1])])
        head[tied] = tied[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        rank[order[tied]] = head[tied]
        h *= 2
    return order, rank


def reaches(buf: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each sorted suffix has ``length`` bytes in common with the one before it, compared in text order."""
    n = len(buf)
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero((before < n) & (np.maximum(before, np.arange(n)) + length <= n))
    word = words_at(buf)
    for off in [*range(0, length - 7, 8), length - 8]:
        at = at[word[at + off] == word[before[at] + off]]
    out = np.zeros(n, bool)
    out[at] = True
    return out[order]


def classes(buf: np.ndarray, doc: np.ndarray, sub: np.ndarray, pos: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Valid window starts in the order of their class and then of (doc, sub, pos); whether each begins a class."""
    order, _ = suffix_array(buf)
    number = np.cumsum(~reaches(buf, order))
    keep = valid[order]
    start, number = order[keep], number[keep]
    by = np.lexsort((pos[start], sub[start], doc[start], number))
    start, number = start[by], number[by]
    return start, np.concatenate([[True], number[1:] != number[:-1]]) if len(start) else np.zeros(0, bool)


SHARD_ROW = "doc long, sub long, pos int, n int, ah long, part int, salt int, win binary"
SHARD_COLUMNS = ["doc", "sub", "pos", "n", "ah", "part", "salt", "win"]
SPAN = ("ah", "salt", "doc", "sub", "pos", "bytes")


def in_shards(found: DataFrame) -> DataFrame:
    """Of spans (SPAN): ranges to remove (win null), and the first windows of the classes of split groups."""

    def shard(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(r[5]) for r in rows], np.int64)
        begin = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        span = np.repeat(np.arange(len(rows)), size)
        off = np.arange(len(buf)) - begin[span]
        doc, sub, pos = (np.array([r[k] for r in rows], np.int64)[span] for k in (2, 3, 4))
        pos = pos + off
        start, head = classes(buf, doc, sub, pos, off <= size[span] - LENGTH)
        lead = start[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(start) else start
        gone = start[differs(start, lead, doc, sub, pos)]
        if len(gone):
            d, s, p, m = merge_ranges(doc[gone], sub[gone], pos[gone], np.ones(len(gone), np.int64))
            none = pa.nulls(len(d))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(p.astype(np.int32)), pa.array(m.astype(np.int32)), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], SHARD_COLUMNS)
        split = [s for s in start[head].tolist() if rows[span[s]][1] >= 0]
        if split:
            win = [buf[s : s + LENGTH].tobytes() for s in split]
            part = [zlib.crc32(w) % MERGE_PARTS for w in win]
            own = [rows[span[s]] for s in split]
            yield pa.RecordBatch.from_arrays([pa.array(doc[split]), pa.array(sub[split]), pa.array(pos[split].astype(np.int32)), pa.array(np.ones(len(split), np.int32)), pa.array([r[0] for r in own], pa.int64()), pa.array(part, pa.int32()), pa.array([r[1] for r in own], pa.int32()), pa.array(win, pa.binary())], SHARD_COLUMNS)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in it:
            for r in zip(*(batch[c].to_pylist() for c in SPAN)):
                if size > SHARD and r[:2] != rows[-1][:2]:
                    yield from shard(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
        if rows:
            yield from shard(rows)

    dealt = found.repartition("ah", "salt").sortWithinPartitions("ah", "salt")
    return arrow_map(dealt, batches, SHARD_ROW)


#: A place of a window, so that places compare as documents and positions do.
PLACE = np.dtype([("doc", np.int64), ("sub", np.int64), ("pos", np.int64)])


def merge_shards(firsts: DataFrame) -> DataFrame:
    """Ranges to remove among the shards' first windows: those that another shard has earlier."""

    def merge(lists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        known, place = lists[0]
        lost = [place[:0]]
        for win, own in lists[1:]:
            at = np.searchsorted(known, win)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == win)
            k = at[hit]
            a, b = own[hit], place[k]
            order = [np.sign(a[c].astype(object) - b[c].astype(object)).astype(np.int64) for c in PLACE.names]
            less = np.where(order[0] != 0, order[0], np.where(order[1] != 0, order[1], order[2]))
            lost.append(np.where(less < 0, b, a)[less != 0])
            place[k] = np.where(less < 0, a, b)
            new = np.ones(len(win), bool)
            new[hit] = False
            known, place = np.insert(known, at[new], win[new]), np.insert(place, at[new], own[new])
        return np.concatenate(lost)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lists: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            # a byte behind each window keeps numpy from dropping its zeros
            lost = merge([(np.array([r[0] + b"." for r in x], f"S{LENGTH + 1}"), np.array([r[1:] for r in x], PLACE)) for x in lists])
            if len(lost):
                yield pa.RecordBatch.from_arrays([pa.array(lost["doc"]), pa.array(lost["sub"]), pa.array(lost["pos"].astype(np.int32)), pa.array(np.ones(len(lost), np.int32))], ["doc", "sub", "pos", "n"])

        group, salt, lists = None, None, []
        for batch in it:
            for ah, part, s, *row in zip(*(batch[c].to_pylist() for c in ("ah", "part", "salt", "win", "doc", "sub", "pos"))):
                if (ah, part) != group:
                    if len(lists) > 1:
                        yield from out(lists)
                    group, salt, lists = (ah, part), None, []
                if s != salt:
                    salt = s
                    lists.append([])
                lists[-1].append(tuple(row))
        if len(lists) > 1:
            yield from out(lists)

    dealt = firsts.repartition("ah", "part").sortWithinPartitions("ah", "part", "salt", "win")
    return arrow_map(dealt, batches, "doc long, sub long, pos int, n int")


RANGE = ("doc", "sub", "pos", "n")


def removed_windows(docs: DataFrame) -> DataFrame:
    """RANGE: n windows from pos on of a document start later than an equal one; docs: (doc, sub, body)."""
    dealt = find_spans(docs).repartition("ah").sortWithinPartitions("ah", "sh", "doc", "sub", "pos")
    settled = materialize(settle(dealt), narrow=True)
    part = settled.where("kind = 2").groupBy(F.col("doc").alias("_doc"), F.col("sub").alias("_sub")).agg(F.collect_list(F.struct("ah", F.col("sh").cast("int").alias("salt"), "pos", "n")).alias("spans"))
    cut = lambda s: F.struct(s["ah"].alias("ah"), s["salt"].alias("salt"), s["pos"].alias("pos"), F.substring(F.col("body"), s["pos"] + 1, s["n"] + F.lit(LENGTH - 1)).alias("bytes"))
    found = docs.join(part, (F.col("doc") == F.col("_doc")) & (F.col("sub") == F.col("_sub"))).select("doc", "sub", F.explode(F.transform("spans", cut)).alias("s")).select("s.ah", "s.salt", "doc", "sub", "s.pos", "s.bytes")
    found = found.where(F.length("bytes") >= LENGTH)
    sharded = materialize(in_shards(found), narrow=True)
    merged = merge_shards(sharded.where("win IS NOT NULL"))
    return settled.where("kind = 1").select(*RANGE).unionByName(sharded.where("win IS NULL").select(*RANGE)).unionByName(merged)


def cut_out(size: int, pos: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) of a text of ``size`` bytes."""
    out: list[list[int]] = []
    by = np.argsort(pos)
    for a, b in zip(pos[by].tolist(), (pos + n - 1 + LENGTH)[by].tolist()):
        b = min(b, size)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept): the maximal removed runs as (start, end) and the bytes that stay."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(body(text_col)).alias("sub"), body(text_col).alias("body"))
    ranges = removed_windows(keyed).groupBy(F.col("doc").alias("_doc"), F.col("sub").alias("_sub")).agg(F.collect_list("pos").alias("pos"), F.collect_list("n").alias("n"))
    both = keyed.join(ranges, (F.col("doc") == F.col("_doc")) & (F.col("sub") == F.col("_sub")), "left").select("doc", "body", "pos", "n")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size, removed, kept = [], [], []
            for text, pos, n in zip(*(batch[c].to_pylist() for c in ("body", "pos", "n"))):
                runs = cut_out(len(text), np.array(pos, np.int64), np.array(n, np.int64)) if pos else []
                edges = [0, *(x for r in runs for x in r), len(text)]
                size.append(len(text))
                removed.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(size, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc", "n_bytes", "removed", "kept"])

    out = arrow_map(both, batches, "doc long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "removed", "kept")
