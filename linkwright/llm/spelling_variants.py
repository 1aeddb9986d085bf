"""Spelling variant grouping by a bit-sliced position index.

The vocabulary's words stand in a bit index: for each position and letter, a bitset says which words have that
letter there. A word is looked up in all words of its block at once, 64 for each machine word. Reading it letter
by letter moves three sets on: the words without an error so far, those with one letter replaced, and those with
one letter more, which are read one position further on. What is left in the last two sets are the near words.

Two words of which one differs from the other by one letter share their first or their last half. So a block
is what words of one length share: the half at one end. Each word is dealt to its blocks as an entry and as a
query, and to the blocks of words that are one letter longer as a query; a block with very many words is cut into
cells, each with some of its entries and some of its queries. Cells give one row for each word with the
number of its near words and the best of them, not the pairs.

Defined results: null texts have no words, and a null doc_id reads as the empty text in what is hashed; equal rows
count as often as they stand there; of near words that tie in their counts the first in code-point order is
taken; words may be as long as a text; a table without words gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import materialize
from linkwright.shipping import arrow_map

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[a-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, DAMAGED, FORM_TIMES = 7, 2, 31, 10
#: Entries and queries of a cell, about; blocks with more are cut.
CELL_WORDS = 8192
#: Rows that a task looks up together, and pairs of a query and a machine word among them at a time.
LOAD_ROWS, LOAD_PAIRS = 32_768, 1 << 20


# ---- vocabulary ----


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damaged: int | None = DAMAGED) -> DataFrame:
    """(word, n) of runs of letters, A to Z in small letters. Of one run in ``damaged``, by hash, a letter is deleted; None deletes none."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    # deletion only shortens, so shorter runs are none of the words
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(low, F.lit(f"({LETTERS}{{{min_length},}})"), F.lit(1))).alias("word"))
    if damaged is not None:
        h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.select(F.when(h % damaged == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# ---- blocks and cells ----


def dealt(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(block, part, chunk, side, size, entry, asks, word, n): what each cell holds. ``size`` is the length of the cell's entries."""
    w, own = F.col("word"), F.length("word")
    half = lambda size: F.floor(size / 2).cast("int")
    at = lambda side, size, entry: F.struct(
        F.lit(side).alias("side"), size.cast("int").alias("size"), F.lit(entry).alias("entry"), (F.substring(w, F.lit(1), half(size)) if side == 0 else F.right(w, half(size))).alias("end")
    )
    places = F.array(at(0, own, True), at(1, own, True), at(0, own + 1, False), at(1, own + 1, False))
    rows = words.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.side", "p.size", "p.entry", F.xxhash64("p.side", "p.size", "p.end").alias("block"))
    full = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_asks"), F.count(F.when(F.col("entry"), 1)).alias("_entries")).where(F.col("_asks") > cell_words)
    full = full.select(F.col("block").alias("_block"), F.ceil(F.col("_asks") / cell_words).cast("int").alias("_chunks"), F.greatest(F.ceil(F.col("_entries") / cell_words), F.lit(1)).cast("int").alias("_parts"))
    rows = rows.join(full, F.col("block") == F.col("_block"), "left")
    chunk, part = F.pmod(F.xxhash64("word"), F.col("_chunks")).cast("int"), F.pmod(F.xxhash64(F.lit("part"), "word"), F.col("_parts")).cast("int")
    cell = lambda p, c, entry, asks: F.struct(p.cast("int").alias("part"), c.cast("int").alias("chunk"), entry.alias("entry"), asks.alias("asks"))
    no, yes = F.lit(False), F.lit(True)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asking = F.transform(upto("_parts"), lambda p: cell(p, chunk, no, yes))
    stored = F.when(F.col("entry"), F.transform(upto("_chunks"), lambda c: cell(part, c, yes, no))).otherwise(F.array().cast("array<struct<part:int,chunk:int,entry:boolean,asks:boolean>>"))
    cells = F.when(F.col("_block").isNull(), F.array(cell(F.lit(0), F.lit(0), F.col("entry"), yes))).otherwise(F.concat(stored, asking))
    return rows.select("block", "side", "size", "word", "n", F.explode(cells).alias("c")).select("block", "c.part", "c.chunk", "side", "size", "c.entry", "c.asks", "word", "n")


# ---- the bit index ----


def letter_rows(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def near_in_cells(cell: np.ndarray, entry: np.ndarray, asks: np.ndarray, words: list[str], size: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (asking, found) of near words; rows are sorted by cell, entries have ``size`` letters, queries that many or one less."""
    own = np.array([len(w) for w in words])
    text = letter_rows(words, size)
    alphabet, text = np.unique(text, return_inverse=True)
    text = text.reshape(len(words), size)
    n_letters, shared = len(alphabet), size // 2
    e, q = np.flatnonzero(entry), np.flatnonzero(asks)
    if not len(e) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # bits of entries: each cell begins with a machine word of its own
    n_cells = int(cell[-1]) + 1
    held = np.bincount(cell[e], minlength=n_cells)
    spans = -(-held // 64)
    first = np.concatenate([[0], np.cumsum(spans)])
    rank = np.arange(len(e)) - np.concatenate([[0], np.cumsum(held)])[cell[e]]
    word_at, bit = first[cell[e]] + rank // 64, np.left_shift(np.uint64(1), (rank % 64).astype(np.uint64))
    row_of = np.full(first[-1] * 64, -1, np.int64)
    row_of[word_at * 64 + rank % 64] = e
    taken = np.zeros(first[-1], np.uint64)
    np.add.at(taken, word_at, bit)

    def slice_at(p: int) -> np.ndarray:
        """The bitsets of position p: a row for each machine word, a column for each letter."""
        out = np.zeros(first[-1] * n_letters, np.uint64)
        np.add.at(out, word_at * n_letters + text[e, p], bit)  # bits of one set differ, so their sum is their union
        return out

    slices = [slice_at(p) for p in range(size)] if first[-1] * n_letters * size <= 4_000_000 else None
    found_q, found_e = [], []
    each = spans[cell[q]]
    stops = np.cumsum(each)
    for lo, hi in _runs(stops, LOAD_PAIRS):
        some = q[lo:hi]
        times = each[lo:hi]
        at = np.repeat(some, times)
        where = np.repeat(first[cell[some]], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        equal = own[at] == size
        # what all words of a block share at the front needs no reading
        start = shared if side == 0 else 0
        none, replaced, longer = taken[where], np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        now = slices[start] if slices else slice_at(start)
        for i in range(start, size):
            after = None if i + 1 == size else slices[i + 1] if slices else slice_at(i + 1)
            key = where * n_letters + text[at, i]
            here = now[key]
            reading = i < own[at]  # the shorter queries are over before the last position
            if after is not None:
                longer = np.where(reading & ~equal, (longer | none) & after[key], longer)
            replaced = np.where(equal, (replaced & here) | (none & ~here), replaced)
            none = np.where(reading, none & here, none)
            alive = (none | replaced | longer) != 0
            if 2 * np.count_nonzero(alive) < len(alive):
                at, where, equal, none, replaced, longer = at[alive], where[alive], equal[alive], none[alive], replaced[alive], longer[alive]
            now = after
        ends = np.where(equal, replaced, longer | none)
        hit = np.flatnonzero(ends)
        bits = np.unpackbits(ends[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, b = np.nonzero(bits)
        found_q.append(at[hit][k])
        found_e.append(row_of[where[hit][k] * 64 + b])
    a, b = np.concatenate(found_q), np.concatenate(found_e)
    if side == 1:  # pairs that share their first halves too are found there
        apart = (text[a, :shared] != text[b, :shared]).any(1)
        a, b = a[apart], b[apart]
    return a, b


def _runs(stops: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    lo, done = 0, 0
    while lo < len(stops):
        hi = max(lo + 1, int(np.searchsorted(stops, done + most, "right")))
        yield lo, hi
        lo, done = hi, stops[hi - 1]


def best_of_cells(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(word, n_near, near_n, near) of a batch of whole cells: the number of near words and the best of them."""
    words, n = np.array(rows["word"].to_pylist(), object), rows["n"].to_numpy()
    size, side, entry, asks = (rows[c].to_numpy(zero_copy_only=False) for c in ("size", "side", "entry", "asks"))
    cell = _cells(rows)
    got_a, got_b = [], []
    for key in np.unique(size.astype(np.int64) * 2 + side):
        at = np.flatnonzero((size == key // 2) & (side == key % 2))
        _, own = np.unique(cell[at], return_inverse=True)
        a, b = near_in_cells(own, entry[at], asks[at], words[at].tolist(), int(key // 2), int(key % 2))
        a, b = at[a], at[b]
        longer = np.array([len(x) > len(y) for x, y in zip(words[b], words[a])], bool)
        got_a += [a, b[longer]]  # equally long words ask each other; the longer one of a pair never asks
        got_b += [b, a[longer]]
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (got_a, got_b))
    met, rank = np.unique(words[np.concatenate([a, b])], return_inverse=True) if len(a) else (np.zeros(0, object), np.zeros(0, np.int64))
    target, near = rank[: len(a)], rank[len(a) :]
    order = np.lexsort((near, -n[b], target))
    target, near, near_n = target[order], near[order], n[b][order]
    starts = np.flatnonzero(np.diff(target, prepend=-1))
    counts = np.diff(np.append(starts, len(target)))
    columns = [pa.array(met[target[starts]], pa.string()), pa.array(counts, pa.int64()), pa.array(near_n[starts], pa.int64()), pa.array(met[near[starts]], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "near_n", "near"])


def _cells(rows: pa.RecordBatch) -> np.ndarray:
    """The number of each row's cell; rows of a cell stand together."""
    keys = np.stack([rows[c].to_numpy() for c in ("block", "part", "chunk")])
    return np.cumsum(np.any(np.diff(keys, axis=1, prepend=keys[:, :1]), axis=0)) if len(rows) else np.zeros(0, np.int64)


def whole_cells(it: Iterator[pa.RecordBatch], rows: int = LOAD_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows or more that end where a cell does, from rows sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            starts = np.flatnonzero(np.diff(_cells(whole), prepend=0))
            if len(starts):
                yield whole.slice(0, int(starts[-1]))
                whole = whole.slice(int(starts[-1]))
            held = [whole]
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n, n_near, near_n, near) of each (word, n): the number of words one letter away, and the one of largest n."""
    cells = dealt(words, cell_words).repartition("block", "part", "chunk").sortWithinPartitions("block", "part", "chunk")
    found = arrow_map(cells, lambda it: map(best_of_cells, whole_cells(it)), "word string, n_near bigint, near_n bigint, near string")
    every = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("near_n"), F.lit(None).cast("string").alias("near"))
    both = every.unionByName(found, allowMissingColumns=True)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


# ---- forms and roots ----


def variant_groups(words: DataFrame, times: int = FORM_TIMES, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each (word, n)."""
    words = materialize(words)
    usual: Column = F.col("near_n") >= times * F.col("n")
    known = near_words(words, cell_words).select("word", "n", "n_near", F.when(usual, F.col("near")).alias("form"), F.when(usual, F.col("near_n")).alias("form_n"))
    known = materialize(known)
    most = words.agg(F.max("n")).first()[0] or 1
    roots = known.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # counts grow ``times``-fold along a path, so its length is bounded; each round doubles what is followed
    for _ in range(ceil(log2(max(1.0, log10(most) / log10(times))))):
        ahead = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        roots = materialize(roots.join(ahead, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root")))
    ends = roots.select(F.col("word").alias("_word"), "root")
    return known.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
