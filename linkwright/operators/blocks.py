"""Pairs of lists of texts that are alike, of all lists that some block brings together.

Blocks are dealt out whole, so that no pair is a row before it has passed: a task reads the lists of its blocks, holds
texts against each other by bounds on lengths, letters and words, and compares the few that are left. A block with
very many lists is cut: one side's lists into parts, the other's into chunks, and each part meets each chunk in a
cell of its own; the lists, not the pairs, are repeated for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.functions import pairs as P
from linkwright.shipping import arrow_map

#: Lists of a side in a cell, about.
CELL_LISTS = 4096
#: Rows that a task takes together, and pairs of texts that it holds bounds against at a time.
LOAD_ROWS, LOAD_PAIRS = 32_768, 1 << 21


def dealt(left: DataFrame, right: DataFrame, cell_lists: int = CELL_LISTS) -> DataFrame:
    """(block, part, chunk, side, id, texts) of left and right (block, id, texts): the rows of cells."""
    rows = left.select("block", F.lit(0).alias("side"), "id", "texts").unionByName(right.select("block", F.lit(1).alias("side"), "id", "texts"))
    n = lambda side: F.count(F.when(F.col("side") == side, 1))
    # lists of blocks that only one side has meet nothing
    held = rows.groupBy(F.col("block").alias("_block")).agg(n(0).alias("_l"), n(1).alias("_r")).where((F.col("_l") > 0) & (F.col("_r") > 0))
    held = held.select("_block", *(F.ceil(F.col(c) / cell_lists).cast("int").alias(name) for c, name in (("_l", "_parts"), ("_r", "_chunks"))))
    rows = rows.join(held, F.col("block") == F.col("_block"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda p, c: F.struct(p.alias("part"), c.alias("chunk"))
    cells = F.when(F.col("side") == 0, F.transform(every("_chunks"), lambda c: cell(own("_parts"), c))).otherwise(F.transform(every("_parts"), lambda p: cell(p, own("_chunks"))))
    return rows.select("block", "side", "id", "texts", F.explode(cells).alias("c")).select("block", "c.part", "c.chunk", "side", "id", "texts")


def whole_cells(it: Iterator[pa.RecordBatch], rows: int = LOAD_ROWS) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows or more that end where a cell does, from rows sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            starts = np.flatnonzero(np.diff(cells_of(whole), prepend=0))
            if len(starts):
                yield whole.slice(0, int(starts[-1]))
                whole = whole.slice(int(starts[-1]))
            held = whole.to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _number(column: pa.ChunkedArray) -> np.ndarray:
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.dictionary_encode(one).indices.to_numpy(zero_copy_only=False)


def cells_of(rows: pa.Table) -> np.ndarray:
    keys = np.stack([_number(rows["block"]), rows["part"].to_numpy(), rows["chunk"].to_numpy()])
    return np.cumsum(np.any(np.diff(keys, axis=1, prepend=keys[:, :1]), axis=0)) if len(rows) else np.zeros(0, np.int64)


def non_siblings(t: P.Texts, text: np.ndarray, start: np.ndarray, texts: list[str]) -> np.ndarray:
    """Which texts of lists are more than the next one of their list without its spaces."""
    last = np.zeros(len(text), bool)
    last[start[1:][np.diff(start) > 0] - 1] = True
    squeezed = {w: k for k, w in enumerate(texts)}
    # the place of each text without its spaces, -1 where that is none of the texts
    of = np.array([squeezed.get(w.replace(" ", ""), -1) if w.replace(" ", "") else -1 for w in texts], np.int64)
    after = np.append(text[1:], 0) if len(text) else text
    return t.spaced[text] | last | (of[after] != text)


def alike_lists(cell: np.ndarray, side: np.ndarray, lists: pa.ListArray, threshold: float, siblings: bool) -> tuple[int, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """How many distinct pairs of texts were compared, and the rows (left, right) of one cell whose lists match, some at a time."""
    values = lists.flatten()
    coded = pc.dictionary_encode(values)
    texts = coded.dictionary.to_pylist()
    t, text = P.Texts(texts), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(start))
    whole = non_siblings(t, text, start, texts) if siblings else np.ones(len(text), bool)
    kind = 2 * text + whole  # a text counts as another where only whole words may match it
    kinds = 2 * len(texts)
    sides = []
    for s in (0, 1):
        own = side[row] == s
        keys, where = np.unique(cell[row[own]] * kinds + kind[own], return_inverse=True)
        order = np.argsort(where, kind="stable")
        sides.append((keys, row[own][order], np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(keys)))])))
    lk, rk = sides[0][0], sides[1][0]
    # each left text with all right texts of its cell
    low, high = np.searchsorted(rk, lk // kinds * kinds), np.searchsorted(rk, (lk // kinds + 1) * kinds)
    n, stops = high - low, np.cumsum(high - low)
    got = []
    for lo, hi in _runs(stops, LOAD_PAIRS):
        left = np.repeat(np.arange(lo, hi), n[lo:hi])
        right = np.arange(len(left)) + np.repeat(low[lo:hi] - (stops[lo:hi] - n[lo:hi] - (stops[lo] - n[lo])), n[lo:hi])
        open_ = P.may_match(t, lk[left] % kinds // 2, rk[right] % kinds // 2, threshold)
        got.append((left[open_], right[open_]))
    left, right = (np.concatenate([*(g[k] for g in got), np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
    a, b = lk[left] % kinds, rk[right] % kinds
    codes, which = np.unique(a // 2 * len(texts) + b // 2, return_inverse=True)
    x, y = codes // max(1, len(texts)), codes % max(1, len(texts))
    sure, near, compared = P.alike(t, x, y, threshold)
    hit = sure[which] | near[which] & (a % 2 == 1) & (b % 2 == 1)
    left, right = left[hit], right[hit]
    return compared, _lists_of(left, right, sides, len(lists))


def _lists_of(left: np.ndarray, right: np.ndarray, sides: list[tuple], n_lists: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The lists of each left text with the lists of the right one: each pair once, some left lists at a time."""
    (_, l_rows, l_start), (_, r_rows, r_start) = sides
    nl = l_start[left + 1] - l_start[left]
    hit = np.repeat(np.arange(len(left)), nl)
    row = l_rows[l_start[left[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(nl) - nl, nl)]
    order = np.argsort(row, kind="stable")
    row, hit = row[order], hit[order]
    nr = r_start[right[hit] + 1] - r_start[right[hit]]
    ends = np.flatnonzero(np.diff(row, append=-1))  # where a left list's texts end
    for lo, hi in _runs(np.cumsum(nr)[ends], LOAD_PAIRS):
        some = slice(ends[lo - 1] + 1 if lo else 0, ends[hi - 1] + 1)
        n = nr[some]
        other = r_rows[np.repeat(r_start[right[hit[some]]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        found = np.unique(np.repeat(row[some], n) * n_lists + other)
        yield found // n_lists, found % n_lists


def _runs(stops: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items that come to ``most`` together, or are one item; ``stops`` are running sums."""
    lo, done = 0, 0
    while lo < len(stops):
        hi = max(lo + 1, int(np.searchsorted(stops, done + most, "right")))
        yield lo, hi
        lo, done = hi, int(stops[hi - 1])


def alike_in_blocks(left: DataFrame, right: DataFrame, threshold: float, siblings: bool = False, cell_lists: int = CELL_LISTS) -> DataFrame:
    """(block, left, right): ids of left and right (block, id, texts) of one block, of which some texts match.

    Texts match if they are equal, if the shorter stands in the longer on word boundaries, or by words and letters;
    with ``siblings``, a text that is the next one of its list without its spaces isn't compared by letters. Each
    (block, id) comes once; null texts must be none.
    """
    cells = dealt(left, right, cell_lists).repartition("block", "part", "chunk").sortWithinPartitions("block", "part", "chunk")
    kinds = {c: left.schema[c].dataType.simpleString() for c in ("block", "id")}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(it):
            lists = rows["texts"].combine_chunks()
            ids, blocks = rows["id"].combine_chunks(), rows["block"].combine_chunks()
            for a, b in alike_lists(cells_of(rows), rows["side"].to_numpy(), lists, threshold, siblings)[1]:
                yield pa.RecordBatch.from_arrays([blocks.take(pa.array(a)), ids.take(pa.array(a)), ids.take(pa.array(b))], ["block", "left", "right"])

    return arrow_map(cells, batches, f"block {kinds['block']}, left {kinds['id']}, right {kinds['id']}")
