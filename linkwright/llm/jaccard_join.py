"""N-gram Jaccard join by chosen paths.

A document's set has the hashes of its runs of five words. In each run and at each node of its tree, a set
chooses those of its tokens whose node-seeded hash is below 1 / (LAMBDA * size), about 1 / LAMBDA of them,
and goes down to the nodes named by the path so far and the token. Similar sets choose the same tokens, so
they meet in the same nodes. A node with few sets is a bucket; the sets of a larger one are split on the
next tokens of their paths, DEPTH tokens at most: a group of near copies chooses the same tokens at any depth, so
splitting further would not end. Before a split, sets that one of LEADERS leaders of the node covers are tied to it and left out. Runs are repeated until a pair at the threshold is met with probability RECALL.

Documents with equal sets are one class from the start, so copies never meet each other. In a bucket, sets
are compared by sketches of their least hashes with leaders: a set that no leader covers becomes one, and
every set near a leader is tied to it; an edge to the first of those tied together is kept. By the triangle inequality of the Jaccard distance, two sets over
the threshold are then tied to a common leader, so the comparisons of a bucket of near copies grow with
its size and not with its square. The tied sets form candidate groups; in these, whole sets are compared
exactly in blocks of BLOCK sets and BLOCK_BYTES at most, tokens that occur once left out. Only sums and spanning
edges leave a block. Sketches that hide a link from all its leaders are a loss beside RECALL; tests measure both
together against all pairs.

Defined results: null and empty texts, and texts without words, have no links and are classes of their own;
texts of fewer than five words have one token, all their words; each row gives one row and counts for the
links of the others; a null doc_id is kept, and a class without any doc_id has a null class_id; of rows with equal doc_ids and different texts, each is a document; of
class ids the least doc_id is taken; very long texts are read whole, and their sets are bounded by BLOCK_BYTES in a block; an empty
table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.bytewords import Words, groups, mix
from linkwright.llm.common import body, materialize, release, without
from linkwright.llm.graph import components
from linkwright.shipping import arrow_map, slices

NGRAM, SIMILARITY = 5, 0.8
LAMBDA, DEPTH, RECALL = 0.8, 3, 0.999
#: Sets of a bucket that is not split further; sets of a block.
SMALL, BLOCK = 64, 1024
#: Bytes of the sets of a block, about.
BLOCK_BYTES = 16_000_000
#: Tokens, and sets, that are laid out against a block's sets at a time.
COLUMNS, ROWS = 1024, 256
#: Cells of a sketch; sketches at least COVER alike are covered, at least TIE alike are tied.
CELLS, COVER, TIE = 64, 0.6, 0.22
#: Leaders of a large node before it is split.
LEADERS = 4


def runs(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, whatever its sizes: fewest choices are shared where one set contains the other."""
    common = similarity / LAMBDA
    meet = 1.0
    for _ in range(DEPTH):
        meet = 1 - math.exp(-common * meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def token_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct token hashes of each text."""
    for some in groups(texts):
        w = Words(some)
        wh = w.hashes()
        first, h = w.windows(NGRAM, wh)
        at = np.searchsorted(w.doc[first], np.arange(w.n_docs + 1))
        word_at = np.searchsorted(w.doc, np.arange(w.n_docs + 1))
        for d in range(w.n_docs):
            a, b = at[d], at[d + 1]
            if a < b:
                yield np.unique(h[a:b])
            else:
                few = wh[word_at[d] : word_at[d + 1]]
                yield mix(np.array([hash_few(few)], np.uint64)) if len(few) else few


def hash_few(few: np.ndarray) -> int:
    out = len(few)
    for x in few.tolist():
        out = (out * 0xD1342543DE82EF95 + x) % 2**64
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


_CELL_STARTS = (np.arange(CELLS, dtype=np.uint64) << np.uint64(58)).astype(np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least token in each of CELLS equal ranges, 0 for none."""
    at = np.searchsorted(s, _CELL_STARTS)
    value = s[np.minimum(at, len(s) - 1)]
    inside = (at < len(s)) & ((value >> np.uint64(58)) == np.arange(CELLS, dtype=np.uint64))
    return np.where(inside, (value & np.uint64(0xFFFF)) | np.uint64(1), np.uint64(0)).astype(np.uint16)


def paths(s: np.ndarray, seeds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the hashes of its nodes, in the order of the nodes above, and how many each of these has (on the first level: how many there are)."""
    below = np.uint64(min(2**64 - 1, int(2**64 / (LAMBDA * len(s)))))
    chosen = np.argwhere(mix(s[None, :] ^ seeds[:, None]) < below)
    node = mix(mix(s[chosen[:, 1]]) + seeds[chosen[:, 0]])
    out = [(node, np.array([len(node)]))]
    for _ in range(1, DEPTH):
        chosen = np.argwhere(mix(s[None, :] ^ node[:, None]) < below)
        out.append((mix(mix(s[chosen[:, 1]]) + node[chosen[:, 0]]), np.bincount(chosen[:, 0], minlength=len(node))))
        node = out[-1][0]
    return out


#: Type of a tree: nodes with the nodes below them.
TREE = "array<struct<node:long>>"
for _ in range(1, DEPTH):
    TREE = f"array<struct<node:long,below:{TREE}>>"


def trees_of(found: list[list[tuple[np.ndarray, np.ndarray]]]) -> pa.Array:
    """The trees of ``paths`` as nested lists."""
    under: list[pa.Array] = []
    for level in range(DEPTH - 1, -1, -1):
        nodes = np.concatenate([np.empty(0, np.uint64), *(f[level][0] for f in found)]).view(np.int64)
        counts = np.concatenate([np.zeros(1, np.int64), *(f[level][1] for f in found)])
        here = pa.StructArray.from_arrays([pa.array(nodes), *under], ["node", "below"][: 1 + len(under)])
        under = [pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), here)]
    return under[0]


def sketches(docs: DataFrame, id_col: str, text_col: str, n_runs: int) -> DataFrame:
    """(doc_id, digest, size, sketch, tree) of every whole text."""
    seeds = mix(np.arange(1, n_runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_tree = [(np.empty(0, np.uint64), np.zeros(1 if k == 0 else 0, np.int64)) for k in range(DEPTH)]
        for batch in slices(it):
            digests, sizes, sk, trees = [], [], [], []
            for s in token_sets(batch["body"].to_pylist()):
                sizes.append(len(s))
                digests.append(digest(s) if len(s) else None)
                sk.append(sketch(s).tobytes() if len(s) else None)
                trees.append(paths(s, seeds) if len(s) else no_tree)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sk, pa.binary()), trees_of(trees)], ["doc_id", "digest", "size", "sketch", "tree"])

    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("body"))
    return arrow_map(rows, batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, size int, sketch binary, tree {TREE}")


def sized(members: DataFrame) -> DataFrame:
    """Members (node, digest, ...) of nodes with two sets or more, with the number of sets."""
    n = members.groupBy(F.col("node").alias("_node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(n, F.col("node") == F.col("_node")).drop("_node")


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of sketches, cells on the last axis."""
    full = x != 0
    return ((x == y) & full).sum(-1) / np.maximum((full | (y != 0)).sum(-1), 1)


def led(large: DataFrame, sketched: DataFrame) -> DataFrame:
    """Members of large nodes against LEADERS of each node: adds covered, and to, the leaders that it is tied to (one of each chain of them).

    Each member gives one row, however large its node is.
    """
    rows = materialize(large.join(sketched.select(F.col("digest").alias("_d"), "sketch"), F.col("digest") == F.col("_d")).drop("_d"))
    some = [F.min_by(F.concat("digest", "sketch"), F.xxhash64("digest", "node", F.lit(k))) for k in range(LEADERS)]
    # written, so that the rows of one node can be split in the join
    leaders = materialize(rows.groupBy(F.col("node").alias("_node")).agg(F.concat(*some).alias("leaders")), narrow=True)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.dtype([("digest", "V16"), ("sketch", np.uint16, CELLS)])
        for batch in slices(it):
            own = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(-1, 1, CELLS)
            lead = np.frombuffer(b"".join(batch["leaders"].to_pylist()), wide).reshape(-1, LEADERS)
            near = alike(own, lead["sketch"])
            chained = alike(lead["sketch"][:, :, None], lead["sketch"][:, None]) >= TIE
            for _ in range(LEADERS.bit_length()):
                chained = chained @ chained
            first = chained.argmax(2)
            to = []
            for digest_, row, at, names in zip(batch["digest"].to_pylist(), near >= TIE, first, lead["digest"]):
                to.append([x for x in {names[k].tobytes() for k in at[row]} if x != digest_])
            covered = pa.array((near >= COVER).any(1))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("node", "digest", "below")), covered, pa.array(to, pa.list_(pa.binary()))], ["node", "digest", "below", "covered", "to"])

    rows = rows.join(leaders, F.col("node") == F.col("_node")).select("node", "digest", "below", "sketch", "leaders")
    return materialize(arrow_map(rows, batches, f"node long, digest binary, below {rows.schema['below'].dataType.simpleString()}, covered boolean, to array<binary>"))


def buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, digest, n): nodes with SMALL sets at most, and those of the last level with any number; and edges (a, b) of large nodes to their leaders.

    Of a large node the sets that a leader covers stay where they are: whatever they may be linked with there is tied to that
    leader too. So near copies, which no depth parts, mostly end where they first meet; only the other sets go down, and only from large nodes.
    """
    members, edges = [], []
    level = classes.select("digest", F.explode("tree").alias("t")).select("digest", "t.node", "t.below")
    for depth in range(1, DEPTH):
        level = materialize(sized(level))
        held = led(level.where(F.col("n") > SMALL).drop("n"), classes)
        rest = materialize(sized(held.where("NOT covered").drop("covered", "to")))
        members += [x.where(F.col("n") <= SMALL).select("node", "digest", "n") for x in (level, rest)]
        edges.append(held.select(F.col("digest").alias("a"), F.explode("to").alias("b")))
        down = rest.where(F.col("n") > SMALL).select("digest", F.explode("below").alias("t"))
        level = down.select("digest", "t.node", *(["t.below"] if depth + 1 < DEPTH else []))
    members.append(sized(level).select("node", "digest", "n"))
    return reduce(DataFrame.unionByName, members), reduce(DataFrame.unionByName, edges)


def in_blocks(members: DataFrame, key: str, n: str, n_bytes: Column | None = None) -> DataFrame:
    """Deal groups out in pairs of blocks of about BLOCK members and BLOCK_BYTES at most: adds own, i and j (i <= j)."""
    blocks = F.ceil(F.col(n) / BLOCK)
    blocks = (blocks if n_bytes is None else F.greatest(blocks, F.ceil(n_bytes / BLOCK_BYTES))).cast("int")
    own = F.pmod(F.hash("digest"), blocks)
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = members.withColumn("own", own).withColumn("_other", other)
    return dealt.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_other")


def by_group(it: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of consecutive rows that agree in the first columns."""
    key, rows = None, []
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def tied(sk: np.ndarray) -> np.ndarray:
    """For each sketch the first one that chains of ties to common leaders connect it with."""
    root, covered, full = np.arange(len(sk)), np.zeros(len(sk), bool), sk != 0
    for i in range(len(sk)):
        if covered[i]:
            continue
        alike = ((sk == sk[i]) & full[i]).sum(1) / np.maximum((full | full[i]).sum(1), 1)
        covered |= alike >= COVER
        covered[i] = True
        near = np.unique(root[(alike >= TIE) | (np.arange(len(sk)) == i)])
        if len(near) > 1:
            root[np.isin(root, near)] = near[0]
    return root


def ties(members: DataFrame) -> DataFrame:
    """Candidate edges (a, b) between digests that share a bucket and look alike; members: (node, digest, n, sketch)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in by_group(it, 3):
            if len(rows) > 1:
                sk = np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(-1, CELLS)
                for k, first in enumerate(tied(sk).tolist()):
                    if k != first:
                        a.append(rows[k][0])
                        b.append(rows[first][0])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    dealt = in_blocks(members, "node", "n").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").select("node", "i", "j", "digest", "sketch")
    return arrow_map(dealt, batches, "a binary, b binary").distinct()


def exact_links(sets: list[np.ndarray], own: np.ndarray, i: int, j: int, weight: np.ndarray, similarity: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Summed weights of each set's partners over the threshold, and edges that span them. Across blocks, only pairs across count."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    token, col = np.unique(flat, return_inverse=True)
    live = np.ones(len(sets), bool)
    for _ in range(20):  # a set with a partner has enough tokens that others have too
        on = live[row]
        df = np.bincount(col[on], minlength=len(token))
        shared = np.bincount(row[on], weights=(df[col[on]] > 1), minlength=len(sets))
        fewer = live & (shared >= similarity * size - 1e-9)
        if (fewer == live).all():
            break
        live = fewer
    links, edges = np.zeros(len(sets), np.int64), []
    members = np.flatnonzero(live)
    if len(members) < 2:
        return links, edges
    on = live[row] & (df[col] > 1)
    used, c = np.unique(col[on], return_inverse=True)
    r = np.searchsorted(members, row[on])
    both = np.zeros((len(members), len(members)), np.float32)
    order = np.argsort(c, kind="stable")
    c, r = c[order], r[order]
    for lo in range(0, len(used), COLUMNS):
        a, b = np.searchsorted(c, [lo, lo + COLUMNS])
        part = np.zeros((len(members), min(COLUMNS, len(used) - lo)), np.float32)
        part[r[a:b], c[a:b] - lo] = 1
        both += part @ part.T
    n = size[members]
    near = np.empty(both.shape, bool)
    for lo in range(0, len(members), ROWS):
        inter = np.rint(both[lo : lo + ROWS]).astype(np.int64)
        near[lo : lo + ROWS] = inter * (1 + similarity) >= similarity * (n[lo : lo + ROWS, None] + n[None, :]) - 1e-9
    del both
    np.fill_diagonal(near, False)
    if i != j:
        near &= own[members][:, None] != own[members][None, :]
    links[members] = near @ weight[members]
    seen = np.zeros(len(members), bool)
    for start in range(len(members)):  # a spanning tree of each component
        stack = [] if seen[start] else [start]
        seen[start] = True
        while stack:
            k = stack.pop()
            for x in np.flatnonzero(near[k] & ~seen).tolist():
                seen[x] = True
                edges.append((int(members[k]), int(members[x])))
                stack.append(x)
    return links, edges


def verify(docs: DataFrame, candidates: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(digest, links, to): partial sums of links, or an edge to another digest; candidates: (rep, digest, n_docs, root, n, n_tokens)."""
    texts = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("body"))
    found = texts.join(candidates, F.col("_id").eqNullSafe(F.col("rep"))).select("root", "n", "n_tokens", "digest", "n_docs", "body")

    def to_sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            keep, sets = [], []
            for k, (s, d) in enumerate(zip(token_sets(batch["body"].to_pylist()), batch["digest"].to_pylist())):
                if len(s) and digest(s) == d:
                    keep.append(k)
                    sets.append(s.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in ("root", "n", "n_tokens", "digest", "n_docs")), pa.array(sets, pa.binary())], ["root", "n", "n_tokens", "digest", "n_docs", "tokens"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in by_group(it, 3):
            rows = list({r[1]: r for r in rows}.values())  # repeated rows of one document
            out = [], [], []
            if len(rows) > 1:
                sets = [np.frombuffer(r[3], np.uint64) for r in rows]
                links, edges = exact_links(sets, np.array([r[0] for r in rows]), i, j, np.array([r[2] for r in rows]), similarity)
                for k in np.flatnonzero(links).tolist():
                    for column, value in zip(out, (rows[k][1], int(links[k]), None)):
                        column.append(value)
                for a, b in edges:
                    for column, value in zip(out, (rows[a][1], 0, rows[b][1])):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["digest", "links", "to"])

    sets = arrow_map(found, to_sets, "root binary, n long, n_tokens long, digest binary, n_docs long, tokens binary")
    dealt = in_blocks(sets, "root", "n", 8 * F.col("n_tokens")).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").select("root", "i", "j", "own", "digest", "n_docs", "tokens")
    return materialize(arrow_map(dealt, compare, "digest binary, links long, to binary"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its group), class_size, n_links, n_tokens.

    A group holds all documents that chains of links connect; a document's links are the other documents
    whose similarity to it reaches the threshold, copies included.
    """
    sketched = materialize(sketches(docs, id_col, text_col, runs(similarity, recall)))
    trees = sketched.where("size > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.max("size").cast("long").alias("size"), F.first("sketch").alias("sketch"), F.first("tree").alias("tree"))
    trees = materialize(trees)
    # trees are wide: what is read again later is written without them
    rows, classes = materialize(sketched.select("doc_id", "digest", "size"), narrow=True), materialize(trees.select("digest", "rep", "n_docs", "size"), narrow=True)
    release(sketched)
    full = rows.where("size > 0")
    members, edges = buckets(trees.select("digest", "tree", "sketch"))
    members = members.join(trees.select(F.col("digest").alias("_d"), "sketch"), F.col("digest") == F.col("_d")).drop("_d")
    roots = materialize(components(ties(members).unionByName(edges)), narrow=True)
    release(trees)
    rooted = materialize(roots.join(classes, F.col("node") == F.col("digest")).drop("node"), narrow=True)
    sizes = materialize(rooted.groupBy(F.col("root").alias("_root")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_tokens")), narrow=True)
    candidates = rooted.join(sizes, F.col("root") == F.col("_root")).select("rep", "digest", "n_docs", "root", "n", "n_tokens")
    found = verify(docs, candidates, id_col, text_col, similarity)
    links = found.groupBy(F.col("digest").alias("_d")).agg(F.sum("links").alias("links"))
    groups_ = components(found.where("to IS NOT NULL").select(F.col("digest").alias("a"), F.col("to").alias("b")))
    named = classes.select("digest", "rep", "n_docs").join(links, F.col("digest") == F.col("_d"), "left").drop("_d")
    named = named.join(groups_, F.col("digest") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "digest"))
    named = materialize(named, narrow=True)
    of_group = named.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("class_id"), F.sum("n_docs").alias("class_size"))
    named = materialize(named.join(of_group, F.col("root") == F.col("_root")).select(F.col("digest").alias("_d"), "class_id", "class_size", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), narrow=True)
    out = full.select("doc_id", "digest", "size").join(named, F.col("digest") == F.col("_d")).select("doc_id", "class_id", "class_size", "n_links", F.col("size").alias("n_tokens"))
    alone = rows.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.col("size").alias("n_tokens"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document with the least doc_id, and with the least text of that one.

    Of rows that share a doc_id each stays or goes by its own text; rows that repeat one document stay or go together.
    """
    # a document is named by its id and a hash of its text; nulls come first in a struct
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(body(text_col)).alias("hash"))
    named = docs.select(key.alias("_key"), F.col(text_col).alias("_text"))
    gone = jaccard_classes(named, "_key", "_text").where(F.col("class_id") != F.col("doc_id")).select("doc_id.id", "doc_id.hash")
    return without(docs, gone, F.col(id_col), F.xxhash64(body(text_col)))
