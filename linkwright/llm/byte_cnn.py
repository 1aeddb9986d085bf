"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes run over every position of a document. Positions form half chunks of HALF; two
neighbouring halves are a chunk, so chunks overlap by half and cover the whole document. Each filter's
activations are max-pooled in a chunk; the chunks' features are combined by their maximum and their mean,
and a small hidden layer turns them into one probability. The activation is a rectifier; training is Adam
on the log loss with hand-written gradients. A maximum passes its gradient on to one position: where a
document's maximum is reached in several chunks, to the first of them, and in a chunk to its first half.

The network is fitted on a bounded sample of labelled rows (``max_fit`` of each label, in an order given by a
hash of doc_id, as far as MAX_FIT_BYTES hold them whole; of a label none of whose texts fits, the shortest); texts of
any length are scored whole.

Defined results: null text counts as empty and is scored like any other; each row gives one row; labels
that are null, of null doc_ids or of unknown documents are not used, and of several labels of a doc_id the
largest is; a labelled doc_id that several rows have counts once, with its least text; without labels of both
kinds each score is one half; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.shipping import arrow_map

from linkwright.llm.bytewords import groups
from linkwright.llm.common import body, materialize

WIDTH, FILTERS, HIDDEN, HALF = 6, 16, 16, 512
#: Rows of each label, and bytes of text, that the network is fitted on.
MAX_FIT, MAX_FIT_BYTES = 1000, 8_000_000
#: Bytes of a training batch, unless one text has more.
BATCH_BYTES = 1 << 19
#: Positions that are scored at a time.
BLOCK = 1 << 18

Weights = dict[str, np.ndarray]


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each with zeros behind; where the halves start and stop; each text's first half.

    A text of n bytes has n + 1 positions, none of which sees the next text.
    """
    pad = b"\0" * WIDTH
    buf = np.frombuffer(b"".join([*(x for t in texts for x in (t, pad)), b"\0\0"]), np.uint8)
    n = np.array([len(t) + 1 for t in texts])
    begin = np.concatenate([[0], np.cumsum(n - 1 + WIDTH)])[:-1]
    n_half = -(-n // HALF)
    first = np.concatenate([[0], np.cumsum(n_half)])
    starts = np.repeat(begin, n_half) + HALF * (np.arange(first[-1]) - np.repeat(first[:-1], n_half))
    return buf, starts, np.minimum(starts + HALF, np.repeat(begin + n, n_half)), first


def pooled(act: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Maximum of the rows from each start to its stop; a row must follow the last stop."""
    return np.maximum.reduceat(act, np.stack([starts, stops], axis=1).ravel())[::2]


def followers(first: np.ndarray) -> np.ndarray:
    """The half that follows each one in its document; the last one itself."""
    return np.minimum(np.arange(first[-1]) + 1, np.repeat(first[1:], np.diff(first)) - 1)


def combine(top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document features and chunk maxima, from the halves' maxima."""
    chunk = np.maximum(top, top[followers(first)])
    size = np.diff(first)[:, None].astype(np.float32)
    return np.concatenate([np.maximum.reduceat(chunk, first[:-1]), np.add.reduceat(chunk, first[:-1]) / size], axis=1), chunk


class Network:
    def __init__(self, w: Weights) -> None:
        self.w = w
        pair = lambda k: (w["conv"][k][None, :, :] + w["conv"][k + 1][:, None, :]).reshape(65536, FILTERS)  # noqa: E731  index: low byte first
        self.tables = [pair(k).astype(np.float32) for k in range(0, WIDTH, 2)]

    def pool(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each half's positions, in blocks of bounded size."""
        duo = buf[:-1].astype(np.uint16) | (buf[1:].astype(np.uint16) << np.uint16(8))
        top = np.empty((len(starts), FILTERS), np.float32)
        step = BLOCK // HALF
        for a in range(0, len(starts), step):
            own, until = starts[a : a + step], stops[a : a + step]
            lo, hi = own[0], until[-1] + 1
            act = self.tables[0][duo[lo:hi]]
            for k, t in enumerate(self.tables[1:], 1):
                act += t[duo[lo + 2 * k : hi + 2 * k]]
            act += self.w["bias"]
            top[a : a + step] = np.maximum(pooled(act, own - lo, until - lo), 0)
        return top

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        buf, starts, stops, first = layout(texts)
        feats, _ = combine(self.pool(buf, starts, stops), first)
        return sigmoid(np.tanh(feats @ self.w["in"] + self.w["in_bias"]) @ self.w["out"] + self.w["out_bias"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Weights:
    """Weights fitted on labelled texts; both labels weigh the same in the loss."""
    rng = np.random.default_rng(seed)
    w: Weights = {
        "conv": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "in": rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)).astype(np.float32),
        "in_bias": np.zeros(HIDDEN, np.float32),
        "out": rng.normal(0, 0.2, HIDDEN).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    t, size = 0, np.array([len(x) for x in texts])
    for epoch in range(epochs):
        for at in batches(rng.permutation(len(texts)), size, batch):
            t += 1
            g = gradients(w, [texts[i] for i in at], labels[at], weight[at])
            lr = rate * (0.5 if epoch >= epochs // 2 else 1) * (0.4 if epoch >= epochs * 3 // 4 else 1)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def batches(order: np.ndarray, size: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """Consecutive parts of ``order``: ``batch`` texts and BATCH_BYTES at most, or one text."""
    at = 0
    while at < len(order):
        fits = np.searchsorted(np.cumsum(size[order[at : at + batch]]), BATCH_BYTES, "right")
        yield order[at : at + max(1, fits)]
        at += max(1, fits)


def gradients(w: Weights, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> Weights:
    """Gradient of the weighted log loss."""
    buf, starts, stops, first = layout(texts)
    pos = len(buf) - WIDTH
    act = w["conv"][0][buf[:pos]]
    for k in range(1, WIDTH):
        act += w["conv"][k][buf[k : pos + k]]
    act += w["bias"]
    top = np.maximum(pooled(act, starts, stops), 0)
    feats, chunk = combine(top, first)
    hidden = np.tanh(feats @ w["in"] + w["in_bias"])
    p = sigmoid(hidden @ w["out"] + w["out_bias"])
    d = ((p - labels) * weight / len(texts)).astype(act.dtype)
    d_hidden = d[:, None] * w["out"] * (1 - hidden**2)
    d_feats = d_hidden @ w["in"].T
    size = np.diff(first)
    d_chunk = np.repeat(d_feats[:, FILTERS:] / size[:, None], size, axis=0)
    for k in range(len(texts)):
        best = first[k] + chunk[first[k] : first[k + 1]].argmax(0)
        d_chunk[best, np.arange(FILTERS)] += d_feats[k, :FILTERS]
    nxt = followers(first)
    from_next = top[nxt] > top
    d_top = np.where(from_next, 0, d_chunk)
    np.add.at(d_top, nxt, np.where(from_next, d_chunk, 0))
    d_conv, d_bias = np.zeros_like(w["conv"]), np.zeros_like(w["bias"])
    live = np.argwhere((d_top != 0) & (top > 0))
    if len(live):
        where = np.array([starts[h] + np.argmax(act[starts[h] : stops[h], f]) for h, f in live], np.int64)
        f, value = live[:, 1], d_top[live[:, 0], live[:, 1]]
        np.add.at(d_bias, f, value)
        for k in range(WIDTH):
            np.add.at(d_conv[k], (buf[where + k], f), value)
    return {"conv": d_conv, "bias": d_bias, "in": feats.T @ d_hidden, "in_bias": d_hidden.sum(0), "out": hidden.T @ d, "out_bias": d.sum(keepdims=True)}


def fitting_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> tuple[list[bytes], np.ndarray]:
    """At most ``max_fit`` texts of each label, in the order of their doc_ids' hashes, as far as MAX_FIT_BYTES hold them.

    A text that doesn't fit beside those before it is passed over; a label of which none fits has its shortest one.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    of = lambda k: known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(max_fit)
    picked = F.broadcast(of(0).unionByName(of(1)))
    rows = docs.select(F.col(id_col).alias("_doc"), body(text_col).alias("_body")).join(picked, F.col("_doc") == F.col("_id"))
    # one row for each id, and their sizes before their texts: no more than the bounds comes to the driver
    one = materialize(rows.groupBy("_id", "_label").agg(F.min("_body").alias("_body")))
    sizes = sorted(one.select("_id", "_label", F.length("_body").alias("n")).collect(), key=lambda r: hash_order(r["_id"]))
    taken = fitting_ids([(r["_id"], r["_label"], r["n"]) for r in sizes], MAX_FIT_BYTES)
    rows = [r for r in one.where(F.col("_id").isin(list(taken))).collect()] if taken else []
    rows.sort(key=lambda r: taken[r["_id"]])
    return [bytes(r["_body"]) for r in rows], np.array([r["_label"] for r in rows], float)


def fitting_ids(sizes: list[tuple[int, int, int]], most: int) -> dict[int, int]:
    """The places of the ids that are fitted on, of (id, label, bytes) in their order."""
    taken, total = set(), 0
    for i, _, n in sizes:
        if total + n <= most:
            taken.add(i)
            total += n
    for label in {label for _, label, _ in sizes}:
        own = [(n, k, i) for k, (i, other, n) in enumerate(sizes) if other == label]
        if not any(i in taken for _, _, i in own):
            taken.add(min(own)[2])
    return {i: k for k, (i, _, _) in enumerate(sizes) if i in taken}


def hash_order(doc_id: int) -> int:
    import zlib

    return zlib.crc32(f"fit {doc_id}".encode())


def score(docs: DataFrame, weights: Weights | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("body"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None if weights is None else Network(weights)
        for batch in it:
            texts = batch["body"].to_pylist()
            out = [np.full(len(some), 0.5) if net is None else net.scores(some) for some in groups(texts)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate([*out, np.zeros(0)]), pa.float64())], ["doc_id", "score"])

    return arrow_map(rows, batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> DataFrame:
    """Fit on the given labels and score every document: (doc_id, score)."""
    texts, y = fitting_sample(docs, labels, label_col, id_col, text_col, max_fit)
    return score(docs, fit(texts, y) if 0 < y.sum() < len(y) else None, id_col, text_col)
