"""Quality rules with risk-controlled thresholds.

Each rule rejects documents of which a signal exceeds a cutoff from a fixed grid; the rules of a stratum (a band
of lengths) work together. The labelled texts, copies counted once, are split by a hash. The tuning part gives
each stratum one path of ever stricter settings: step by step the cutoff is lowered that loses the fewest good
texts and then rejects the most bad ones, as long as a step rejects more than COST bad ones for each good one
lost. The holdout part tests the path from its loosest setting on: a setting is certified while the exact
binomial upper bound on the share of good texts that any of its rules rejects stays within ``max_false``. The
test stops at its first failure (fixed sequence, which needs no correction inside a path) and the level is
divided by the number of strata (Bonferroni). The last certified setting is used; without one the rules are
off in that stratum.

So with probability ``1 - delta`` no stratum loses more than ``max_false`` of its good documents that pass the
base rules; the base rules are fixed by the caller and no part of the bound.

Defined results: null and empty texts have no words and fail the base rules; each row gives one row;
labels of null doc_ids, null labels and documents without labels don't count; a doc_id with several labels, and
a text that several labelled documents have, counts as good if any of them is; a very long text is measured whole;
values that tie with a cutoff pass; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.shipping import arrow_map

from linkwright.llm.bytewords import Words, groups
from linkwright.llm.common import body, materialize

#: Lower bounds of the strata, in words.
BANDS = (0, 100, 400, 1600)
#: Cutoffs of each signal, loosest first.
CUTOFFS = {
    "symbol_rate": [2.0, 1.5, 1.2, 1.0, 0.8, 0.65, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05],
    "upper_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12],
    "repeat_share": [0.3, 0.28, 0.25, 0.22, 0.2, 0.18, 0.15, 0.12, 0.1],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "mark_rate": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.35, 0.3],
}
#: Bad texts that must be rejected for each good one that is lost.
COST = 20
SYMBOLS = b"#*$%&|<>"
#: One part in TUNING of the labelled texts gives the paths, the others certify them.
TUNING = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks")
_KIND = np.zeros((4, 256), bool)
_KIND[0, list(SYMBOLS)] = True
_KIND[1, 0x41:0x5B] = True
_KIND[2, 0x61:0x7B] = True
_KIND[3, list(b"!?")] = True
WINDOW = 8


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines that have a word and equal an earlier line, and lines that have a word."""
    lines = [x for x in text.split(b"\n") if x and x.split(None, 1)]
    return len(lines) - len(set(lines)), len(lines)


def repeat_words(words: Words) -> np.ndarray:
    """By text, the words that lie in windows found twice or more in it."""
    first, h = words.windows(WINDOW, words.hashes())
    by = np.lexsort((h, words.doc[first])) if len(first) else first
    same = np.zeros(len(first), bool)
    if len(first):
        a, b = by[:-1], by[1:]
        twin = (h[a] == h[b]) & (words.doc[first[a]] == words.doc[first[b]])
        same[a[twin]] = True
        same[b[twin]] = True
    step = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(step, first[same], 1)
    np.add.at(step, first[same] + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=words.n_docs)


def counts(texts: list[bytes]) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = []
    for some in groups(texts):
        w = Words(some)
        kind = [w.per_doc(k[w.buf]) for k in _KIND]
        points = w.per_doc(w.solid & ((w.buf & 0xC0) != 0x80))
        lines = np.array([dup_lines(t) for t in some], np.int64).reshape(-1, 2)
        out.append(np.stack([np.bincount(w.doc, minlength=w.n_docs), points, kind[0], lines[:, 0], repeat_words(w), lines[:, 1], kind[1], kind[2], kind[3]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(COUNTS)), np.int64)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the COUNTS of every whole text, and text_hash."""
    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("body"), F.xxhash64(body(text_col)).alias("text_hash"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = counts(batch["body"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(n[:, k], pa.int64()) for k in range(len(COUNTS))), batch["text_hash"]], ["doc_id", *COUNTS, "text_hash"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, batches, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in (*COUNTS, "text_hash")))


def signals() -> dict[str, Column]:
    of = lambda a, b: F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0))
    return {
        "symbol_rate": of("n_symbols", F.col("n_words")),
        "upper_share": of("n_upper", F.col("n_upper") + F.col("n_lower")),
        "repeat_share": of("n_repeat_words", F.col("n_words")),
        "dup_line_share": of("n_dup_lines", F.col("n_lines")),
        "mark_rate": of("n_marks", F.col("n_words")),
    }


def stratum() -> Column:
    return sum((F.when(F.col("n_words") >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if k >= n:
        return 1.0
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return math.fsum(math.exp(term(i)) for i in range(k + 1))


def certified(rejected: int, n: int, most: float, level: float) -> bool:
    """Whether the exact upper bound on the share at this level is ``most`` or less."""
    return n > 0 and binomial_cdf(rejected, n, most) <= level


def labelled_texts(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Measured texts that pass the base rules and have a label, copies once: good and tuning beside the COUNTS."""
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_good"))
    held = measured.where(~base_failed()).join(good, F.col("doc_id") == F.col("_id"))
    once = held.groupBy("text_hash").agg(F.max("_good").cast("int").alias("good"), *(F.first(c).alias(c) for c in COUNTS))
    return once.withColumn("tuning", F.pmod(F.xxhash64("text_hash"), F.lit(TUNING)) == 0)


Step = tuple[str, float]


def path_of(lost: dict[Step, int], caught: dict[Step, int]) -> list[Step]:
    """Ever stricter settings from counts of good texts lost and bad ones caught by each cutoff: one cutoff is lowered in each step."""
    at, out = dict.fromkeys(CUTOFFS, -1), []
    while True:
        found = []
        for n, (s, grid) in enumerate(CUTOFFS.items()):
            since = (lost[s, grid[at[s]]], caught[s, grid[at[s]]]) if at[s] >= 0 else (0, 0)
            for k in range(at[s] + 1, len(grid)):
                good, bad = lost[s, grid[k]] - since[0], caught[s, grid[k]] - since[1]
                if bad > COST * good:
                    found.append((good, -bad, n, k, s))
        if not found:
            return out
        _, _, _, k, s = min(found)
        at[s] = k
        out.append((s, CUTOFFS[s][k]))


def least_texts(most: float, level: float) -> int:
    """The good holdout texts without which not even a rule that rejects none of them is certified."""
    return math.ceil(math.log(level) / math.log1p(-most))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, max_false: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> dict[tuple[int, str], float]:
    """Cutoffs by stratum and signal."""
    return certify(measured, labels, max_false, delta, id_col, label_col)[0]


def certify(
    measured: DataFrame, labels: DataFrame, max_false: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", label_col: str = "quality"
) -> tuple[dict[tuple[int, str], float], dict[int, str]]:
    """Cutoffs by stratum and signal, and for each stratum what its certificate is or why it has none.

    What comes to the driver is a count for each grid cell: its size is fixed.
    """
    texts = materialize(labelled_texts(measured, labels, id_col, label_col).withColumn("stratum", stratum()))
    cells = {(s, c): F.sum((v > c).cast("long")) for s, v in signals().items() for c in CUTOFFS[s]}
    found = texts.where("tuning").groupBy("stratum", "good").agg(*(v.alias(f"c{k}") for k, v in enumerate(cells.values()))).collect()
    counted = {(r["stratum"], r["good"]): {step: r[f"c{k}"] for k, step in enumerate(cells)} for r in found}
    none = dict.fromkeys(cells, 0)
    paths = {band: path_of(counted.get((band, 1), none), counted.get((band, 0), none)) for band in range(len(BANDS))}
    steps = [F.when((F.col("stratum") == band) & (signals()[s] > c), F.lit(k)) for band, path in paths.items() for k, (s, c) in enumerate(path)]
    # the step from which on a text is rejected
    step_of = F.array_min(F.array(*steps)) if steps else F.lit(None).cast("int")
    tested = texts.where("NOT tuning AND good = 1").groupBy("stratum", step_of.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    out, why = {}, {}
    least = least_texts(max_false, delta / len(BANDS))
    for band, path in paths.items():
        n = sum(r["n"] for r in tested if r["stratum"] == band)
        why[band] = f"none: {n} of {least} good holdout texts" if n < least else "none: no setting is worth its losses" if not path else "none: the first setting rejects too many"
        for k, (s, c) in enumerate(path):
            rejected = sum(r["n"] for r in tested if r["stratum"] == band and r["step"] is not None and r["step"] <= k)
            if not certified(rejected, n, max_false, delta / len(BANDS)):
                break
            out[band, s] = c
            why[band] = f"false rejections at most {max_false:g}, from {n} good holdout texts"
    return out, why


def quality_rules(docs: DataFrame, labels: DataFrame, max_false: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, text_hash, stratum, base_failed, kept, failed_rules and certificate of every document.

    A stratum without enough good holdout texts has no certified rule, and ``certificate`` says so: the base rules decide alone there.
    """
    measured = materialize(measure(docs, id_col, text_col))
    cutoffs, why = certify(measured, labels, max_false, delta)
    s = signals()
    hits = [F.when((stratum() == band) & (s[name] > c), F.lit(name)) for (band, name), c in cutoffs.items()]
    failed = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    out = measured.withColumn("stratum", stratum()).withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    out = out.withColumn("certificate", F.create_map(*(F.lit(x) for pair in why.items() for x in pair))[F.col("stratum")])
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
