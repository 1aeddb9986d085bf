"""Similarity of normalised strings. Jaro and what is built on it are helpers on batches; the rest is native."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwright.functions import pairs as P
from linkwright.functions.pairs import CONTAINS_LENGTH, CONTAINS_SCORE, SIGNIFICANT_LENGTH
from linkwright.shipping import arrow_helper


# ---- Spark expressions ----


def tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, r"\s+"), lambda w: w != ""))


def _scored(x: Column, y: Column, score: Column) -> Column:
    none_x, none_y = F.size(x) == 0, F.size(y) == 0
    return F.when(none_x & none_y, F.lit(1.0)).when(none_x | none_y, F.lit(0.0)).otherwise(score)


def dice(x: Column, y: Column) -> Column:
    """Dice score of two lists of different tokens."""
    return _scored(x, y, 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def _of_tokens(a: Column, b: Column, score: Callable[[Column, Column], Column]) -> Column:
    """A score of both texts' tokens, which are split once."""
    return F.transform(F.array(F.struct(tokens(a).alias("x"), tokens(b).alias("y"))), lambda t: score(t["x"], t["y"]))[0]


def word_jaccard(a: Column, b: Column) -> Column:
    return _of_tokens(a, b, lambda x, y: _scored(x, y, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))))


def token_set(a: Column, b: Column) -> Column:
    return _of_tokens(a, b, dice)


def contains_score(a: Column, b: Column) -> Column:
    either = a.contains(b) | b.contains(a)
    shorter = F.least(F.length(a), F.length(b))
    return F.when(shorter == 0, F.lit(0.0)).when(a == b, F.lit(1.0)).when((shorter >= CONTAINS_LENGTH) & either, F.lit(CONTAINS_SCORE)).otherwise(F.lit(0.0))


def contains_significant(a: Column, b: Column) -> Column:
    """Whether the shorter text, of two words or six characters, stands on word boundaries in the longer one."""
    first = F.length(a) <= F.length(b)
    short, long_ = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    enough = (F.length(short) >= SIGNIFICANT_LENGTH) | short.contains(" ")
    return enough & F.concat(F.lit(" "), long_, F.lit(" ")).contains(F.concat(F.lit(" "), short, F.lit(" ")))


def is_stripped_sibling(variants: Column, k: Column) -> Column:
    """Whether variant k is the next one without its spaces."""
    own, after = F.get(variants, k), F.get(variants, k + 1)
    return ~own.contains(" ") & F.coalesce(F.replace(after, F.lit(" "), F.lit("")) == own, F.lit(False)) & (F.coalesce(after, F.lit("")) != "")


def jaro(a: Column, b: Column) -> Column:
    return arrow_helper(_jaro, "double")(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return arrow_helper(_jaro_winkler, "double")(a, b)


def _jaro(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairs(P.jaro, a, b, pa.float64())


def _jaro_winkler(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairs(P.winkler, a, b, pa.float64())


def winkler_bound(a: Column, b: Column) -> Column:
    """What Jaro-Winkler is at most, whatever the letters."""
    shorter = F.least(F.length(a), F.length(b))
    bound = (F.try_divide(shorter, F.length(a)) + F.try_divide(shorter, F.length(b)) + 1) / 3
    return F.when(shorter == 0, F.lit(0.0)).otherwise(bound + 0.4 * (1 - bound))


def fuzzy_score(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(contains_score(a, b), jaro_winkler(a, b), word_jaccard(a, b), token_set(a, b)))


def fuzzy_at_least(a: Column, b: Column, threshold: float) -> Column:
    """Bounds first: the helper gets the texts of the rows that they leave open, and nulls for the others."""
    sure = (a == b) | (contains_score(a, b) >= threshold) | (token_set(a, b) >= threshold)  # word Jaccard never exceeds Dice
    open_ = ~sure & (winkler_bound(a, b) >= threshold)
    near = jaro_winkler(F.when(open_, a), F.when(open_, b)) >= threshold
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(sure | F.coalesce(near, F.lit(False)))


def token_aware(a: Column, b: Column, threshold: float) -> Column:
    def batch(x: pa.Array, y: pa.Array) -> pa.Array:
        return _pairs(lambda t, p, q: P.token_aware(t, p, q, threshold), x, y, pa.bool_())

    return arrow_helper(batch, "boolean")(a, b)


def coded(*arrays: pa.Array) -> tuple[P.Texts, list[np.ndarray]]:
    """The distinct texts of some arrays, and each array as places in them; nulls have the first place."""
    both = pc.dictionary_encode(pa.concat_arrays([a.cast(pa.string()) for a in arrays]))
    place = pc.fill_null(both.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return P.Texts(both.dictionary.to_pylist()), np.split(place, np.cumsum([len(a) for a in arrays])[:-1])


def starts(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins among all lists' texts, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _pairs(score: Callable[[P.Texts, np.ndarray, np.ndarray], np.ndarray], a: pa.Array, b: pa.Array, kind: pa.DataType) -> pa.Array:
    """Scores of the pairs without nulls; the others are null."""
    full = np.logical_and(a.is_valid().to_numpy(zero_copy_only=False), b.is_valid().to_numpy(zero_copy_only=False))
    t, (x, y) = coded(a, b)
    out = np.zeros(len(a), kind.to_pandas_dtype())
    out[full] = score(t, x[full], y[full])
    return pa.array(out, kind, mask=~full)


def any_alike(texts: Column, text: Column, threshold: float) -> Column:
    """Whether one of some texts equals, holds or resembles another text."""

    def batch(a: pa.Array, b: pa.Array) -> pa.Array:
        t, (own, other) = coded(a.flatten(), b)
        pair, x, y = P.of_lists(own, starts(a), other, np.arange(len(other) + 1))
        codes, which = np.unique(x * len(t.n) + y, return_inverse=True)
        sure, near, _ = P.alike(t, codes // max(1, len(t.n)), codes % max(1, len(t.n)), threshold)
        return pa.array(np.bincount(pair[(sure | near)[which]], minlength=len(b)) > 0)

    return arrow_helper(batch, "boolean")(texts, text)


def best_score(a: Column, b: Column, least: float = 0.0) -> Column:
    """The best fuzzy score of any text of one list and any of another, 0 without any; 0 too where it is below ``least``."""

    def batch(p: pa.Array, q: pa.Array) -> pa.Array:
        t, (x, y) = coded(p.flatten(), q.flatten())
        return pa.array(P.best_of_lists(t, x, starts(p), y, starts(q), least), pa.float64())

    return arrow_helper(batch, "double")(a, b)
