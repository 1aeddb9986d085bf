"""Similarity of pairs of texts, worked out for whole batches in numpy.

A batch holds each text once, as one run of code points; pairs are two arrays of places in it. Jaro finds matches
with the second text's letters as bits of 64-bit words: a letter's positions, the window and the positions
still free meet in one operation for all pairs, and the lowest bit left is the match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CONTAINS_SCORE, CONTAINS_LENGTH, SIGNIFICANT_LENGTH = 0.8, 3, 6
#: Pairs that are laid out at a time, and letters or table entries of them.
LAID_OUT, LAID_OUT_CELLS = 4096, 1 << 22
SPACE = 32
_ONES = np.array([(1 << k) - 1 for k in range(65)], np.uint64)
#: What bounds may err by in floating point.
SLACK = 1e-9


class Texts:
    """Distinct texts: code points, words, and letters as bits for a bound on what two texts share."""

    def __init__(self, texts: list[str]) -> None:
        self.n = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        self.flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        spaced = np.zeros(len(texts), np.int64)
        owner = np.repeat(np.arange(len(texts)), self.n)
        np.add.at(spaced, owner[self.flat == SPACE], 1)
        self.spaced = spaced > 0
        self._words(texts)
        self._bags(owner)

    def _words(self, texts: list[str]) -> None:
        split = [list(dict.fromkeys(t.split())) for t in texts]
        number = {w: k for k, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        self.n_words = np.array([len(ws) for ws in split], np.int64)
        self.word_start = np.concatenate([[0], np.cumsum(self.n_words)])[:-1]
        self.words = np.array([number[w] for ws in split for w in ws], np.int64)
        self.word_kinds = max(1, len(number))
        owner = np.repeat(np.arange(len(texts)), self.n_words)
        self.word_keys = np.sort(owner * self.word_kinds + self.words)
        lengths = np.array([len(w) for ws in split for w in ws], np.int64)
        lengths = lengths[np.lexsort((lengths, owner))]
        total = np.cumsum(lengths)
        before = np.concatenate([[0], total])[self.word_start]
        #: Letters of a text's k + 1 shortest words, at word_start + k.
        self.shortest = total - np.repeat(before, self.n_words)

    def _bags(self, owner: np.ndarray) -> None:
        """Each letter, with the number of the same before it, is a bit; ``extra`` counts those whose bit was taken."""
        c = self.flat.astype(np.int64)
        rank = np.where((c >= 97) & (c <= 122), c - 97, np.where((c >= 48) & (c <= 57), c - 22, np.where(c == SPACE, 36, c % 37)))
        order = np.lexsort((c, owner))
        key = np.stack([owner[order], c[order]])
        new = np.any(np.diff(key, axis=1, prepend=-1), axis=0) if len(c) else np.zeros(0, bool)
        at = np.arange(len(c))
        times = at - np.maximum.accumulate(np.where(new, at, 0)) if len(c) else at
        bit = np.where(times < 3, rank[order] + 37 * times, 111 + (rank[order] + times) % 17)
        self.bits = np.zeros((2, len(self.n)), np.uint64)
        taken = np.unique(owner[order] * 128 + bit)
        np.add.at(self.bits, ((taken % 128) // 64, taken // 128), np.left_shift(np.uint64(1), (taken % 64).astype(np.uint64)))
        self.extra = self.n - np.bitwise_count(self.bits).sum(0).astype(np.int64)

    def laid_out(self, x: np.ndarray, cut: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A row of code points for each text from ``cut`` on, zeros behind its ``n``."""
        width = int(n.max(initial=0))
        at = np.arange(width)
        inside = at < n[:, None]
        return np.where(inside, self.flat[np.where(inside, (self.start[x] + cut)[:, None] + at, 0)] if len(self.flat) else 0, 0).astype(np.uint32)


def blocks(width: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of like widths, as many at a time as may be laid out."""
    order = np.argsort(width, kind="stable")
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + LAID_OUT)
        while hi - lo > 1 and (hi - lo) * int(width[order[hi - 1]]) > LAID_OUT_CELLS:
            hi = lo + (hi - lo) // 2
        yield order[lo:hi]
        lo = hi


def strings(t: Texts, x: np.ndarray) -> np.ndarray:
    n = t.n[x]
    rows = t.laid_out(x, np.zeros(len(x), np.int64), n)
    return np.ascontiguousarray(rows).view(f"U{rows.shape[1]}").reshape(-1) if rows.shape[1] else np.full(len(x), "", "U1")


# ---- scores ----


def jaro(t: Texts, x: np.ndarray, y: np.ndarray, cut: np.ndarray | None = None) -> np.ndarray:
    """Jaro of each pair, from ``cut`` on."""
    return _by_letters(t, x, y, cut)[0]


def winkler(t: Texts, x: np.ndarray, y: np.ndarray, cut: np.ndarray | None = None) -> np.ndarray:
    j, same = _by_letters(t, x, y, cut)
    return j + 0.1 * same * (1 - j)


def _by_letters(t: Texts, x: np.ndarray, y: np.ndarray, cut: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Jaro, and the number of equal letters at the front, four at most."""
    cut = np.zeros(len(x), np.int64) if cut is None else cut
    la, lb = t.n[x] - cut, t.n[y] - cut
    score, same = np.zeros(len(x)), np.zeros(len(x), np.int64)
    some = np.flatnonzero((la > 0) & (lb > 0))
    for at in blocks(np.maximum(la, lb)[some]):
        _jaro_block(t, x, y, cut, la, lb, some[at], score, same)
    return score, same


def _jaro_block(t: Texts, x: np.ndarray, y: np.ndarray, cut: np.ndarray, la: np.ndarray, lb: np.ndarray, at: np.ndarray, score: np.ndarray, same: np.ndarray) -> None:
    na, nb = la[at], lb[at]
    a, b = t.laid_out(x[at], cut[at], na), t.laid_out(y[at], cut[at], nb)
    kinds, letter = np.unique(np.concatenate([a.reshape(-1), b.reshape(-1)]), return_inverse=True)
    n, wide, words = len(at), b.shape[1], -(-b.shape[1] // 64)
    if n > 1 and n * len(kinds) * words > LAID_OUT_CELLS:
        for half in (at[: n // 2], at[n // 2 :]):
            _jaro_block(t, x, y, cut, la, lb, half, score, same)
        return
    in_a, in_b = letter[: a.size].reshape(a.shape), letter[a.size :].reshape(b.shape)
    rows = np.arange(n)
    places = np.zeros((words, n, len(kinds)), np.uint64)
    for j in range(wide):
        live = rows[j < nb]
        places[j // 64, live, in_b[live, j]] |= np.uint64(1 << (j % 64))
    reach = np.maximum(0, np.maximum(na, nb) // 2 - 1)
    used, hit = np.zeros((words, n), np.uint64), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        low, high = np.minimum(np.maximum(0, i - reach), nb), np.minimum(nb, i + reach + 1)
        free = i < na
        for w in range(words):
            window = _ONES[np.clip(high - 64 * w, 0, 64)] & ~_ONES[np.clip(low - 64 * w, 0, 64)]
            left = np.where(free, places[w, rows, in_a[:, i]] & window & ~used[w], np.uint64(0))
            first = left & (~left + np.uint64(1))
            used[w] |= first
            hit[:, i] |= first != 0
            free = free & (first == 0)
    m = hit.sum(1)
    bits = np.unpackbits(np.ascontiguousarray(used.T).astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, :wide].astype(bool)
    moved = np.bincount(np.repeat(rows, m), weights=a[hit] != b[bits], minlength=n)
    some = np.maximum(m, 1)
    score[at] = np.where(m > 0, (m / na + m / nb + (m - moved / 2) / some) / 3, 0.0)
    four = min(4, a.shape[1], b.shape[1])
    equal = (a[:, :four] == b[:, :four]) & (np.arange(four) < np.minimum(na, nb)[:, None])
    same[at] = np.cumprod(equal, axis=1).sum(1)


def dice(t: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dice score of the words of each pair."""
    times = t.n_words[x]
    pair = np.repeat(np.arange(len(x)), times)
    at = np.repeat(t.word_start[x] - np.cumsum(times) + times, times) + np.arange(len(pair))
    key = y[pair] * t.word_kinds + t.words[at] if len(pair) else np.zeros(0, np.int64)
    place = np.searchsorted(t.word_keys, key)
    shared = np.zeros(len(key), bool)
    inside = place < len(t.word_keys)
    shared[inside] = t.word_keys[place[inside]] == key[inside]
    both = np.bincount(pair[shared], minlength=len(x))
    nx, ny = t.n_words[x], t.n_words[y]
    return np.where((nx == 0) | (ny == 0), (nx == ny).astype(float), 2 * both / np.maximum(nx + ny, 1))


def _ordered(t: Texts, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = t.n[x] <= t.n[y]
    return np.where(first, x, y), np.where(first, y, x)


def contained(t: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the shorter text of each pair, of some letters at least, is a part of the longer one."""
    short, long_ = _ordered(t, x, y)
    out = np.zeros(len(x), bool)
    some = np.flatnonzero((t.n[short] >= CONTAINS_LENGTH) & (shared_letters(t, x, y) >= t.n[short]))
    for at in blocks(t.n[long_[some]]):
        out[some[at]] = np.strings.find(strings(t, long_[some[at]]), strings(t, short[some[at]])) >= 0
    return out


def significant(t: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the shorter text, of two words or six characters, stands on word boundaries in the longer one."""
    short, long_ = _ordered(t, x, y)
    out = np.zeros(len(x), bool)
    some = np.flatnonzero(((t.n[short] >= SIGNIFICANT_LENGTH) | t.spaced[short]) & (shared_letters(t, x, y) >= t.n[short]))
    spaced = lambda s: np.strings.add(np.strings.add(" ", s), " ")
    for at in blocks(t.n[long_[some]] + 2):
        out[some[at]] = np.strings.find(spaced(strings(t, long_[some[at]])), spaced(strings(t, short[some[at]]))) >= 0
    return out


def fuzzy(t: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The best of containment, Jaro-Winkler and Dice; word Jaccard never exceeds Dice."""
    rest = np.maximum(np.where(contained(t, x, y), CONTAINS_SCORE, 0.0), np.maximum(dice(t, x, y), winkler(t, x, y)))
    return np.where(x == y, 1.0, rest)


def leading_words(t: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Letters of the leading words that both texts of a pair share, the space behind them included; 0 where one has no space."""
    out = np.zeros(len(x), np.int64)
    some = np.flatnonzero(t.spaced[x] & t.spaced[y])
    least = np.minimum(t.n[x], t.n[y])
    for at in blocks(least[some]):
        pair = some[at]
        n = least[pair]
        none = np.zeros(len(pair), np.int64)
        a, b = t.laid_out(x[pair], none, n), t.laid_out(y[pair], none, n)
        place = np.arange(a.shape[1])
        apart = (a != b) | (place >= n[:, None])
        differ = np.where(apart.any(1), apart.argmax(1), n)
        out[pair] = np.where((a == SPACE) & (place < differ[:, None]), place + 1, 0).max(1)
    return out


def token_aware(t: Texts, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair matches by words or letters, not carried by leading words that both share."""
    out = (x == y) | (dice(t, x, y) >= threshold)
    rest = np.flatnonzero(~out)
    cut = leading_words(t, x[rest], y[rest])
    # remainders are compared where both have one
    open_ = (cut == 0) | ((t.n[x[rest]] > cut) & (t.n[y[rest]] > cut))
    rest, cut = rest[open_], cut[open_]
    out[rest] = winkler(t, x[rest], y[rest], cut) >= threshold
    return out


# ---- bounds ----


def shared_letters(t: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At least as many letters as both texts of a pair have in common."""
    met = np.bitwise_count(t.bits[0, x] & t.bits[0, y]).astype(np.int64) + np.bitwise_count(t.bits[1, x] & t.bits[1, y])
    return met + np.minimum(t.extra[x], t.extra[y])


def may_match(t: Texts, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a pair can be equal, contained or ``token_aware``: bounds from lengths, letters and words that let no match go."""
    both = shared_letters(t, x, y)
    na, nb = t.n[x], t.n[y]
    short = np.minimum(na, nb)
    part = both >= short
    # equal fronts add four tenths of what is missing at most; shared leading words only lower the rest's score
    need = 3 * (threshold - 0.4) / 0.6 - 1
    near = both / np.maximum(na, 1) + both / np.maximum(nb, 1) >= need - SLACK
    wa, wb = t.n_words[x], t.n_words[y]
    count = np.ceil(threshold * (wa + wb) / 2 - SLACK).astype(np.int64)
    fits = (count <= np.minimum(wa, wb)) & (count > 0)
    words = fits.copy()
    at = np.flatnonzero(fits)
    if len(at):
        k = count[at] - 1
        words[at] = both[at] >= np.maximum(t.shortest[t.word_start[x[at]] + k], t.shortest[t.word_start[y[at]] + k])
    return part | near | words | (count <= 0)


def may_match_closely(t: Texts, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """``may_match`` with what costs more: the words themselves, and the front that both share."""
    both = shared_letters(t, x, y)
    cut = leading_words(t, x, y)
    na, nb = t.n[x] - cut, t.n[y] - cut
    left = both - cut
    four = _front(t, x, y, cut)
    j = (left / np.maximum(na, 1) + left / np.maximum(nb, 1) + 1) / 3
    near = (left > 0) & (j + 0.1 * four * (1 - j) >= threshold - SLACK)
    short = np.where(t.n[x] <= t.n[y], x, y)
    part = (both >= t.n[short]) & ((t.n[short] >= SIGNIFICANT_LENGTH) | t.spaced[short])
    return (x == y) | near | part | (dice(t, x, y) >= threshold)


def _front(t: Texts, x: np.ndarray, y: np.ndarray, cut: np.ndarray) -> np.ndarray:
    out, going = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for k in range(4):
        at = cut + k
        inside = going & (at < t.n[x]) & (at < t.n[y])
        place = lambda s: np.where(inside, t.start[s] + at, 0)
        going = inside & (t.flat[place(x)] == t.flat[place(y)]) if len(t.flat) else inside & False
        out += going
    return out


def alike(t: Texts, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Of distinct pairs: which are equal or contained, which match by words or letters, and how many were compared."""
    sure, near = np.zeros(len(x), bool), np.zeros(len(x), bool)
    some = np.flatnonzero(may_match(t, x, y, threshold))
    some = some[may_match_closely(t, x[some], y[some], threshold)]
    sure[some] = (x[some] == y[some]) | significant(t, x[some], y[some])
    rest = some[~sure[some]]
    near[rest] = token_aware(t, x[rest], y[rest], threshold)
    return sure, near, len(some)


def of_lists(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, x, y): all texts of each pair of lists; list k has the texts from start[k] to start[k + 1]."""
    nb = np.diff(b_start)
    n = np.diff(a_start) * nb
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    width = np.maximum(nb[pair], 1)
    return pair, a[a_start[pair] + k // width], b[b_start[pair] + k % width]


def best_of_lists(t: Texts, a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, least: float = 0.0) -> np.ndarray:
    """The best ``fuzzy`` of each pair of lists of texts, 0 without any; equal pairs of texts are scored once.

    With ``least``, scores that bounds show to be below it count as 0.
    """
    pair, x, y = of_lists(a, a_start, b, b_start)
    codes, which = np.unique(x * len(t.n) + y, return_inverse=True)
    x, y = codes // max(1, len(t.n)), codes % max(1, len(t.n))
    scores = np.zeros(len(codes))
    some = np.flatnonzero(may_match(t, x, y, least)) if least > 0 else np.arange(len(codes))
    scores[some] = fuzzy(t, x[some], y[some])
    out = np.zeros(len(a_start) - 1)
    np.maximum.at(out, pair, scores[which])
    return out
