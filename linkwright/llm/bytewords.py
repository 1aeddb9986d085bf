"""Words of many texts at once, in numpy: where they lie, what they hash to.

A word is a run of bytes other than space and 0x09 to 0x0D. Texts are laid end to end with a line feed
after each, so that no word crosses from one into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are handled at a time.
CHUNK = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (finalizer constants are fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2^64 and of its inverse, up to n at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + CHUNK // 4)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def groups(texts: list[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``size`` bytes together; a longer text stands alone."""
    some, n = [], 0
    for t in texts:
        if some and n + len(t) > size:
            yield some
            some, n = [], 0
        some.append(t)
        n += len(t) + 1
    if some:
        yield some


class Words:
    """Words of some texts: ``start``, ``end`` (byte positions in ``buf``) and ``doc`` (index of the text)."""

    def __init__(self, texts: list[bytes]) -> None:
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.n_docs = len(texts)
        solid = np.empty(len(self.buf) + 2, bool)
        solid[0] = solid[-1] = False
        np.logical_not(SPACE[self.buf], out=solid[1:-1])
        self.solid = solid[1:-1]
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.ends, self.start, "right")

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value for each byte, by text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return np.diff(total[np.concatenate([[0], self.ends])])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_RANDOM[self.buf] * up[: len(self.buf)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, k: int, word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of k words that lie in one text, and the windows' hashes."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(0xD1342543DE82EF95) + word_hashes[i : i + n]
        inside = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return inside, mix(h[inside])
