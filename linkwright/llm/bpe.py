"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch form a trie over their bytes, held as the sorted words, whose order is the
trie's depth-first order: a word goes on from the deepest node that it shares with the word before it.
Each node has one state, the last token of its prefix's encoding. A prefix's last token is the one
vocabulary entry that ends the prefix and may stand after the last token of what comes before it, so one
step down costs a few look-ups, and prefixes that words share are encoded once.

Two tokens may stand side by side if undoing their merges, latest first, never shows a pair across the
border that would have been merged earlier.

Defined results: null text counts as empty and gives no ids; each row gives one row, repeated ones too; a
null doc_id is kept; a very long text is a chunk of its own; nothing can tie; an empty table gives no rows; other
columns are ignored. Special tokens in a text become their own ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.shipping import arrow_map, slices

#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose encodings a worker keeps; beyond, it starts anew.
MAX_WORDS = 250_000
#: Characters of text that are encoded, decoded and handed back at a time.
CHUNK_CHARS = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder of one tokenizer file of kind BPE with a byte-level pre-tokenizer."""

    def __init__(self, source: str) -> None:
        import regex

        spec = json.loads(source)
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.made_at: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.merge_rank[a, b] = rank
            if whole not in self.made_at:
                self.made_at[whole], self.halves[whole] = rank, (a, b)
        #: Entries that merges really reach: their halves may not stand side by side.
        self.tokens = {t: i for t, i in self.ids.items() if i not in self.halves or self._reached(i)}
        self.split = regex.compile(PATTERN).findall
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.beside: dict[tuple[int, int], bool] = {}

    def _reached(self, token: int) -> bool:
        a, b = self.halves[token]
        return self._may_adjoin(a, b, self.made_at[token])

    def _may_adjoin(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge across the border of tokens a and b comes before rank ``before`` or their own making."""
        while True:
            across = self.merge_rank.get((a, b))
            if across is not None and across < before:
                return False
            made_a, made_b = self.made_at.get(a, -1), self.made_at.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                before, a = made_a, self.halves[a][1]
            else:  # at one rank the leftmost pair goes first, so an equal merge across the border would win
                before, b = made_b + 1, self.halves[b][0]

    def forget(self) -> None:
        """Give up what was learned, so that a worker that goes on to other tasks doesn't hold it."""
        self.known.clear()
        self.beside.clear()

    def learn(self, words: Iterable[str]) -> None:
        """Add the encodings of new distinct words to ``known``."""
        tokens, beside, longest = self.tokens, self.beside, self.longest
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        if len(beside) > MAX_WORDS:
            beside.clear()
        last = [-1]  # last[d]: last token of the node at depth d of the current path
        path = b""
        for word in sorted(w.encode() for w in words):
            n, shared = len(word), min(len(path), len(word))
            if path[:shared] != word[:shared]:
                shared = next(d for d in range(shared) if path[d] != word[d])
            del last[shared + 1 :]
            for d in range(shared + 1, n + 1):
                for at in range(max(0, d - longest), d):
                    token = tokens.get(word[at:d])
                    if token is None:
                        continue
                    if at:
                        pair = last[at], token
                        fits = beside.get(pair)
                        if fits is None:
                            fits = beside[pair] = self._may_adjoin(*pair)
                        if not fits:
                            continue
                    last.append(token)
                    break
            path, d, out = word, n, []
            while d:
                out.append(last[d])
                d -= len(self.bytes_of[last[d]])
            self.known[word.decode()] = tuple(reversed(out))

    def encode(self, texts: list[str]) -> list[list[int]]:
        split_up = []
        for text in texts:
            parts = [text] if self.special_at is None or not any(s in text for s in self.special) else self.special_at.split(text)
            split_up.append([[p] if p in self.special else self.split(p) for p in parts])
        words = {w for parts in split_up for p in parts for w in p}
        self.learn(words - self.known.keys() - self.special.keys() if len(self.known) <= MAX_WORDS else words - self.special.keys())
        get = self.known.__getitem__ if not self.special else lambda w, known=self.known, special=self.special: known.get(w) or (special[w],)
        return [list(chain.from_iterable(map(self.known.__getitem__ if len(parts) == 1 and parts[0] and parts[0][0] not in self.special else get, chain.from_iterable(parts)))) for parts in split_up]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(source: str) -> TrieBpe:
    return TrieBpe(source)


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters together; a longer text is a chunk of its own."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > chars:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def bpe(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text; ``tokenizer`` is the path of a tokenizer file on the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(source.value)
        for batch in slices(it):
            at = 0
            for some in chunks(batch["text"].to_pylist()):
                coded = bpe.encode(some)
                offsets = pa.array(np.cumsum([0, *map(len, coded)]).astype(np.int32))
                flat = pa.array(np.fromiter(chain.from_iterable(coded), np.int32))
                decoded = pa.array(map(bpe.decode, coded), pa.string())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(some)), pa.ListArray.from_arrays(offsets, flat), decoded], ["doc_id", "ids", "decoded"])
                at += len(some)
                del some, coded, offsets, flat, decoded  # nothing of a chunk stays while the next one is made
        bpe.forget()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, batches, f"doc_id {kind}, ids array<int>, decoded string")
