"""Spelling variants against all pairs of words, with cells of every size."""

import random
import zlib
from collections import Counter

import pytest

from linkwright.llm.spelling_variants import variant_groups, vocabulary


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, times=10):
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best is not None and words[best] >= times * n else None, n, len(others))
    rows = set()
    for w, (form, n, count) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, count, words[form] if form else None))
    return rows


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("cell_words", [5, 40, 8192])
def test_all_pairs(spark, cell_words):
    rng = random.Random(cell_words)
    base = ["".join(rng.choice("abß") for _ in range(rng.randint(7, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    words = {}
    for w in base:
        words[w] = rng.choice([2, 20, 300, 5000, 60000])
        for _ in range(3):
            k = rng.randrange(len(w))
            words.setdefault(rng.choice([w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "ÿ" + w[k + 1 :]]), rng.choice([2, 3, 25, 300]))
    words = {w: n for w, n in words.items() if len(w) >= 7}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(5)
    assert rows_of(variant_groups(df, cell_words=cell_words)) == brute(words)


def test_long_words(spark):
    w = "ab" * 30_000
    words = {w: 50, w[:40_000] + w[40_001:]: 3, w + "a": 2, "ba" + w[2:]: 4}
    assert rows_of(variant_groups(spark.createDataFrame(list(words.items()), "word string, n bigint"))) == brute(words)


def test_vocabulary(spark):
    texts = [(1, "Variant VARIANT variant Éclairage éclairage"), (2, None), (None, "variant, shorter"), (3, ""), (4, "shorter9shorter " * 3), (4, "shorter9shorter " * 3)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id bigint, text string, word string, n int")
    want = Counter()
    for i, t in texts:
        run = ""
        for c in (t or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
            run = ""
    want = {(w, n) for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {tuple(r) for r in vocabulary(docs).collect()} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert variant_groups(vocabulary(docs)).collect() == []
