import random

import numpy as np
import plain_similarity as plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkwright.functions import pairs as P
from linkwright.functions import similarity as S
import linkwright.operators.blocks as B
from linkwright.operators.blocks import alike_in_blocks, alike_lists, dealt


def of(score, a, b, *more):
    """A batch of one pair."""
    t, (x, y) = S.coded(pa.array([a]), pa.array([b]))
    return score(t, x, y, *more)[0]


@pytest.mark.parametrize(
    "a,b,expected",
    [("", "x", 0.0), ("abc", "abc", 1.0), ("abcxyzwv", "bcaxyzwv", 0.9375), ("martha", "marhta", (1 + 1 + 5 / 6) / 3), ("abc", "xyz", 0.0)],
)
def test_jaro(a, b, expected):
    assert plain.jaro_of(a, b) == of(P.jaro, a, b) == pytest.approx(expected)


def test_winkler_boost_is_always_applied():
    assert of(P.winkler, "abxxxxxx", "abyyyyyy") == pytest.approx(0.6)
    assert of(P.winkler, "body", "body f10ating10") == pytest.approx(0.853333, abs=1e-5)


def test_token_measures(spark):
    rows = [("a b c", "a b d"), ("one two", "two one"), ("", ""), ("a", ""), ("a b", "a c"), ("x y", "x y z")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.word_jaccard(F.col("a"), F.col("b")).alias("j"), S.token_set(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(round(r.j, 4), round(r.d, 4)) for r in got] == [(0.5, 0.6667), (1, 1), (1, 1), (0, 0), (0.3333, 0.5), (0.6667, 0.8)]


def test_contains(spark):
    rows = [("plastic beach", "welcome to the plastic beach"), ("joy", "overjoyed"), ("night", "midnightcity"), ("home", "home"), ("friend", "my friend"), ("ab", "abc")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.contains_significant(F.col("a"), F.col("b")).alias("s"), S.contains_score(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.s for r in got] == [True, False, False, False, True, False]
    assert [r.c for r in got] == [0.8, 0.8, 0.8, 1.0, 0.8, 0.0]
    assert [of(P.significant, a, b) for a, b in rows] == [True, False, False, False, True, False]


def test_leading_words_do_not_carry_a_match():
    for a, b in (("the deal", "the pain"), ("game over", "game start"), ("more than friends", "more than life")):
        assert not of(P.token_aware, a, b, 0.85)
    assert of(P.token_aware, "harder better faster stroger", "harder better faster stronger", 0.85)
    assert of(P.token_aware, "the deal", "the deal breaker", 0.85)  # "deal" with "deal breaker"
    assert not of(P.token_aware, "the deal", "the deal breaker", 0.87)
    assert of(P.token_aware, "body", "body f10ating10", 0.85)
    assert not of(P.token_aware, "body", "body f10ating10", 0.86)


def texts(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "deal", "deals", "a", "night", "nightcall", "call", "remix", "beach", "plastic", "ß", "été", "0", "10ating", "x" * 70, "ab" * 40, "aaaa"]
    out = {"", "a", "ab", "abc"}
    while len(out) < n:
        s = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(s) + 1)
            s = rng.choice([s[:k] + rng.choice("abe 1é😀") + s[k:], s[:k] + s[k + 1 :], s[:k] + s[k + 1 : k + 2] + s[k : k + 1] + s[k + 2 :]])
        out.add(" ".join(s.split()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_give_what_single_texts_give(seed, monkeypatch):
    if seed == 2:  # little is laid out at a time
        monkeypatch.setattr(P, "LAID_OUT", 7)
        monkeypatch.setattr(P, "LAID_OUT_CELLS", 300)
    all_ = texts(seed, 160 if seed == 1 else 60)
    t = P.Texts(all_)
    x, y = (v.reshape(-1) for v in np.meshgrid(np.arange(len(all_)), np.arange(len(all_))))
    both = [(all_[i], all_[j]) for i, j in zip(x, y)]
    assert np.allclose(P.jaro(t, x, y), [plain.jaro_of(a, b) for a, b in both], atol=1e-12)
    assert np.allclose(P.winkler(t, x, y), [plain.winkler_of(a, b) for a, b in both], atol=1e-12)
    assert np.allclose(P.dice(t, x, y), [plain.dice_of(a, b) for a, b in both], atol=1e-12)
    assert np.allclose(P.fuzzy(t, x, y), [plain.fuzzy_of(a, b) for a, b in both], atol=1e-12)
    assert P.significant(t, x, y).tolist() == [plain.significant_of(a, b) for a, b in both]
    for threshold in (0.6, 0.72, 0.85, 1.0):
        want = [plain.token_aware_of(a, b, threshold) for a, b in both]
        assert P.token_aware(t, x, y, threshold).tolist() == want
        # bounds let no match go
        good = np.array(want) | np.array([a == b or plain.significant_of(a, b) for a, b in both])
        for bound in (P.may_match, P.may_match_closely):
            assert not (good & ~bound(t, x, y, threshold)).any()
        sure, near, compared = P.alike(t, x, y, threshold)
        assert (sure | near).tolist() == good.tolist() and good.sum() <= compared


@pytest.mark.parametrize("cell_lists", [3, 10, 4096])
@pytest.mark.parametrize("siblings", [False, True])
def test_blocks(spark, cell_lists, siblings):
    rng = random.Random(cell_lists)
    some = [s for s in texts(3, 40) if s]

    def sided(n):
        rows = {}
        for i in range(n):
            block = rng.choice(["hot", "hot", "b1", "b2", f"only {n}"])
            s = rng.choice(some)
            rows[block, i % 25] = rng.choice([[s], [s.replace(" ", ""), s], [s, rng.choice(some)], []])
        return rows

    left, right = sided(60), sided(70)
    frame = lambda rows: spark.createDataFrame([(*k, v) for k, v in rows.items()], "block string, id long, texts array<string>").repartition(3)
    got = [tuple(r) for r in alike_in_blocks(frame(left), frame(right), 0.85, siblings, cell_lists).collect()]

    def match(a, b):
        if siblings:
            return plain.titles_match(a, b, 0.85)
        return any(v == w or plain.significant_of(v, w) or plain.token_aware_of(v, w, 0.85) for v in a for w in b)

    want = {(b, i, j) for (b, i), v in left.items() for (c, j), w in right.items() if b == c and match(v, w)}
    assert set(got) == want and len(got) == len(want)


def test_a_hot_block_is_dealt_evenly(spark):
    """Half of all titles being one leaves no cell far above the others."""
    many = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "intro").otherwise(F.concat(F.lit("t"), F.col("id") % 40)).alias("block"), "id", F.array(F.col("id").cast("string")).alias("texts"))
    sizes = [r["count"] for r in dealt(many, many, 100).groupBy("block", "part", "chunk").count().collect()]
    assert len(sizes) == 20 * 20 + 20 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]


def test_few_pairs_are_compared():
    """Of titles of one artist, those compared by letters are at most five times those that match."""
    rng = random.Random(5)
    words = ["night", "call", "ocean", "plastic", "beach", "winter", "garden", "silver", "river", "dream", "fire", "stone", "golden", "hour", "paper", "moon"]
    title = lambda: " ".join(rng.sample(words, rng.randint(1, 3)))
    songs = [title() for _ in range(400)]
    tracks = [rng.choice(songs)[: rng.randint(-2, 0) or None] for _ in range(200)]
    lists = pa.array([[s.replace(" ", ""), s] if " " in s else [s] for s in tracks + songs])
    side = np.repeat([0, 1], [200, 400])
    compared, found = alike_lists(np.zeros(600, np.int64), side, lists, 0.85, True)
    assert 0 < compared <= 5 * sum(len(left) for left, _ in found)


def test_siblings():
    assert plain.not_siblings(["thedeal", "the deal", "x"]) == ["the deal", "x"]


def test_few_at_a_time(monkeypatch):
    """Whatever is taken at a time, each pair of lists comes once."""
    lists = pa.array([["a b", "ab"], ["a b"], ["ab", "a c"]] * 9)
    side, cell = np.repeat([0, 1, 0], 9), np.zeros(27, np.int64)
    pairs = lambda: [p for a, b in alike_lists(cell, side, lists, 0.85, False)[1] for p in zip(a.tolist(), b.tolist())]
    want = pairs()
    monkeypatch.setattr(B, "LOAD_PAIRS", 2)
    assert sorted(pairs()) == sorted(want) and len(set(want)) == len(want) > 9
