"""Normal forms: the same texts and results as the matched behaviour asks for."""

import pytest
from pyspark.sql import functions as F

from linkwright.functions import textkeys as T

VARIANTS = [
    ("Camellia", ["camellia"]),
    ("Body F10ating10", ["bodyf10ating10", "body f10ating10"]),
    ("Röyksopp", ["royksopp"]),
    ("AC/DC", ["acdc", "ac dc"]),
    ("", []),
    ("!!!", []),
    ("Don’t Stop—Me", ["dontstopme", "don t stop me"]),
    ("ＦＵＬＬ　Ｗｉｄｔｈ", ["fullwidth", "full width"]),
    ("ﬁne ①", ["fine1", "fine 1"]),
]
PARENS = [
    ("Song (Remaster)", "Song"),
    ("Song (Remaster (2023))", "Song"),
    ("Song (A) (B)", "Song"),
    ("(Intro) Song", "(Intro) Song"),
    ("(All)", "(All)"),
    ("Song (open", "Song (open"),
    ("Song close)", "Song close)"),
    ("Song (A)  ", "Song"),
    ("", ""),
]
FILLERS = [("Album Deluxe Edition", "Album"), ("editionary", "editionary"), ("Rip and Tear", "Rip Tear"), ("[Remastered] Song", "Song"), ("Boss BGM", "Boss"), ("", "")]
TAGS = [
    ("Cinema (Congorock remix)", ["congorock"]),
    ("Cinema - Skrillex Remix", ["skrillex"]),
    ("Cinema (radio edit)", []),
    ("Cinema", []),
    ("Song [DJ Foo bootleg 2020]", ["foo"]),
    (" - Bar Remix", ["bar"]),
    ("A (x) (B mix) - Krayysh flip", ["krayysh"]),
]
CREDITS = [
    ("Camellia feat. nanahira", ["Camellia feat. nanahira", "Camellia", "nanahira"]),
    ("gmtn (mapped by Roffle)", ["gmtn"]),
    ("Shiggy Jr. | beatmap by kieve", ["Shiggy Jr. | beatmap by kieve", "Shiggy Jr."]),
    ("A, B & C", ["A, B & C", "A", "B", "C"]),
    ("Edit by Barudaq", []),
    ("", []),
    ("x//y;z", ["x//y;z", "x", "y", "z"]),
]


@pytest.mark.parametrize("text,expected", VARIANTS)
def test_variants(text, expected):
    assert T.variants(text) == expected


def test_variants_native(spark):
    df = spark.createDataFrame([(t,) for t, _ in VARIANTS], "s string")
    got = {r.s: r.v for r in df.select("s", T.normalize_variants(F.col("s")).alias("v")).collect()}
    assert got == dict(VARIANTS)


@pytest.mark.parametrize("text,expected", PARENS)
def test_trailing_parens(text, expected):
    assert T.strip_trailing_parens(text) == expected


@pytest.mark.parametrize("text,expected", FILLERS)
def test_filler_words(text, expected):
    assert T.without_filler(text) == expected


def test_filler_words_native(spark):
    df = spark.createDataFrame([(t,) for t, _ in FILLERS], "s string")
    assert {r.s: r.v for r in df.select("s", T.strip_filler_words(F.col("s")).alias("v")).collect()} == dict(FILLERS)


@pytest.mark.parametrize("text,expected", TAGS)
def test_remix_tags(text, expected):
    assert T.remix_tags(text) == expected


@pytest.mark.parametrize("text,expected", CREDITS)
def test_split_credit(text, expected):
    assert T.split_credit(text) == expected


def test_keys_and_trigrams(spark):
    df = spark.createDataFrame([("Camellia", "Body F10ating10"), ("Röyksopp", "Eple"), ("AC/DC", "Back in Black"), ("", "")], "a string, t string")
    keys = [r.k for r in df.select(T.normalized_key(F.col("a"), F.col("t")).alias("k")).collect()]
    assert keys == ["camelliabodyf10ating10", "royksoppeple", "acdcbackinblack", ""]
    tri = spark.createDataFrame([("abcd",), ("ab",), ("",), ("aaaa",)], "s string").select(T.trigrams(F.col("s")).alias("t"), T.unique_trigrams(F.col("s")).alias("u")).collect()
    assert [(r.t, r.u) for r in tri] == [(["abc", "bcd"], ["abc", "bcd"]), (["ab"], []), ([""], []), (["aaa", "aaa"], ["aaa"])]
