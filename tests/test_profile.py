"""Matches are counted by keys."""

from pyspark.sql import functions as F

from linkwright.operators import linkage as L
from linkwright.plans import queries as Q
from test_fan_out import copies


def test_a_profile_counts_by_keys(spark, monkeypatch):
    t, s = copies(spark, 40, 50)
    monkeypatch.setattr(Q, "tracks", lambda spark, d: t)
    monkeypatch.setattr(Q, "songs", lambda spark, d: s)
    monkeypatch.setattr(L, "fanned_out", None)
    row = Q.QUERIES["a13_size_profile"](spark, "").first()
    assert (row.artist_variants, row.title_variants, row.matched_tracks, row.pairs) == (1, 1, 40, 2000)


def test_totals_are_those_of_the_rows(spark):
    tracks = spark.createDataFrame([("t1", "x"), ("t2", "x"), ("t3", "y"), ("t4", "z"), ("t4", "x")], "id string, tkey string")
    songs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9), ("b", None), ("c", 7)], "mkey string, map_id bigint")
    found = spark.createDataFrame([("x", "a", None), ("x", "a", 2), ("x", "b", None), ("y", "a", 1), ("z", "c", 7)], "tkey string, mkey string, map_id bigint")
    rows = L.fanned_out(found, tracks, songs)
    want = rows.agg(F.count_distinct("id").alias("matched_tracks"), F.count(F.lit(1)).alias("pairs")).first()
    assert L.match_totals(found, tracks, songs).first() == want
    assert tuple(L.match_totals(found.limit(0), tracks, songs).first()) == (0, 0)
