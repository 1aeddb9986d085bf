"""Pages from one pass, pages that go on from a row, and groups without lists."""

import random

import pytest
from pyspark.sql import functions as F

from linkwright.operators import catalog as cat
from linkwright.operators import results as res
from linkwright.operators.catalog import Filters, Query


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(4)
    some = lambda *v: rng.choice([None, *v])
    rows = [(k, some(1, 2, 3), some(0.5, 0.25), some(100.0, 120.0), some("b", "B", "a", "ä"), some("x", "Y"), some("", "m"), some(60, 90), some(1, 5), some(0, 3)) for k in range(60)]
    songs = spark.createDataFrame(rows, "map_id long, upload_time long, rating double, bpm double, song_name string, song_author string, level_author string, duration int, upvotes int, ranked_states long").repartition(3)
    children = spark.createDataFrame([(rng.randrange(80), some(1.0, 2.5, 9.0), rng.randrange(5)) for _ in range(90)], "song_map_id long, stars_ss double, difficulty int")
    return songs, children


@pytest.mark.parametrize("key", cat.SORT_KEYS)
def test_pages_that_go_on_are_the_pages_by_number(spark, catalog, key):
    songs, children = catalog
    for up in (True, False):
        want = [r.map_id for r in cat.query_catalog(songs, children, Query(sort=key, ascending=up, page_size=500))[0].collect()]
        got, last = [], None
        while page := (rows := cat.catalog_after(songs, children, Query(sort=key, ascending=up, page_size=23), last)).collect():
            got += [r.map_id for r in page]
            last = cat.end_of(rows, "map_id")
        assert got == want and len(got) == 60


@pytest.mark.parametrize("key", cat.LIBRARY_SORT_KEYS)
def test_library_pages_that_go_on(spark, key):
    rng = random.Random(6)
    some = lambda *v: rng.choice([None, *v])
    rows = [(f"t{k:02}", some("a", "B", "b"), some("x", ""), some("l", "m"), some(1, 2), some(1990, 2000), 5, "") for k in range(40)]
    tracks = spark.createDataFrame(rows, "id string, title string, artist string, album string, duration int, year int, fetched_at long, normalized_key string").repartition(3)
    for up in (True, False):
        want = [r.id for r in cat.query_tracks(tracks, "", key, up, 1, 100)[0].collect()]
        got, last = [], None
        while page := (rows := cat.library_after(tracks, last, "", key, up, 17)).collect():
            got += [r.id for r in page]
            last = cat.end_of(rows, "id")
        assert got == want and len(got) == 40


def test_a_later_page_sorts_no_more_than_a_page(spark, catalog):
    songs, children = catalog
    page = cat.catalog_after(songs, children, Query(sort="bpm", page_size=5), (110.0, 7))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_page_and_total_from_one_pass(spark, catalog):
    songs, children = catalog
    for q in (Query(), Query(Filters(bpm_min=110.0), sort="stars", page=2, page_size=7), Query(Filters(difficulties=(2,)), page=9), Query(Filters(bpm_min=1e9))):
        rows, total = cat.query_catalog(songs, children, q)
        page, seen = cat.catalog_page(songs, children, q)
        assert [r.map_id for r in page.collect()] == [r.map_id for r in rows.collect()] and seen.get["total"] == total.first().total
        both = cat.with_total(*cat.catalog_page(songs, children, q))
        assert both.count() == rows.count() and all(r.total == total.first().total for r in both.collect())


    plan = cat.catalog_page(songs, children, Query())[0]._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" in plan and plan.count("Scan ExistingRDD") == 1


def test_a_group_of_a_million_instances(spark):
    n = 1_000_000
    tracks = spark.range(n).select(F.format_string("%07d", "id").alias("id"), F.lit("Artist").alias("artist"), F.when(F.col("id") % 2 == 0, "Title").otherwise("TITLE").alias("title"))
    scored = tracks.select(F.col("id").alias("track_id"), (F.xxhash64("id") % 50).alias("map_id"), F.lit(0.9).alias("score"))
    row = res.group_results(scored, tracks).collect()
    assert [(r.n_instances, r.primary_id, r.title) for r in row] == [(n, "0000001", "TITLE")] and row[0].n_matches == scored.select("map_id").distinct().count()
    each = res.group_instances(scored, tracks)
    assert tuple(each.agg(F.count("id"), F.max("position")).first()) == (n, n) and each.where("position = 500001").first().id == "0000000"
