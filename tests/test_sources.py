import json

import pytest
from pyspark.sql import functions as F

from linkwright.functions import columns as C
from linkwright.operators import catalog as cat
from linkwright.schemas import SNAPSHOT
from linkwright.sources import library, sinks, snapshots, store


def song(map_id, uploader=None, children=()):
    return (120.5, 50, 50, 1700000000, map_id, 180, "Song", "Artist", "Mapper", uploader, list(children), 1700000001, 1, 5, 1)


def snapshot(spark, version=3, blob=b"\xaa" * 20 + b"\xbb" * 20, songs=None):
    songs = [song(31, None, [(1, 4, 700, 650, 1600, 5, 300, 50, 4)]), song(32, "")] if songs is None else songs
    return spark.createDataFrame([(version, 1700000002, blob, songs, ["a", "b", "c"])], SNAPSHOT)


def test_flatten(spark):
    s = snapshots.flatten_songs(snapshots.validate_snapshots(snapshot(spark))).orderBy("map_id").collect()
    assert [(r.key, r.hash, r.rating, r.uploader_name, r.bpm) for r in s] == [("1f", "aa" * 20, 0.5, "Mapper", 120.5), ("20", "bb" * 20, 0.5, "", 120.5)]
    d = snapshots.flatten_difficulties(snapshot(spark)).collect()
    assert [(r.song_map_id, r.stars_ss, r.stars_bl, r.njs, r.mods) for r in d] == [(31, 7.0, 6.5, 16.0, 4)]


@pytest.mark.parametrize("version,blob,bad", [(3, b"\0" * 40, False), (3, b"\0" * 41, False), (3, b"\0" * 39, True), (2, b"\0" * 40, True), (None, b"\0" * 40, True)])
def test_validation(spark, version, blob, bad):
    s = snapshot(spark, version, blob)
    good, wrong = snapshots.split_snapshots(s)
    assert (good.count(), wrong.count()) == ((0, 1) if bad else (1, 0))
    if bad:
        with pytest.raises(Exception, match="format version|hash blob"):
            snapshots.validate_snapshots(s).collect()


def test_tags_and_ratings(spark):
    df = spark.createDataFrame([(0b101, 0, 0), (0b1010, 3, 1), (-(2**63), 1, 0)], "tags long, up int, down int")
    names = F.array(F.lit("x"), F.lit(""), F.lit("z"), F.lit("w"))
    got = df.select(C.tag_names(F.col("tags"), names).alias("t"), C.rating(F.col("up"), F.col("down")).alias("r")).collect()
    assert [r.t for r in got] == [["x", "z"], ["w"], []] and got[0].r == 0.0
    assert df.select(C.tag_names(F.col("tags"), F.array().cast("array<string>")).alias("t")).first().t == []
    assert df.select(C.characteristic_label(F.lit(1)).alias("a"), C.difficulty_label(F.lit(9)).alias("b")).first()[:] == ("Standard", "Unknown(9)")


def test_pages(spark, tmp_path):
    body = lambda **k: {"subsonic-response": {"version": "1.16.1", **k}}
    full = body(status="ok", searchResult3={"song": [{"id": "1", "title": "Song One", "isDir": False, "starred": "2024"}, {"id": "2", "title": "Eple", "artist": "Röyksopp", "isDir": False}]})
    each = [full, body(status="ok", searchResult3={}), body(status="ok"), body(status="failed", error={"code": 40, "message": "Wrong username or password"}), body(status="failed")]
    for k, page in enumerate(each):
        (tmp_path / f"{k}.json").write_text(json.dumps(page, indent=1))
    ok, failed = library.split_ok_failed(library.read_pages(spark, str(tmp_path)))
    assert sorted(str(r.error) for r in failed.collect()) == ["None", "Wrong username or password (code 40)"]
    t = library.project_tracks(library.tracks_of(ok), F.lit(5)).orderBy("id").collect()
    assert [(r.id, r.artist, r.normalized_key, r.album, r.fetched_at) for r in t] == [("1", "", "songone", None, 5), ("2", "Röyksopp", "royksoppeple", None, 5)]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, title string")
    assert sinks.write_tracks(t, str(tmp_path)).first().tracks == 2
    sinks.clear_tracks(spark, str(tmp_path))
    again = sinks.read_tracks(spark, str(tmp_path))
    assert again.count() == 0 and again.columns == t.columns


def test_a_failed_replacement_leaves_the_old_snapshot_whole(spark, tmp_path):
    at = str(tmp_path)
    songs = lambda n: spark.createDataFrame([(k, f"{n} {k}") for k in range(n)], "map_id long, song_name string")
    children = lambda n: spark.createDataFrame([(k % n, float(k)) for k in range(3 * n)], "song_map_id long, stars_ss double")
    meta = lambda n: spark.createDataFrame([("scrape_ended_time", str(n))], "key string, value string")
    with pytest.raises(ValueError):
        sinks.read_catalog(spark, at)
    sinks.write_catalog(songs(5), children(5), meta(5), at, 4)
    held = sinks.read_catalog(spark, at)
    bad = children(7).withColumn("stars_ss", F.raise_error(F.lit("lost between the tables")).cast("double"))
    for broken in (lambda: sinks.write_catalog(songs(7), bad, meta(7), at, 4), lambda: sinks.write_catalog(songs(7), children(7), meta(7).withColumn("value", F.raise_error(F.lit("lost"))), at, 4)):
        with pytest.raises(Exception, match="lost"):
            broken()
        now = sinks.read_catalog(spark, at)
        assert now["songs"].count() == 5 and now["difficulties"].count() == 15 and now["meta"].first().value == "5"
    assert tuple(sinks.write_catalog(songs(7), children(7), meta(7), at, 4).first()) == (7, 21)
    # who has begun to read a version goes on with it
    assert held["songs"].count() == 5 and held["difficulties"].count() == 15
    assert sinks.read_catalog(spark, at)["meta"].first().value == "7"


def test_old_versions_expire(spark, tmp_path):
    at = str(tmp_path)
    for n in (1, 2, 3):
        store.publish(spark, at, {"t": spark.range(n), "u": spark.range(n)}, {"u": "id"}, 2)
    assert store.expire(spark, at, 2) == 1 and len(list((tmp_path / "versions").iterdir())) == 2
    assert {k: df.count() for k, df in store.read(spark, at).items()} == {"t": 3, "u": 3} and store.current(spark, at)[0] == 3
    assert store.publish(spark, at, {"t": spark.range(9)}) == 4 and store.read(spark, at)["t"].count() == 9
    with pytest.raises(ValueError):
        store.expire(spark, at, 0)


def test_a_new_session_knows_the_buckets(spark, tmp_path):
    at = str(tmp_path)
    songs = spark.range(40).select(F.col("id").alias("map_id"))
    children = spark.range(120).select((F.col("id") % 30).alias("song_map_id"), F.col("id").cast("double").alias("stars_ss"))
    sinks.write_catalog(songs, children, spark.createDataFrame([("k", "v")], "key string, value string"), at, 4)
    for t in spark.catalog.listTables():
        if t.name.startswith("linkwright_"):
            spark.sql(f"DROP TABLE {t.name}")
    tables = sinks.read_catalog(spark, at)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = cat.with_stars(tables["songs"], tables["difficulties"])
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" in plan
        page = cat.query_catalog(tables["songs"], tables["difficulties"], cat.Query(cat.Filters(stars_min=50.0), sort="stars"))[0]
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and plan.count("SortMergeJoin") == 2 and page.count() == 30
        assert both.where("stars IS NULL").count() == 10 and both.agg(F.max("stars")).first()[0] == 119.0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_details(spark):
    rows = [(1, "a%b", "X"), (2, "a_b", "Ä"), (3, "AXB", "ä"), (4, "back\\slash", None)]
    df = spark.createDataFrame(rows, "id int, title string, artist string")
    hit = lambda q: [r.id for r in df.where(cat.matches_any(("title", "artist"), q)).orderBy("id").collect()]
    assert hit("a_b") == [1, 2, 3] and hit(" A%B ") == [1, 2, 3, 4][:3] and hit("\\") == [4] and hit("ä") == [3]
    songs = spark.createDataFrame([(1, -(2**63)), (2, 1)], "map_id long, tags long")
    none = spark.createDataFrame([], "song_map_id long, bombs int")
    assert [r.map_id for r in cat.catalog_filter(songs, none, cat.Filters(tags=(63,))).collect()] == [1]
    assert cat.catalog_filter(songs, none, cat.Filters(min_bombs=0)).count() == 0 and cat.catalog_filter(songs, none, cat.Filters()).count() == 2
    with pytest.raises(ValueError):
        cat.paged(songs, [F.col("tags")], F.col("map_id"), True, 1, -1)
