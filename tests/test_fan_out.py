"""Ids are fanned out last: no table or shuffle has a row for each pair of a track and a song."""

import pytest

from linkwright.operators import linkage as L


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that the job writes on its way."""
    rows, plain = [], L.materialize

    def counted(df, *more):
        out = plain(df, *more)
        rows.append(out.count())
        return out

    monkeypatch.setattr(L, "materialize", counted)
    return rows


def copies(spark, n_tracks, n_songs):
    """Tracks of one song, and copies of it."""
    t = spark.createDataFrame([(f"t{i}", "Kavinsky", "Nightcall") for i in range(n_tracks)], "id string, artist string, title string")
    s = spark.createDataFrame([(i, "Nightcall", "Kavinsky", "") for i in range(n_songs)], "map_id bigint, song_name string, song_author string, level_author string")
    return t, s


def test_scores_are_of_keys(spark, written):
    """Scores used to meet the matches of all ids, which were written for it."""
    t, s = copies(spark, 40, 50)
    got = L.score_matches(t, s).collect()
    assert {(r.track_id, r.map_id) for r in got} == {(f"t{i}", j) for i in range(40) for j in range(50)}
    assert len(got) == 2000 and {r.score for r in got} == {1.0}
    assert max(written) <= 90


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_lists_of_songs(spark, monkeypatch, most):
    """Lists are cut, and lose no id, null neither."""
    monkeypatch.setattr(L, "FAN_SONGS", most)
    songs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 9), ("b", None), ("c", 7)], "mkey string, map_id bigint")
    lists = L.in_lists(songs, "mkey").collect()
    assert max(len(r.map_ids) for r in lists) <= most
    tracks = spark.createDataFrame([("t1", "x"), ("t2", "x"), ("t3", "y"), ("t4", "z")], "id string, tkey string")
    found = spark.createDataFrame([("x", "a", None, 0.5), ("x", "a", None, 0.5), ("x", "a", 2, 0.5), ("x", "b", None, 0.9), ("y", "a", 1, 0.7), ("y", "a", 3, 0.7)], "tkey string, mkey string, map_id bigint, score double")
    got = [(r.id, r.map_id, r.score) for r in L.fanned_out(found, tracks, songs).collect()]
    want = [(t, k, 0.5) for t in ("t1", "t2") for k in (1, 2, 3, 4)] + [(t, k, 0.9) for t in ("t1", "t2") for k in (9, None)] + [("t3", 1, 0.7), ("t3", 3, 0.7)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_dealt_out_finer(spark):
    """What becomes rows is dealt out in more tasks than its size asks for."""
    tracks = spark.createDataFrame([("t1", "x")], "id string, tkey string")
    songs = spark.createDataFrame([("a", 1)], "mkey string, map_id bigint")
    found = spark.createDataFrame([("x", "a", None)], "tkey string, mkey string, map_id bigint")
    plan = L.fanned_out(found, tracks, songs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [tkey") == 2 and f", {8 * int(spark.conf.get('spark.sql.shuffle.partitions'))}" in plan
