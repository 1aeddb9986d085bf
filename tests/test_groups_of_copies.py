"""Copies of a track cost a group no more scores."""

from linkwright.plans import queries as Q
from test_fan_out import copies, written  # noqa: F401


def test_groups_score_one_track_of_each_key(spark, monkeypatch, written):  # noqa: F811
    t, s = copies(spark, 40, 50)
    monkeypatch.setattr(Q, "tracks", lambda spark, d: t)
    monkeypatch.setattr(Q, "songs", lambda spark, d: s)
    got = Q.QUERIES["k09_group_results"](spark, "").collect()
    assert [(r.artist, r.title, r.n_instances, r.map_ids) for r in got] == [("Kavinsky", "Nightcall", 40, ",".join(map(str, range(50))))]
    assert max(written) <= 90
