"""The cap on the songs of an artist that trigrams find."""

import random

import pytest

from linkwright.operators import linkage as L


@pytest.mark.parametrize("most", [1, 2, 5, 100])
def test_first_songs_of_an_artist(spark, most):
    """The cap takes an artist's first songs, of which no variant brings more than that."""
    rng = random.Random(most)
    songs = [(k, rng.sample("abcd", rng.randint(0, 3))) for k in range(60)]
    accepted = [(s, v, s == "exact") for s, v in (("one", "a"), ("one", "b"), ("two", "b"), ("two", "c"), ("two", "d"), ("exact", "a"), ("exact", "d"))]
    met = lambda sig: sorted(k for k, vs in songs if any((sig, v, sig == "exact") in accepted for v in vs))
    want = {(sig, k) for sig in ("one", "two") for k in met(sig)[:most]} | {("exact", k) for k in met("exact")}
    out = L.artist_candidates(spark.createDataFrame(accepted, "sig string, variant string, exact boolean"), spark.createDataFrame(songs, "map_id bigint, artist array<string>"), most)
    got = [(r.sig, r.map_id) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(variant" in plan and "windowspecdefinition(sig" in plan
