"""Kept indexes give what the jobs without them give."""

import random

from pyspark.sql import functions as F

from linkwright.operators import catalog as cat
from linkwright.operators import linkage as link
from linkwright.operators import search_index as si
from linkwright.plans.fixtures import view
from linkwright.sources import sinks, store


def test_search_on_fifty_patterns(spark, tmp_path):
    rng = random.Random(8)
    some = ["night call", "Night_Call", "100% pure", "back\\slash", "back\\\\slash", "äbc Äbc", "a_b%c", "xyz", "", "ab", "red widget", "RED-widget", "%%%", "___", "nightcall"]
    rows = [(k, rng.choice([None, *some]), rng.choice(some) + rng.choice(["", " x", "%"])) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, title string, artist string").repartition(3)
    columns = ("title", "artist")
    store.publish(spark, str(tmp_path), {"postings": si.search_postings(df, "id", columns)}, {"postings": "trigram"}, 4)
    postings = store.read(spark, str(tmp_path))["postings"]
    pieces = ["night", "NIGHT", "call", "%", "_", "\\", "\\\\", "red", "-", " ", "ab", "äb", "Ä", "x", "100", "pure", "no such", "widget", "slash"]
    patterns = ["", "%", "\\", "a_b%c", "100%", "back\\slash", "ab", "night_call", " Red_Widget "] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(41)]
    read = 0
    for pattern in patterns:
        want = {r.id for r in (df.where(cat.matches_any(columns, pattern)) if pattern.strip() else df).collect()}
        assert {r.id for r in si.indexed_search(df, postings, pattern, "id", columns).collect()} == want, pattern
        ids = si.candidates(postings, pattern)
        n = 120 if ids is None else ids.count()
        assert n >= len(want)
        read += n
    assert read < 50 * 120 // 2  # more than half of all rows are not read


def test_matching_on_a_kept_index(spark, sf_dir, tmp_path):
    songs, tracks = view(spark, sf_dir, "songs"), view(spark, sf_dir, "tracks")
    meta = spark.createDataFrame([("k", "v")], "key string, value string")
    sinks.write_catalog(songs, view(spark, sf_dir, "difficulties"), meta, str(tmp_path), 4, link.match_index(songs), link.INDEX_KEYS)
    kept = sinks.read_catalog(spark, str(tmp_path))
    some = tracks.where(F.col("id").cast("long") % 11 == 0)
    got = link.match_indexed(some, kept)
    want = link.match_tracks(some, songs)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == want.count() > 0
    files = {f.split("/versions/")[1].split("/")[1] for name in ("match_songs", "match_keys", "match_variants", "match_postings", "match_frequency") for f in kept[name].inputFiles()}
    assert files == set(link.INDEX_KEYS)
    assert not {"song_name", "song_author"} & {c for name in link.INDEX_KEYS for c in kept[name].columns}
