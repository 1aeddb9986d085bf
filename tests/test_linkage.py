"""Linkage against nested loops over all pairs, and the cases that matter."""

import random

import pytest

from linkwright.functions import textkeys as T
from linkwright.operators import linkage as L

import plain_similarity as S


def track_key(artist, title):
    return T.artist_variants(artist), T.field_variants(title), T.remix_tags(title)


def song_key(name, author, mapper):
    artist, title = T.artist_variants(author) + T.artist_variants(mapper), T.field_variants(name)
    at = name.find(" - ")
    if at > 0:
        artist += T.artist_variants(name[:at])
        title = title + T.field_variants(name[at + 3 :])
    return list(dict.fromkeys(artist)), list(dict.fromkeys(title)), T.remix_tags(name)


def compatible(t, m):
    if not t[2] and not m[2]:
        return True
    if any(x in y or y in x for x in t[2] for y in m[2]):
        return True
    if not m[2]:
        return any(tag in v for tag in t[2] for v in m[0] + m[1])
    if not t[2]:
        return any(tag in v for tag in m[2] for v in t[0] + t[1])
    return False


def grams(s):
    return {s[i : i + 3] for i in range(len(s) - 2)}


def resembles(own, v, threshold):
    return any(o == v or S.significant_of(o, v) or S.token_aware_of(o, v, threshold) for o in own)


def brute(tracks, songs, threshold):
    keys = {i: song_key(*s) for i, s in songs.items()}
    known = {v for k in keys.values() for v in k[0]}
    out = set()
    for tid, (artist, title) in tracks.items():
        t = track_key(artist, title)
        accepted = set(t[0]) & known
        if not accepted:
            voted = {v for v in known for o in t[0] if grams(o) and len(grams(o) & grams(v)) >= max(2, -(-len(grams(o)) // 4))}
            accepted = {v for v in voted if resembles(t[0], v, threshold)}
        for mid, m in keys.items():
            if not compatible(t, m):
                continue
            by_title = set(t[1]) & set(m[1]) and t[0] and (set(m[0]) & accepted or any(resembles(t[0], v, threshold) for v in m[0]))
            by_artist = set(m[0]) & accepted and S.titles_match(t[1], m[1], threshold)
            if by_title or by_artist:
                out.add((tid, mid))
    return out


def frames(spark, tracks, songs):
    t = spark.createDataFrame([(i, a, x) for i, (a, x) in tracks.items()], "id string, artist string, title string")
    s = spark.createDataFrame([(i, *x) for i, x in songs.items()], "map_id bigint, song_name string, song_author string, level_author string")
    return t, s


CASES = [
    (("Camellia", "Body F10ating10"), ("Body F10ating10", "Camellia", ""), 0.8, True),
    (("Camellia", "Body"), ("Body F10ating10", "Camellia", ""), 0.8, True),
    (("Completely Different Artist", "Body F10ating10"), ("Body F10ating10", "Camellia", ""), 0.8, False),
    (("All India Radio", "Let Me Remain"), ("Pumpernickel", "Allison and drameko", ""), 0.8, False),
    (("Benny Benassi", "Cinema (Congorock remix)"), ("Cinema", "Benny Benassi", ""), 0.8, False),
    (("Benny Benassi", "Cinema (Congorock remix)"), ("Cinema (Skrillex Remix)", "Benny Benassi", ""), 0.8, False),
    (("Benny Benassi", "Cinema (Skrillex radio edit)"), ("Cinema - Skrillex Remix", "Benny Benassi", ""), 0.8, True),
    (("Benny Benassi", "Cinema"), ("Cinema (Skrillex Remix)", "Benny Benassi", ""), 0.8, False),
    (("Benny Benassi", "Cinema (radio edit)"), ("Cinema", "Benny Benassi", ""), 0.8, True),
    (("Camellia feat. Kasane Teto", "Play-With-Fire (Teto Cover)"), ("Play-With-Fire", "Camellia feat. Kasane Teto", "Mapper"), 0.8, True),
    (("Kavinsky", "Nightcall"), ("Nightcal", "Kavinksy", ""), 0.85, True),
]


def test_cases(spark):
    for threshold in (0.8, 0.85):
        chosen = [c for c in CASES if c[2] == threshold]
        for k, (t, m, _, expected) in enumerate(chosen):
            assert bool(brute({"t": t}, {k: m}, threshold)) == expected, (t, m)
    for t, m, threshold, expected in (CASES[0], CASES[5], CASES[10]):
        got = L.match_tracks(*frames(spark, {"t": t}, {1: m}), threshold).collect()
        assert bool(got) == expected


def test_exact_artist_anywhere_switches_trigrams_off(spark):
    tracks, songs = {"t": ("Kavinsky", "Nightcall")}, {1: ("Nightcal", "Kavinksy", ""), 2: ("Other", "Kavinsky", "")}
    assert L.match_tracks(*frames(spark, tracks, songs), 0.85).count() == 0
    assert brute(tracks, songs, 0.85) == set()


@pytest.mark.parametrize("seed,threshold", [(1, 0.85), (2, 0.7), (3, 0.6)])
def test_against_all_pairs(spark, seed, threshold):
    rng = random.Random(seed)
    artists = ["Camellia", "Kasane Teto", "The Deal", "Röyksopp", "AC/DC", "Benny Benassi", "More Than", "Kavinsky", "x"]
    titles = ["Nightcall", "The Deal", "The Pain", "Cinema", "Body F10ating10", "Home", "Plastic Beach", "Welcome to the Plastic Beach", "Eple"]
    tails = ["", "", " (Congorock remix)", " - Skrillex Remix", " (Remaster)", " Theme", " [radio edit]"]

    def bent(s):
        if len(s) > 4 and rng.random() < 0.4:
            k = rng.randrange(len(s) - 1)
            s = s[:k] + s[k + 1] + s[k] + s[k + 2 :] if rng.random() < 0.5 else s[:k] + s[k + 1 :]
        return s

    credit = lambda: bent(rng.choice(artists)) + rng.choice(["", "", " feat. " + rng.choice(artists), " (mapped by Zed)", " | beatmap by Kay"])
    tracks = {f"t{i}": (credit(), bent(rng.choice(titles)) + rng.choice(tails)) for i in range(60)}
    songs = {i: ((f"{rng.choice(artists)} - " if rng.random() < 0.2 else "") + bent(rng.choice(titles)) + rng.choice(tails), credit() if rng.random() < 0.8 else "", rng.choice([credit(), "Mapper"])) for i in range(80)}
    expected = brute(tracks, songs, threshold)
    t, s = frames(spark, tracks, songs)
    got = L.score_matches(t.repartition(3), s.repartition(5), threshold).collect()
    assert {(r.track_id, r.map_id) for r in got} == expected and len(got) == len(expected)
    for r in got:
        a, b = track_key(*tracks[r.track_id]), song_key(*songs[r.map_id])
        assert r.score == pytest.approx(S.score_of(a[1], a[0], b[1], b[0]))


def test_empty_inputs_and_nulls(spark):
    t, s = frames(spark, {}, {})
    assert L.match_tracks(t, s).count() == 0
    t = spark.createDataFrame([("a", None, None)], "id string, artist string, title string")
    s = spark.createDataFrame([(1, None, None, None), (2, "", "", "")], "map_id bigint, song_name string, song_author string, level_author string")
    assert L.score_matches(t, s).count() == 0
