"""Fuzzy record linkage of tracks and songs: keys, blocking, verification, scores.

Work is done on distinct keys: equal (artist variants, title variants, tags) are matched once and fanned out
to ids at the end. Blocking is by equality of artist variants, by shared trigrams for artists without any
equal variant anywhere, and by equality of title variants. What no expression can say runs in small helpers
on distinct pairs that passed the native tests.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions import similarity as S
from linkwright.functions.textkeys import signature, text_keys, unique_trigrams
from linkwright.operators.blocks import alike_in_blocks
from linkwright.storage import materialize

THRESHOLD, MAX_FUZZY_SONGS = 0.85, 2000
SHARED_LEAST, SHARED_SHARE = 2, 0.25
#: Songs of a key that one row holds, at most, while ids are fanned out.
FAN_SONGS = 1024
#: Times as many tasks as other shuffles have.
FAN_TASKS = 8


# ---- keys ----


def _looked_up(rows: DataFrame, keys: DataFrame, text: str, **fields: str) -> DataFrame:
    picked = keys.select(F.col("text").alias("_text"), *(F.col(f).alias(name) for name, f in fields.items()))
    return rows.join(picked, F.col(text) == F.col("_text"), "left").drop("_text")


def _id(*texts: Column) -> Column:
    """Sixteen bytes that stand for long keys."""
    return F.unhex(F.md5(F.concat_ws("\n", *texts)))


def _key(who: str, what: str) -> Column:
    return F.unhex(F.md5(F.concat(who, what)))


def keyed(rows: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """(id, artist, title, tags, who, what, key): ids of the artist part, of the title part, and of both."""
    none = F.array().cast("array<string>")
    cols = {c: F.coalesce(F.col(c), none) for c in ("artist", "title", "tags")}
    out = rows.select(id_col, *(v.alias(c) for c, v in cols.items()))
    out = out.withColumn("who", _id(signature(F.col("artist")))).withColumn("what", _id(signature(F.col("title")), signature(F.col("tags"))))
    return out.withColumn(prefix, _key("who", "what"))


def track_keys(tracks: DataFrame) -> DataFrame:
    """(id, artist, title, tags, who, what, tkey) of tracks (id, artist, title)."""
    rows = tracks.select("id", F.col("artist").alias("_artist"), F.col("title").alias("_title"))
    keys = materialize(text_keys(rows.select(F.explode(F.array("_artist", "_title")).alias("text"))))
    rows = _looked_up(rows, keys, "_artist", artist="artist")
    return keyed(_looked_up(rows, keys, "_title", title="title", tags="tags"), "id", "tkey")


def song_keys(songs: DataFrame) -> DataFrame:
    """(map_id, artist, title, tags, who, what, mkey): both author fields, and both sides of a dash in the name."""
    dash = F.instr("song_name", " - ")
    name = F.col("song_name")
    parts = songs.select(
        "map_id",
        F.col("song_author").alias("_a"),
        F.col("level_author").alias("_l"),
        name.alias("_n"),
        F.when(dash > 1, F.substring(name, F.lit(1), dash - 1)).alias("_left"),
        F.when(dash > 1, F.substring(name, dash + 3, F.length(name))).alias("_right"),
    )
    keys = materialize(text_keys(parts.select(F.explode(F.array("_a", "_l", "_n", "_left", "_right")).alias("text"))))
    rows = _looked_up(parts, keys, "_a", a1="artist")
    rows = _looked_up(rows, keys, "_l", a2="artist")
    rows = _looked_up(rows, keys, "_n", t1="title", tags="tags")
    rows = _looked_up(rows, keys, "_left", a3="artist")
    rows = _looked_up(rows, keys, "_right", t2="title")
    union = lambda *names: F.array_distinct(F.flatten(F.array_compact(F.array(*names))))
    return keyed(rows.select("map_id", union("a1", "a2", "a3").alias("artist"), union("t1", "t2").alias("title"), "tags"), "map_id", "mkey")


def distinct_keys(keyed: DataFrame, key: str) -> DataFrame:
    return keyed.drop("id", "map_id").dropDuplicates([key])


# ---- artists ----


def signatures(track_keys_: DataFrame) -> DataFrame:
    """(sig, variants) of distinct artists that have variants."""
    return track_keys_.where(F.size("artist") > 0).select(signature(F.col("artist")).alias("sig"), F.col("artist").alias("variants")).dropDuplicates(["sig"])


def artist_variants(song_keys_: DataFrame) -> DataFrame:
    return song_keys_.select(F.explode("artist").alias("variant")).distinct()


def exact_artists(sigs: DataFrame, variants: DataFrame) -> DataFrame:
    """(sig, variant): variants that an artist and some song share."""
    return sigs.select("sig", F.explode("variants").alias("variant")).join(variants, "variant").select("sig", "variant").distinct()


def exact_artist_signatures(tracks: DataFrame, songs: DataFrame) -> DataFrame:
    return exact_artists(signatures(track_keys(tracks)), artist_variants(song_keys(songs))).select("sig").distinct()


def trigram_postings(variants: DataFrame) -> DataFrame:
    """(trigram, variant), each once."""
    return variants.select("variant", F.explode(unique_trigrams(F.col("variant"))).alias("trigram"))


def trigram_frequency(variants: DataFrame) -> DataFrame:
    return trigram_postings(variants).groupBy("trigram").agg(F.count(F.lit(1)).alias("df"))


@dataclass(frozen=True)
class ArtistIndex:
    """Song artists as blocking reads them: (variant, tri), (trigram, variant), and (trigram, df)."""

    variants: DataFrame
    postings: DataFrame
    frequency: DataFrame


def artist_index(variants: DataFrame) -> ArtistIndex:
    return ArtistIndex(variants.select("variant", unique_trigrams(F.col("variant")).alias("tri")), trigram_postings(variants), trigram_frequency(variants))


def trigram_votes(sigs: DataFrame, variants: DataFrame | ArtistIndex) -> DataFrame:
    """(sig, variant): song variants with enough of the trigrams of one of an artist's variants.

    If k of n trigrams must be shared, one of them is among the n - k + 1 rarest, so only these are looked
    up; the candidates' trigrams are then counted in full.
    """
    index = variants if isinstance(variants, ArtistIndex) else artist_index(variants)
    own = sigs.select(F.explode("variants").alias("own")).distinct().withColumn("tri", unique_trigrams(F.col("own")))
    own = own.withColumn("need", F.greatest(F.lit(SHARED_LEAST), F.ceil(F.size("tri") * SHARED_SHARE).cast("int"))).where(F.size("tri") >= F.col("need"))
    df = index.frequency.select(F.col("trigram").alias("_tri"), "df")
    each = own.select("own", "need", F.size("tri").alias("n"), F.explode("tri").alias("trigram")).join(df, F.col("trigram") == F.col("_tri"))
    rare = Window.partitionBy("own").orderBy("df", "trigram")
    # trigrams that no song has are dropped above and would be the rarest of all: ranks start after them
    absent = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("own"))
    probe = each.withColumn("rank", F.row_number().over(rare) + absent).where(F.col("rank") <= F.col("n") - F.col("need") + 1)
    met = probe.select("own", "trigram").join(index.postings, "trigram").select("own", "variant").distinct()
    full = met.join(own, "own").join(index.variants.select("variant", F.col("tri").alias("own_tri")), "variant").where(F.size(F.array_intersect("tri", "own_tri")) >= F.col("need"))
    voted = full.select("own", "variant")
    return sigs.select("sig", F.explode("variants").alias("own")).join(voted, "own").select("sig", "variant").distinct()


def pair_matches(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Of distinct (sig, variant) pairs those where one of the artist's variants equals, contains or resembles the other."""
    return pairs.join(sigs, "sig").where(S.any_alike(F.col("variants"), F.col("variant"), threshold)).select("sig", "variant")


def accepted_artists(sigs: DataFrame, variants: DataFrame | ArtistIndex, threshold: float) -> DataFrame:
    """(sig, variant, exact). An equal variant anywhere switches the trigram path off for the whole artist."""
    exact = exact_artists(sigs, variants.variants if isinstance(variants, ArtistIndex) else variants)
    rest = sigs.join(exact.select("sig").distinct(), "sig", "left_anti")
    fuzzy = pair_matches(trigram_votes(rest, variants), rest, threshold)
    return exact.withColumn("exact", F.lit(True)).unionByName(fuzzy.withColumn("exact", F.lit(False)))


def artist_candidates(accepted: DataFrame, song_keys_: DataFrame, most: int | None = MAX_FUZZY_SONGS) -> DataFrame:
    """(sig, map_id, exact): songs with an accepted variant, ``most`` at most by map_id where found by trigrams, all of them if None."""
    carried = song_keys_.select("map_id", F.explode("artist").alias("variant"))
    if most is None:
        return accepted.join(carried, "variant").select("sig", "map_id", "exact").distinct()
    exact = accepted.where("exact").join(carried, "variant").select("sig", "map_id", "exact").distinct()
    # the first songs of an artist are among the first ones of its variants
    fuzzy = accepted.where("NOT exact")
    of_variant = Window.partitionBy("variant").orderBy("map_id")
    first = carried.join(fuzzy.select("variant").distinct(), "variant", "left_semi").distinct().withColumn("_n", F.row_number().over(of_variant)).where(F.col("_n") <= most).drop("_n")
    met = fuzzy.join(first, "variant").select("sig", "map_id", "exact").distinct()
    w = Window.partitionBy("sig").orderBy("map_id")
    return exact.unionByName(met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n"))


# ---- matching ----


def title_entries(df: DataFrame, *columns: str) -> DataFrame:
    """(block, ...) of each title without its spaces. A title's variants go with and without spaces, so those that share one share it without spaces too, and no others do."""
    squeezed = F.array_distinct(F.transform("title", lambda v: F.replace(v, F.lit(" "), F.lit(""))))
    return df.select(F.explode(squeezed).alias("block"), *columns)


def exact_title_pairs(t: DataFrame, m: DataFrame) -> DataFrame:
    """(tkey, mkey) with a title variant in common."""
    # each key once for a title, so that rows of equal keys don't meet each other
    return title_entries(t.where(F.size("artist") > 0), "tkey").distinct().join(title_entries(m, "mkey").distinct(), "block").select("tkey", "mkey").distinct()


def _named(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in columns)).distinct()


def _lists(df: DataFrame, key: str, texts: str) -> DataFrame:
    """(id, texts) of each key."""
    return df.select(F.col(key).alias("id"), F.col(texts).alias("texts")).dropDuplicates(["id"])


def _mention(tags: Column, texts: Column) -> Column:
    return F.exists(tags, lambda tag: F.exists(texts, lambda v: v.contains(tag)))


def version_verdicts(pairs: DataFrame, t: DataFrame, m: DataFrame) -> DataFrame:
    """Of title pairs (t_what, m_what) those whose versions may agree, with ``by``: who else must mention a tag.

    ``by`` is null where the titles and tags decide, else "song" or "track": one side has tags, which the other
    side's artists must mention.
    """
    both = pairs.join(_named(t, "t", "what", "title", "tags"), "t_what").join(_named(m, "m", "what", "title", "tags"), "m_what")
    tt, mt = F.col("t_tags"), F.col("m_tags")
    shared = F.exists(tt, lambda x: F.exists(mt, lambda y: x.contains(y) | y.contains(x)))
    none_t, none_m = F.size(tt) == 0, F.size(mt) == 0
    plain = (none_t & none_m) | shared | (none_m & _mention(tt, F.col("m_title"))) | (none_t & _mention(mt, F.col("t_title")))
    by = F.when(plain, F.lit("")).when(none_m, F.lit("song")).when(none_t, F.lit("track"))
    return both.withColumn("by", by).where("by IS NOT NULL").select("t_what", "m_what", F.nullif("by", F.lit("")).alias("by"))


MATCHED = ("t_who", "t_what", "m_who", "m_what")


def compatible(rows: DataFrame, t: DataFrame, m: DataFrame) -> DataFrame:
    """Of rows with MATCHED those whose versions agree; ``rows`` is read several times."""
    found = rows.join(version_verdicts(rows.select("t_what", "m_what").distinct(), t, m), ["t_what", "m_what"])
    song = F.col("by") == "song"
    tagged = found.where("by IS NOT NULL").withColumns({"what": F.when(song, F.col("t_what")).otherwise(F.col("m_what")), "who": F.when(song, F.col("m_who")).otherwise(F.col("t_who"))})
    of = lambda df, by, key, texts: df.select(F.lit(by).alias("by"), key, texts).dropDuplicates([key])
    tags = of(t, "song", "what", "tags").unionByName(of(m, "track", "what", "tags"))
    artists = of(m, "song", "who", "artist").unionByName(of(t, "track", "who", "artist"))
    asked = tagged.select("by", "what", "who").distinct().join(tags, ["by", "what"]).join(artists, ["by", "who"])
    ok = asked.where(_mention(F.col("tags"), F.col("artist"))).select("by", "what", "who")
    return found.where("by IS NULL").select(*rows.columns).unionByName(tagged.join(ok, ["by", "what", "who"], "left_semi").select(*rows.columns))


def compatible_titles(artists: DataFrame, t: DataFrame, m: DataFrame) -> DataFrame:
    """(t_what, m_what) of the keys that artists (t_who, m_who) bring together, those whose versions agree.

    As ``compatible`` on MATCHED says, without a row for each four of them: a song's artist matters to the track's
    title alone, and a track's artist to the song's title alone.
    """
    own, other = _named(t, "t", "who", "what"), _named(m, "m", "who", "what")
    left = artists.join(own, "t_who").select("t_what", "m_who").distinct()
    rows = materialize(left.join(other, "m_who").select("t_what", "m_what", "m_who"))
    verdicts = materialize(version_verdicts(rows.select("t_what", "m_what").distinct(), t, m))
    tagged = lambda by: verdicts.where(F.col("by") == by).select("t_what", "m_what")
    named = lambda asked, df, what, who: asked.join(_lists(df[0], "what", "tags").toDF(what, "tags"), what).join(_lists(df[1], "who", "artist").toDF(who, "artist"), who).where(_mention(F.col("tags"), F.col("artist"))).select(what, who)
    by_song = rows.join(tagged("song"), ["t_what", "m_what"])
    by_song = by_song.join(named(by_song.select("t_what", "m_who").distinct(), (t, m), "t_what", "m_who"), ["t_what", "m_who"], "left_semi").select("t_what", "m_what")
    asked = artists.join(other.join(tagged("track").select("m_what").distinct(), "m_what", "left_semi"), "m_who").select("m_what", "t_who").distinct()
    by_track = named(asked, (m, t), "m_what", "t_who").join(own, "t_who").select("t_what", "m_what").distinct().join(tagged("track"), ["t_what", "m_what"], "left_semi")
    return verdicts.where("by IS NULL").select("t_what", "m_what").unionByName(by_song).unionByName(by_track).distinct()


def exact_title_rows(t: DataFrame, m: DataFrame, threshold: float) -> DataFrame:
    """MATCHED of keys with a title variant in common whose artists match, whatever their versions.

    Artists are held against each other in the blocks of a title; titles fan them out afterwards.
    """
    t = t.where(F.size("artist") > 0)
    entries = lambda df: title_entries(df, "who", "what")
    lists = lambda df: entries(df).select("block", F.col("who").alias("id")).distinct().join(_lists(df, "who", "artist"), "id")
    met = alike_in_blocks(lists(t), lists(m), threshold).withColumnsRenamed({"left": "t_who", "right": "m_who"})
    for side, df in (("t", t), ("m", m)):
        met = met.join(entries(df).withColumnsRenamed({"who": f"{side}_who", "what": f"{side}_what"}), ["block", f"{side}_who"])
    return met.select(*MATCHED).distinct()


def artist_rows(t: DataFrame, m: DataFrame, sk: DataFrame, accepted: DataFrame, threshold: float, most: int | None = MAX_FUZZY_SONGS) -> DataFrame:
    """MATCHED and map_id of keys with an accepted artist whose titles match; map_id is null for all songs of the key, else one song of it.

    Titles are held against each other in the blocks of a track's artist.
    """
    carried = _named(m, "m", "who", "artist").select("m_who", F.explode("m_artist").alias("variant"))
    exact = accepted.where("exact").join(carried, "variant").select(F.col("who").alias("t_who"), "m_who").distinct()
    exact = exact.join(_named(m, "m", "who", "what"), "m_who").withColumn("map_id", F.lit(None).cast("bigint"))
    fuzzy = artist_candidates(accepted.where("NOT exact").select(F.col("who").alias("sig"), "variant", "exact"), sk, most)
    fuzzy = fuzzy.join(sk.select(F.col("map_id").alias("_id"), "who", "what"), F.col("map_id") == F.col("_id"))
    fuzzy = fuzzy.select(F.col("sig").alias("t_who"), F.col("who").alias("m_who"), F.col("what").alias("m_what"), "map_id")
    songs = materialize(exact.select(*fuzzy.columns).unionByName(fuzzy))
    t = t.where((F.size("artist") > 0) & (F.size("title") > 0))
    left = t.select(F.col("who").alias("block"), F.col("what").alias("id"), F.col("title").alias("texts"))
    right = songs.select(F.col("t_who").alias("block"), F.col("m_what").alias("id")).distinct().join(_lists(m, "what", "title"), "id")
    met = alike_in_blocks(left, right, threshold, siblings=True).toDF("t_who", "t_what", "m_what")
    return met.join(songs, ["t_who", "m_what"]).select(*MATCHED, "map_id")


def exact_title_path(t: DataFrame, m: DataFrame, threshold: float) -> DataFrame:
    """MATCHED of keys with a title variant in common, matching artists and versions that agree."""
    return compatible(materialize(exact_title_rows(t, m, threshold)), t, m)


def artist_path(t: DataFrame, m: DataFrame, sk: DataFrame, accepted: DataFrame, threshold: float, most: int | None = MAX_FUZZY_SONGS) -> DataFrame:
    """MATCHED and map_id of keys with an accepted artist, matching titles and versions that agree."""
    return compatible(materialize(artist_rows(t, m, sk, accepted, threshold, most)), t, m)


def match_keys(t: DataFrame, m: DataFrame, sk: DataFrame, threshold: float, most: int | None = MAX_FUZZY_SONGS, index: ArtistIndex | None = None) -> DataFrame:
    """(tkey, mkey, map_id): matched keys; map_id is null for all songs of the key, else one song of it."""
    accepted = materialize(accepted_of(t, m, threshold, index))
    by_title = exact_title_rows(t, m, threshold).withColumn("map_id", F.lit(None).cast("bigint"))
    rows = materialize(by_title.unionByName(artist_rows(t, m, sk, accepted, threshold, most)))
    return as_keys(compatible(rows, t, m))


def as_keys(matched: DataFrame) -> DataFrame:
    """(tkey, mkey, map_id) of MATCHED and map_id."""
    return matched.select(_key("t_who", "t_what").alias("tkey"), _key("m_who", "m_what").alias("mkey"), "map_id")


def accepted_of(t: DataFrame, m: DataFrame, threshold: float, index: ArtistIndex | None = None) -> DataFrame:
    """(who, variant, exact): the accepted artists of distinct keys."""
    whos = t.where(F.size("artist") > 0).select("who", signature(F.col("artist")).alias("sig")).distinct()
    return accepted_artists(signatures(t), index or artist_variants(m), threshold).join(whos, "sig").select("who", "variant", "exact")


def match_tracks(tracks: DataFrame, songs: DataFrame, threshold: float = THRESHOLD, most: int | None = MAX_FUZZY_SONGS) -> DataFrame:
    """(track_id, map_id) of every track and song whose artists and titles both agree.

    ``most`` bounds the songs of an artist that is found by trigrams only, as in the matched behaviour; None takes all.
    """
    return match_keyed(track_keys(tracks), song_keys(songs), threshold, most)


def match_keyed(tk: DataFrame, sk: DataFrame, threshold: float = THRESHOLD, most: int | None = MAX_FUZZY_SONGS) -> DataFrame:
    """``match_tracks`` on keys."""
    return _match(tk, materialize(sk), threshold, most).select(F.col("id").alias("track_id"), "map_id")


def _match(tk: DataFrame, sk: DataFrame, threshold: float, most: int | None = MAX_FUZZY_SONGS) -> DataFrame:
    """``fanned_out`` matches; ``tk`` is read twice, for its distinct keys and for its ids."""
    t, m = materialize(distinct_keys(tk, "tkey")), materialize(distinct_keys(sk, "mkey"))
    found = materialize(match_keys(t, m, sk, threshold, most))
    return fanned_out(found, tk, sk)


def in_lists(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, map_ids): the songs of each key as lists of FAN_SONGS at most, as many rows as that takes."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("map_id")) - 1
    cut = rows.select(*keys, "map_id", F.floor(place / FAN_SONGS).alias("_list"))
    # in structs, as a list of bare ids would lose nulls
    return cut.groupBy(*keys, "_list").agg(F.collect_list(F.struct("map_id"))["map_id"].alias("map_ids")).drop("_list")


def _whole_and_single(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows of matched keys of which all songs count, and those of single songs of other keys."""
    every = found.where("map_id IS NULL").drop("map_id").distinct()
    # one song of a key counts only where not all of them do
    return every, found.where("map_id IS NOT NULL").distinct().join(every, ["tkey", "mkey"], "left_anti")


def fanned_out(found: DataFrame, tk: DataFrame, sk: DataFrame) -> DataFrame:
    """(id, map_id, tkey, mkey) of matched keys, each once, and what else ``found`` has of a pair of keys.

    Songs meet the tracks of a key as lists and become rows last, so that no join or shuffle has a row for each pair.
    """
    every, one = _whole_and_single(found)
    columns = [c for c in found.columns if c != "map_id"]
    lists = in_lists(one, *columns).unionByName(every.join(in_lists(sk, "mkey"), "mkey").select(*columns, "map_ids"))
    # few rows become very many: they are dealt out finer than their size asks for
    n = FAN_TASKS * int(tk.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = lists.repartition(n, "tkey").join(tk.select("id", "tkey").repartition(n, "tkey"), "tkey")
    return met.select("id", F.explode("map_ids").alias("map_id"), *columns)


def match_totals(found: DataFrame, tk: DataFrame, sk: DataFrame) -> DataFrame:
    """One row (matched_tracks, pairs): tracks and rows of ``fanned_out``, counted by keys."""
    every, one = _whole_and_single(found)
    n = lambda df, key, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    met = every.join(n(sk, "mkey", "songs"), "mkey").select("tkey", "songs").unionByName(one.select("tkey", F.lit(1).cast("bigint").alias("songs")))
    met = met.groupBy("tkey").agg(F.sum("songs").alias("songs")).join(n(tk, "tkey", "tracks"), "tkey")
    pairs = met.agg(F.coalesce(F.sum(F.col("songs") * F.col("tracks")), F.lit(0)).alias("pairs"))
    matched = matched_ids(found, tk).agg(F.count_distinct("track_id").alias("matched_tracks"))
    return matched.join(pairs, F.lit(True))


def matched_ids(found: DataFrame, tk: DataFrame) -> DataFrame:
    """(track_id) of tracks that have a match."""
    return tk.join(found.select("tkey").distinct(), "tkey", "left_semi").select(F.col("id").alias("track_id"))


def one_of_each(tk: DataFrame, groups: DataFrame, *group: str) -> DataFrame:
    """(id, tkey): of the tracks of a group that have the same key the one with the least id."""
    of = groups.select(F.col("id").alias("_id"), *group)
    return tk.join(of, F.col("id") == F.col("_id")).groupBy("tkey", *group).agg(F.min("id").alias("id")).select("id", "tkey")


def score_keys(pairs: DataFrame, t: DataFrame, m: DataFrame) -> DataFrame:
    """(tkey, mkey, score) of distinct key pairs; each pair of titles and each pair of artists is scored once."""
    ids = lambda df, side: df.select(F.col(f"{side}key"), F.col("who").alias(f"{side}_who"), F.col("what").alias(f"{side}_what"))
    out = materialize(pairs.select("tkey", "mkey").distinct().join(ids(t, "t"), "tkey").join(ids(m, "m"), "mkey"))
    for key, texts in (("what", "title"), ("who", "artist")):
        both = [f"t_{key}", f"m_{key}"]
        each = out.select(*both).distinct()
        for side, df in (("t", t), ("m", m)):
            each = each.join(_lists(df, key, texts).toDF(f"{side}_{key}", side), f"{side}_{key}")
        out = out.join(each.select(*both, S.best_score(F.col("t"), F.col("m")).alias(f"best_{texts}")), both)
    return out.select("tkey", "mkey", F.least("best_title", "best_artist").alias("score"))


def scored_keys(tk: DataFrame, sk: DataFrame, threshold: float = THRESHOLD, digits: int | None = None) -> DataFrame:
    """(tkey, mkey, map_id, score): ``match_keys`` with their scores, rounded if ``digits`` is given."""
    t, m = materialize(distinct_keys(tk, "tkey")), materialize(distinct_keys(sk, "mkey"))
    found = materialize(match_keys(t, m, sk, threshold))
    scores = score_keys(found, t, m)
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return materialize(found.join(scores, ["tkey", "mkey"]))


def score_matches(tracks: DataFrame, songs: DataFrame, threshold: float = THRESHOLD, digits: int | None = None) -> DataFrame:
    """(track_id, map_id, score) of all matches; keys are scored, and ids are fanned out last."""
    tk, sk = materialize(track_keys(tracks)), materialize(song_keys(songs))
    return fanned_out(scored_keys(tk, sk, threshold, digits), tk, sk).select(F.col("id").alias("track_id"), "map_id", "score")


def match_one(track: DataFrame, songs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The matches of one track: the same job on one row. ``match_indexed`` reads keys that are kept instead of songs."""
    return match_tracks(materialize(track.limit(1)), songs, threshold)


# ---- a kept index ----

#: What each table of the index is dealt out by.
INDEX_KEYS = {"match_songs": "mkey", "match_keys": None, "match_variants": "variant", "match_postings": "trigram", "match_frequency": "trigram"}


def match_index(songs: DataFrame) -> dict[str, DataFrame]:
    """The tables that matching reads of songs, to be kept with the version of the songs: keys, artist variants and their trigrams."""
    sk = materialize(song_keys(songs))
    index = artist_index(artist_variants(sk))
    return {"match_songs": sk, "match_keys": distinct_keys(sk, "mkey"), "match_variants": index.variants, "match_postings": index.postings, "match_frequency": index.frequency}


def match_indexed(tracks: DataFrame, kept: Mapping[str, DataFrame], threshold: float = THRESHOLD, most: int | None = MAX_FUZZY_SONGS) -> DataFrame:
    """``match_tracks`` with the tables of ``match_index``: only the tracks are keyed, and no text of a song is read."""
    index = ArtistIndex(kept["match_variants"], kept["match_postings"], kept["match_frequency"])
    tk, sk = materialize(track_keys(tracks)), kept["match_songs"]
    found = materialize(match_keys(distinct_keys(tk, "tkey"), kept["match_keys"], sk, threshold, most, index))
    return fanned_out(found, tk, sk).select(F.col("id").alias("track_id"), "map_id")


def explain_pairs(tracks: DataFrame, songs: DataFrame, pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(track_id, map_id, part, own, other, score): variant pairs of given (track_id, map_id) that resemble each other."""
    tk, sk = track_keys(tracks), song_keys(songs)
    both = pairs.join(tk, F.col("track_id") == F.col("id")).select("track_id", F.col("map_id").alias("_id"), F.col("artist").alias("t_artist"), F.col("title").alias("t_title"))
    both = both.join(sk, F.col("map_id") == F.col("_id"))
    part = lambda name: both.select("track_id", "map_id", F.lit(name).alias("part"), F.explode(f"t_{name}").alias("own"), name).select("track_id", "map_id", "part", "own", F.explode(name).alias("other"))
    each = materialize(part("artist").unionByName(part("title")))
    texts = each.select("own", "other").distinct().withColumn("score", S.fuzzy_score(F.col("own"), F.col("other")))
    return each.join(texts.where(F.col("score") >= least), ["own", "other"])


def search_titles(tracks: DataFrame, songs: DataFrame, terms: list[str], least: float = 0.8, best: int = 5) -> DataFrame:
    """For each term the first track whose title holds it, against all songs: the best scores from ``least`` on.

    The terms are a given list, so the tracks picked are no more than it has entries.
    """
    spark = tracks.sparkSession
    wanted = spark.createDataFrame([(k, t.lower()) for k, t in enumerate(terms)], "term_no int, term string")
    met = tracks.join(F.broadcast(wanted), F.lower("title").contains(F.col("term")))
    first = met.groupBy("term_no", "term").agg(F.min_by(F.struct("id", "artist", "title"), F.struct("artist", "title", "id")).alias("track")).select("term_no", "term", "track.*")
    tk = track_keys(first).select("id", "tkey", F.col("artist").alias("t_artist"), F.col("title").alias("t_title"))
    sk = materialize(song_keys(songs))
    m = distinct_keys(sk, "mkey").select("mkey", F.col("artist").alias("m_artist"), F.col("title").alias("m_title"))
    scored = m.where((F.size("m_artist") > 0) | (F.size("m_title") > 0)).join(F.broadcast(tk), F.lit(True)).withColumn("score", F.least(S.best_score(F.col("t_title"), F.col("m_title"), least), S.best_score(F.col("t_artist"), F.col("m_artist"), least))).where(F.col("score") >= least)
    hits = scored.select("id", "mkey", "score").join(sk.select("mkey", "map_id"), "mkey")
    w = Window.partitionBy("term_no").orderBy(F.desc("score"), "map_id")
    return hits.join(first.select("id", "term_no", "term"), "id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).select("term", F.col("id").alias("track_id"), "map_id", "score", "rank")
