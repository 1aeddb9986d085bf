"""What is made of scored matches: groups, coverage, orders, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.columns import half_up
from linkwright.operators.catalog import order

BUCKETS = ((1.0, "1.0"), (0.9, "0.9-0.99"), (0.8, "0.8-0.89"), (0.7, "0.7-0.79"))
LOWEST = "<0.7"
MATCH_SORTS = ("song_name", "song_author", "level_author", "bpm", "duration", "rating", "ranked", "upload_time", "score")


def with_group(tracks: DataFrame) -> DataFrame:
    """Tracks with their group: artist and title in small letters."""
    return tracks.withColumns({"group_artist": F.lower("artist"), "group_title": F.lower("title")})


def group_scores(scored: DataFrame, tracks: DataFrame) -> DataFrame:
    """(group_artist, group_title, map_id, score): the best score of a group's instances."""
    ids = with_group(tracks).select(F.col("id").alias("_id"), "group_artist", "group_title")
    return scored.join(ids, F.col("track_id") == F.col("_id")).groupBy("group_artist", "group_title", "map_id").agg(F.max("score").alias("score"))


GROUP = ("group_artist", "group_title")


def matched_tracks(scored: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks with their groups, those that have a match."""
    return with_group(tracks).join(scored.select(F.col("track_id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_semi")


def track_groups(scored: DataFrame, tracks: DataFrame) -> DataFrame:
    """(group_artist, group_title, primary_id, artist, title, n_instances) of matched tracks; ``group_instances`` has the instances."""
    first = F.min(F.struct("artist", "title", "id")).alias("first")
    grouped = matched_tracks(scored, tracks).groupBy(*GROUP).agg(first, F.count(F.lit(1)).alias("n_instances"))
    return grouped.select(*GROUP, F.col("first.id").alias("primary_id"), F.col("first.artist").alias("artist"), F.col("first.title").alias("title"), "n_instances")


def group_instances(scored: DataFrame, tracks: DataFrame) -> DataFrame:
    """(group_artist, group_title, position, id): a group's tracks by artist, title and id, a row for each; the sort spills."""
    w = Window.partitionBy(*GROUP).orderBy("artist", "title", "id")
    return matched_tracks(scored, tracks).select(*GROUP, F.row_number().over(w).alias("position"), "id")


def group_matches(scored: DataFrame, tracks: DataFrame) -> DataFrame:
    """(group_artist, group_title, position, map_id, score): a group's songs, best first, a row for each."""
    w = Window.partitionBy(*GROUP).orderBy(F.desc("score"), "map_id")
    return group_scores(scored, tracks).select(*GROUP, F.row_number().over(w).alias("position"), "map_id", "score")


def group_results(scored: DataFrame, tracks: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Groups by artist and title, with the number of their songs and the best score; ``group_matches`` has the songs.

    ``matched`` (track_id) has all matched tracks where ``scored`` has only those that a group's scores come from.
    """
    best = group_scores(scored, tracks).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_matches"), F.max("score").alias("best"))
    return track_groups(scored if matched is None else matched, tracks).join(best, list(GROUP)).orderBy(*result_order())


def result_order() -> list[Column]:
    return [F.collate("artist", "UNICODE"), F.collate("title", "UNICODE"), F.col("primary_id")]


def coverage(scored: DataFrame, tracks: DataFrame) -> DataFrame:
    """Groups, matched groups, and their share in percent to one decimal; 0.0 of none."""
    rows = with_group(tracks)
    every = rows.agg(F.count_distinct("group_artist", "group_title").alias("groups"))
    ids = scored.select(F.col("track_id").alias("_id")).distinct()
    hit = rows.join(ids, F.col("id") == F.col("_id"), "left_semi").agg(F.count_distinct("group_artist", "group_title").alias("matched_groups"))
    share = F.when(F.col("groups") > 0, half_up(F.col("matched_groups") / F.col("groups") * 100, 1)).otherwise(F.lit(0.0))
    return every.join(hit, F.lit(True)).withColumn("coverage", share)


def match_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("track_id").agg(F.count(F.lit(1)).alias("matches"), F.max("score").alias("best"))


def match_count_histogram(scored: DataFrame) -> DataFrame:
    return match_counts(scored).groupBy("matches").agg(F.count(F.lit(1)).alias("tracks")).orderBy("matches")


def bucket(score: Column) -> Column:
    out = F.when(score >= BUCKETS[0][0], F.lit(BUCKETS[0][1]))
    for least, name in BUCKETS[1:]:
        out = out.when(score >= least, F.lit(name))
    return out.otherwise(F.lit(LOWEST))


def score_buckets(scored: DataFrame) -> DataFrame:
    """Tracks by their best score, with the share of all matched tracks."""
    n = match_counts(scored).groupBy(bucket(F.col("best")).alias("bucket")).agg(F.count(F.lit(1)).alias("tracks"))
    total = n.agg(F.sum("tracks").alias("_all"))
    return n.join(total, F.lit(True)).select("bucket", "tracks", (F.col("tracks") / F.col("_all")).alias("share"))


def match_summary(scored: DataFrame, tracks: DataFrame) -> DataFrame:
    m = match_counts(scored).agg(F.count(F.lit(1)).alias("matched"), F.avg("matches").alias("average_matches"))
    n = tracks.agg(F.count(F.lit(1)).alias("tracks"))
    return m.join(n, F.lit(True)).withColumn("share", F.when(F.col("tracks") > 0, F.col("matched") / F.col("tracks")).otherwise(F.lit(0.0)))


def empty_keys(keyed: DataFrame) -> DataFrame:
    """How many keys have no title variants."""
    return keyed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.when(F.size("title") == 0, 1).otherwise(0)), F.lit(0)).alias("empty"))


def size_profile(song_keys: DataFrame, totals: DataFrame) -> DataFrame:
    """Distinct artist and title variants beside the one row of ``totals`` (matched_tracks, pairs)."""
    distinct = lambda c, name: song_keys.select(F.explode(c).alias("v")).agg(F.count_distinct("v").alias(name))
    return distinct("artist", "artist_variants").join(distinct("title", "title_variants"), F.lit(True)).join(totals, F.lit(True))


def hydrate(scored: DataFrame, tracks: DataFrame, songs: DataFrame) -> DataFrame:
    """Pairs with the track's and the song's columns."""
    t = tracks.select(F.col("id").alias("_id"), "title", "artist", "album")
    return scored.join(t, F.col("track_id") == F.col("_id")).drop("_id").join(songs, "map_id")


def top_matches(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k best songs of each track."""
    w = Window.partitionBy("track_id").orderBy(F.desc("score"), "map_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def busiest_tracks(scored: DataFrame, n: int = 15) -> DataFrame:
    return match_counts(scored).orderBy(F.desc("matches"), "track_id").limit(n)


def best_tracks(scored: DataFrame, n: int = 30) -> DataFrame:
    return match_counts(scored).orderBy(F.desc("best"), "track_id").limit(n)


def borderline(scored: DataFrame, low: float = 0.80, high: float = 0.86, n: int = 20) -> DataFrame:
    return scored.where((F.col("score") >= low) & (F.col("score") < high)).orderBy("track_id", "map_id").limit(n)


def search_results(rows: DataFrame, search: str) -> DataFrame:
    """Rows whose title or artist holds the text itself, small and capital letters alike."""
    if not search:
        return rows
    q = F.lower(F.lit(search))
    return rows.where(F.lower("title").contains(q) | F.lower("artist").contains(q))


def prune_by_rating(scored: DataFrame, songs: DataFrame, percent: float) -> DataFrame:
    """Matches with songs rated ``percent`` at least; tracks without any left are gone with them."""
    if not percent > 0:
        return scored
    good = songs.where(F.col("rating") >= percent / 100).select(F.col("map_id").alias("_id"))
    return scored.join(good, F.col("map_id") == F.col("_id"), "left_semi")


def sort_matches(rows: DataFrame, key: str = "score", ascending: bool = False) -> DataFrame:
    """Hydrated matches of each track in the order of a column; ratings that tie go by score."""
    if key not in MATCH_SORTS:
        raise ValueError(f"no such order: {key}")
    column = F.collate(F.col(key), "UNICODE") if key in MATCH_SORTS[:3] else F.col({"ranked": "ranked_states"}.get(key, key))
    keys = [column, F.col("score")] if key == "rating" else [column]
    w = Window.partitionBy("track_id").orderBy(*order(keys, ascending), F.col("map_id"))
    return rows.withColumn("position", F.row_number().over(w))


def result_page(groups: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """Groups by artist and title, one page of them."""
    return groups.orderBy(*result_order()).offset((max(1, page) - 1) * size).limit(size)
