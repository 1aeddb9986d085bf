"""Catalog snapshots, decoded but nested, to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.columns import HASH_BYTES, hash_at, hundredths, map_key, rating, uploader

FORMAT_VERSION = 3


def snapshot_error() -> Column:
    """Why a snapshot is rejected; null if it isn't."""
    short = F.coalesce(F.length("song_hashes"), F.lit(0)) < HASH_BYTES * F.coalesce(F.size("songs"), F.lit(0))
    wrong = ~F.col("format_version").eqNullSafe(F.lit(FORMAT_VERSION))
    return F.when(wrong, F.concat(F.lit("unsupported format version "), F.coalesce(F.col("format_version").cast("string"), F.lit("null")))).when(short, F.lit("hash blob too short"))


def split_snapshots(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good snapshots, and bad ones with their ``error``."""
    checked = snapshots.withColumn("error", snapshot_error())
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def validate_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshots; the job fails on a bad one."""
    checked = snapshots.withColumn("_error", snapshot_error())
    return checked.where(F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")).cast("boolean")).otherwise(F.lit(True))).drop("_error")


def flatten_songs(snapshots: DataFrame) -> DataFrame:
    """One row for each song, hashes by position."""
    each = snapshots.select("scrape_ended_time_unix", "song_hashes", F.posexplode("songs").alias("pos", "s"))
    return each.select(
        F.col("s.map_id").alias("map_id"),
        map_key(F.col("s.map_id")).alias("key"),
        hash_at(F.col("song_hashes"), F.col("pos")).alias("hash"),
        F.col("s.bpm").cast("double").alias("bpm"),
        F.col("s.upvotes").alias("upvotes"),
        F.col("s.downvotes").alias("downvotes"),
        rating(F.col("s.upvotes"), F.col("s.downvotes")).alias("rating"),
        F.col("s.upload_time_unix").alias("upload_time"),
        F.col("s.song_duration_seconds").alias("duration"),
        F.col("s.song_name").alias("song_name"),
        F.col("s.song_author_name").alias("song_author"),
        F.col("s.level_author_name").alias("level_author"),
        uploader(F.col("s.uploader_name"), F.col("s.level_author_name")).alias("uploader_name"),
        F.col("s.ranked_states").alias("ranked_states"),
        F.col("s.ranked_change_unix").alias("ranked_change_time"),
        F.col("s.tags").alias("tags"),
        F.col("s.upload_flags").alias("upload_flags"),
        F.col("scrape_ended_time_unix").alias("scrape_ended_time"),
    )


def flatten_difficulties(snapshots: DataFrame) -> DataFrame:
    """One row for each difficulty, with its song's id; songs without difficulties give none."""
    each = snapshots.select(F.explode("songs").alias("s")).select(F.col("s.map_id").alias("song_map_id"), F.explode("s.difficulties").alias("d"))
    return each.select(
        "song_map_id",
        "d.characteristic",
        "d.difficulty",
        hundredths(F.col("d.stars_t100")).alias("stars_ss"),
        hundredths(F.col("d.stars_t100_bl")).alias("stars_bl"),
        hundredths(F.col("d.njs_t100")).alias("njs"),
        "d.bombs",
        "d.notes",
        "d.obstacles",
        "d.mods",
    )


def snapshot_meta(snapshots: DataFrame) -> DataFrame:
    """(key, value): the end of the scrape as text and the tag list as JSON."""
    pairs = F.array(
        F.struct(F.lit("scrape_ended_time").alias("key"), F.col("scrape_ended_time_unix").cast("string").alias("value")),
        F.struct(F.lit("tag_list").alias("key"), F.to_json("tag_list").alias("value")),
    )
    return snapshots.select(F.inline(pairs))


def tag_positions(tag_list: DataFrame, column: str = "tag_list") -> DataFrame:
    """(name, bit): of a name that occurs twice, the last bit."""
    return tag_list.select(F.posexplode(column).alias("bit", "name")).groupBy("name").agg(F.max("bit").alias("bit"))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def nest(songs: DataFrame, difficulties: DataFrame, snapshot: Column, tag_list: list[str]) -> DataFrame:
    """Snapshots from flat tables, by the value of ``snapshot``: the way back of the two flattenings."""
    t100 = lambda c: F.round(F.col(c) * 100).cast("bigint")
    child = F.struct("characteristic", "difficulty", t100("stars_ss").alias("stars_t100"), t100("stars_bl").alias("stars_t100_bl"), t100("njs").alias("njs_t100"), "bombs", "notes", "obstacles", "mods")
    children = difficulties.groupBy(F.col("song_map_id").alias("_id")).agg(F.collect_list(child).alias("difficulties"))
    song = F.struct(
        "map_id",
        F.col("hash"),
        F.struct(
            F.col("bpm").cast("float").alias("bpm"),
            "upvotes",
            "downvotes",
            F.col("upload_time").alias("upload_time_unix"),
            "map_id",
            F.col("duration").alias("song_duration_seconds"),
            "song_name",
            F.col("song_author").alias("song_author_name"),
            F.col("level_author").alias("level_author_name"),
            "uploader_name",
            F.coalesce("difficulties", F.array()).alias("difficulties"),
            F.col("ranked_change_time").alias("ranked_change_unix"),
            "ranked_states",
            "tags",
            "upload_flags",
        ).alias("s"),
    )
    both = songs.join(children, F.col("map_id") == F.col("_id"), "left")
    some = both.groupBy(snapshot.alias("snapshot")).agg(F.max("scrape_ended_time").alias("scrape_ended_time_unix"), F.sort_array(F.collect_list(song)).alias("songs"))
    return some.select(
        F.lit(FORMAT_VERSION).alias("format_version"),
        "scrape_ended_time_unix",
        F.unhex(F.array_join("songs.hash", "")).alias("song_hashes"),
        F.col("songs.s").alias("songs"),
        F.array(*(F.lit(t) for t in tag_list)).alias("tag_list"),
    )
