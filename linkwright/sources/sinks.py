"""Writers: whole tables are replaced, as each load is a whole snapshot; each replacement is one version of a store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.sources import store

BUCKETS = 16
CATALOG_KEYS = {"songs": "map_id", "difficulties": "song_map_id"}


def write_catalog(songs: DataFrame, difficulties: DataFrame, meta: DataFrame, path: str, buckets: int = BUCKETS, more: Mapping[str, DataFrame] | None = None, keys: Mapping[str, str] | None = None) -> DataFrame:
    """Replace the catalog by one version of all three tables, dealt out by song; one row with the written counts.

    ``more`` are tables made of the songs that are kept with them, as an index, dealt out by ``keys``.
    """
    spark = songs.sparkSession
    tables = {"songs": songs, "difficulties": difficulties, "meta": meta, **(more or {})}
    store.publish(spark, path, tables, CATALOG_KEYS | {k: v for k, v in (keys or {}).items() if v}, buckets)
    return store.counts(spark, path, "songs", "difficulties")


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """songs, difficulties and meta of one version; joins and groups by song need no exchange."""
    return store.read(spark, path)


def write_tracks(tracks: DataFrame, path: str) -> DataFrame:
    """Replace the library; one row with the written count."""
    store.publish(tracks.sparkSession, path, {"tracks": tracks})
    return store.counts(tracks.sparkSession, path, "tracks")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, path)["tracks"]


def clear_tracks(spark: SparkSession, path: str) -> None:
    """Empty the library, keeping its columns: a version without rows."""
    store.publish(spark, path, {"tracks": read_tracks(spark, path).limit(0)})


def songs_for_matching(songs: DataFrame) -> DataFrame:
    return songs.select("map_id", "key", "song_name", "song_author", "level_author")


def tracks_for_matching(tracks: DataFrame) -> DataFrame:
    return tracks.select("id", "title", F.coalesce("artist", F.lit("")).alias("artist"), "album")


def export_for_matching(songs: DataFrame, tracks: DataFrame, path: str) -> None:
    """The columns that matching needs, as JSON lines."""
    songs_for_matching(songs).write.mode("overwrite").json(f"{path}/songs", ignoreNullFields=False)
    tracks_for_matching(tracks).write.mode("overwrite").json(f"{path}/tracks", ignoreNullFields=False)
