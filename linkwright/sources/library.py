"""Pages of a track library's JSON answers to a flat table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.textkeys import normalized_key
from linkwright.schemas import ENVELOPE, PAGE, TRACK

#: Names in the answers and in the table.
RENAMED = {"albumId": "album_id", "artistId": "artist_id", "track": "track_number", "discNumber": "disc_number", "bitRate": "bit_rate", "coverArt": "cover_art"}
PLAIN = ("album", "duration", "year", "genre", "suffix", "path")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each landed page: column ``response``."""
    return spark.read.schema(PAGE).json(path, multiLine=True).select(F.col("`subsonic-response`").alias("response"))


def parse_pages(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """The same from a column of JSON texts."""
    body = F.from_json(F.col(json_col), f"struct<{PAGE.replace(' struct', ':struct', 1)}>")
    return pages.select(body.getField("subsonic-response").cast(ENVELOPE).alias("response"))


def error_text() -> Column:
    e = F.col("response.error")
    return F.when(e.isNotNull(), F.concat(e["message"], F.lit(" (code "), e["code"].cast("string"), F.lit(")")))


def split_ok_failed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages that succeeded, and the others with their ``error``."""
    ok = F.col("response.status").eqNullSafe(F.lit("ok"))
    return pages.where(ok), pages.where(~ok).select("*", error_text().alias("error"))


def tracks_of(pages: DataFrame) -> DataFrame:
    """One row for each track of each page; a page without results has none."""
    songs = F.coalesce(F.col("response.searchResult3.song"), F.array().cast(f"array<{TRACK}>"))
    return pages.select(F.explode(songs).alias("t")).select("t.*")


def project_tracks(raw: DataFrame, fetched_at: Column) -> DataFrame:
    """The library table: a missing artist is empty, other missing values are null."""
    artist = F.coalesce("artist", F.lit(""))
    return raw.select(
        "id",
        "title",
        artist.alias("artist"),
        normalized_key(artist, F.col("title")).alias("normalized_key"),
        *PLAIN,
        *(F.col(a).alias(b) for a, b in RENAMED.items()),
        fetched_at.cast("bigint").alias("fetched_at"),
    )
