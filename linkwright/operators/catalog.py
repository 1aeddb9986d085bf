"""Catalog and library search: optional predicates, one semi-join, sort, page, count."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from linkwright.functions import columns as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEARCHED = ("song_name", "song_author", "level_author", "uploader_name", "key", "hash")
LIBRARY_SEARCHED = ("title", "artist", "album")
TEXT_KEYS = ("song_name", "song_author", "level_author", "title", "artist", "album")
SORT_KEYS = ("upload_time", "rating", "bpm", "song_name", "song_author", "level_author", "duration", "upvotes", "ranked_states", "stars")
LIBRARY_SORT_KEYS = ("title", "artist", "album", "duration", "year")
LIBRARY_COLUMNS = ("id", "title", "artist", "album", "duration", "year", "fetched_at", "normalized_key")
MAX_PAGE, CATALOG_PAGE, LIBRARY_PAGE = 500, 50, 100


@dataclass(frozen=True)
class Filters:
    """Catalog predicates. Zero masks, blank texts and empty lists ask for nothing; None is an absent bound."""

    search: str = ""
    ranked_states: int = 0
    ranked_states_any: int = 0
    upload_flags: int = 0
    bpm_min: float | None = None
    bpm_max: float | None = None
    upload_from: int | None = None
    upload_to: int | None = None
    tags: tuple[int, ...] = ()
    characteristics: tuple[int, ...] = ()
    difficulties: tuple[int, ...] = ()
    stars_min: float | None = None
    stars_max: float | None = None
    stars_source: str = "ss"
    mods: int = 0
    min_notes: int | None = None
    min_obstacles: int | None = None
    min_bombs: int | None = None


@dataclass(frozen=True)
class Query:
    filters: Filters = field(default_factory=Filters)
    sort: str = "upload_time"
    ascending: bool = False
    page: int = 1
    page_size: int = CATALOG_PAGE


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def matches_any(names: tuple[str, ...], search: str) -> Column:
    """LIKE %search% on any column, wildcards in the search included, ASCII case folded."""
    pattern = "%" + search.strip().translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%"
    return reduce(lambda a, b: a | b, (ascii_lower(F.col(n)).like(pattern) for n in names))


def _all(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def bits(c: str, mask: int) -> Column:
    signed = mask - 2**64 if mask >= 2**63 else mask
    return F.col(c).bitwiseAND(F.lit(signed).cast("bigint"))


def song_condition(f: Filters) -> Column | None:
    out = []
    if f.search.strip():
        out.append(matches_any(SEARCHED, f.search))
    if f.ranked_states:
        out.append(bits("ranked_states", f.ranked_states) == f.ranked_states)
    if f.ranked_states_any:
        out.append(bits("ranked_states", f.ranked_states_any) > 0)
    if f.upload_flags:
        out.append(bits("upload_flags", f.upload_flags) == f.upload_flags)
    bounds = ((f.bpm_min, "bpm", ">="), (f.bpm_max, "bpm", "<="), (f.upload_from, "upload_time", ">="), (f.upload_to, "upload_time", "<="))
    out += [F.col(c) >= v if op == ">=" else F.col(c) <= v for v, c, op in bounds if v is not None]
    if f.tags:
        out.append(bits("tags", sum(1 << b for b in set(f.tags))) != 0)
    return _all(out)


def difficulty_condition(f: Filters) -> Column | None:
    """What one and the same difficulty has to meet."""
    stars = f"stars_{'bl' if f.stars_source == 'bl' else 'ss'}"
    out = []
    if f.characteristics:
        out.append(F.col("characteristic").isin(*f.characteristics))
    if f.difficulties:
        out.append(F.col("difficulty").isin(*f.difficulties))
    if f.stars_min is not None:
        out.append(F.col(stars) >= f.stars_min)
    if f.stars_max is not None:
        out.append(F.col(stars) <= f.stars_max)
    if f.mods:
        out.append(bits("mods", f.mods) > 0)
    out += [F.col(c) >= v for c, v in (("notes", f.min_notes), ("obstacles", f.min_obstacles), ("bombs", f.min_bombs)) if v is not None]
    return _all(out)


def catalog_filter(songs: DataFrame, difficulties: DataFrame, f: Filters) -> DataFrame:
    own, child = song_condition(f), difficulty_condition(f)
    if own is not None:
        songs = songs.where(own)
    if child is not None:
        ids = difficulties.where(child).select(F.col("song_map_id").alias("_child"))
        songs = songs.join(ids, F.col("map_id") == F.col("_child"), "left_semi")
    return songs


def max_stars(difficulties: DataFrame, source: str = "ss") -> DataFrame:
    column = f"stars_{'bl' if source == 'bl' else 'ss'}"
    return difficulties.groupBy("song_map_id").agg(F.max(column).alias("stars"))


def with_stars(songs: DataFrame, difficulties: DataFrame, source: str = "ss") -> DataFrame:
    best = max_stars(difficulties, source).withColumnRenamed("song_map_id", "_id")
    return songs.join(best, F.col("map_id") == F.col("_id"), "left").drop("_id")


def order(keys: list[Column], ascending: bool) -> list[Column]:
    return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]


def paged(df: DataFrame, keys: list[Column], tie: Column, ascending: bool, page: int, size: int) -> DataFrame:
    """One page; equal keys are ordered by ``tie``, so that pages don't overlap."""
    if size < 0:
        raise ValueError("page size must not be negative")
    size = min(MAX_PAGE, size)
    return df.orderBy(*order(keys, ascending), tie.asc()).offset((max(1, page) - 1) * size).limit(size)


def sort_key(name: str) -> Column:
    return ascii_lower(F.col(name)) if name in TEXT_KEYS else F.col(name)


def seek(key: Column, tie: Column, ascending: bool, last: tuple | None) -> Column:
    """Whether a row comes after ``last``, a (key, tie), in the order of ``paged``; all do after None."""
    if last is None:
        return F.lit(True)
    value, at = last
    beyond = tie > at
    if value is None:
        same = key.isNull() & beyond
        return same | key.isNotNull() if ascending else same
    same = (key == value) & beyond
    return F.coalesce(key > value, F.lit(False)) | F.coalesce(same, F.lit(False)) if ascending else key.isNull() | (key < value) | same


def page_after(df: DataFrame, key: Column, tie: str, ascending: bool, last: tuple | None, size: int) -> DataFrame:
    """The page behind a row, with its ``sort_key``: a filter and a top list of one page, however deep it lies."""
    rows = df.withColumn("sort_key", key).where(seek(F.col("sort_key"), F.col(tie), ascending, last))
    return paged(rows, [F.col("sort_key")], F.col(tie), ascending, 1, size)


def end_of(page: DataFrame, tie: str) -> tuple | None:
    """(sort_key, tie) of the last row of a page of ``page_after``, None of an empty one; a page has MAX_PAGE rows at most."""
    rows = page.select("sort_key", tie).collect()
    return tuple(rows[-1]) if rows else None


def _sorted_by(found: DataFrame, difficulties: DataFrame, q: Query) -> tuple[DataFrame, Column]:
    """What is found, with what its order needs, and the order's key."""
    key = q.sort if q.sort in SORT_KEYS else "upload_time"
    return with_stars(found, difficulties, q.filters.stars_source) if key == "stars" else found, sort_key(key)


def _page(found: DataFrame, difficulties: DataFrame, q: Query) -> DataFrame:
    rows, key = _sorted_by(found, difficulties, q)
    return paged(rows, [key], F.col("map_id"), q.ascending, q.page, q.page_size).select(*found.columns)


def query_catalog(songs: DataFrame, difficulties: DataFrame, q: Query) -> tuple[DataFrame, DataFrame]:
    """The page's rows, and one row with the total of all that pass."""
    found = catalog_filter(songs, difficulties, q.filters)
    return _page(found, difficulties, q), found.agg(F.count(F.lit(1)).alias("total"))


def observed(found: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows whose number, ``total``, is seen while they are read for something else."""
    seen = Observation()
    return found.observe(seen, F.count(F.lit(1)).alias("total")), seen


def catalog_page(songs: DataFrame, difficulties: DataFrame, q: Query) -> tuple[DataFrame, Observation]:
    """The page's rows, and the total of all that pass, which is there once the page has been read: one pass for both."""
    found, seen = observed(catalog_filter(songs, difficulties, q.filters))
    return _page(found, difficulties, q), seen


def with_total(page: DataFrame, seen: Observation) -> DataFrame:
    """A page, which has MAX_PAGE rows at most, with the total beside each row."""
    rows = page.collect()
    return page.sparkSession.createDataFrame(rows, page.schema).withColumn("total", F.lit(seen.get["total"]).cast("bigint"))


def catalog_after(songs: DataFrame, difficulties: DataFrame, q: Query, last: tuple | None) -> DataFrame:
    """The page behind ``last``, an ``end_of`` the page before; ``q.page`` is not used."""
    rows, key = _sorted_by(catalog_filter(songs, difficulties, q.filters), difficulties, q)
    return page_after(rows, key, "map_id", q.ascending, last, q.page_size).select(*songs.columns, "sort_key")


def tracks_found(tracks: DataFrame, search: str) -> DataFrame:
    return tracks.where(matches_any(LIBRARY_SEARCHED, search)) if search.strip() else tracks


def library_key(sort: str) -> Column:
    return sort_key(sort if sort in LIBRARY_SORT_KEYS else "artist")


def query_tracks(tracks: DataFrame, search: str = "", sort: str = "artist", ascending: bool = False, page: int = 1, page_size: int = LIBRARY_PAGE) -> tuple[DataFrame, DataFrame]:
    found = tracks_found(tracks, search)
    rows = paged(found, [library_key(sort)], F.col("id"), ascending, page, page_size).select(*LIBRARY_COLUMNS)
    return rows, found.agg(F.count(F.lit(1)).alias("total"))


def library_page(tracks: DataFrame, search: str = "", sort: str = "artist", ascending: bool = False, page: int = 1, page_size: int = LIBRARY_PAGE) -> tuple[DataFrame, Observation]:
    """As ``query_tracks``, the total seen while the page is read."""
    found, seen = observed(tracks_found(tracks, search))
    return paged(found, [library_key(sort)], F.col("id"), ascending, page, page_size).select(*LIBRARY_COLUMNS), seen


def library_after(tracks: DataFrame, last: tuple | None, search: str = "", sort: str = "artist", ascending: bool = False, page_size: int = LIBRARY_PAGE) -> DataFrame:
    """The page behind ``last``, an ``end_of`` the page before."""
    return page_after(tracks_found(tracks, search), library_key(sort), "id", ascending, last, page_size).select(*LIBRARY_COLUMNS, "sort_key")


def difficulties_of(difficulties: DataFrame, map_ids: DataFrame) -> DataFrame:
    """Children of some songs, in order."""
    ids = map_ids.select(F.col("map_id").alias("_id")).distinct()
    return difficulties.join(ids, F.col("song_map_id") == F.col("_id"), "left_semi").orderBy("song_map_id", "characteristic", "difficulty")


def song_detail(songs: DataFrame, difficulties: DataFrame, tag_list: list[str]) -> DataFrame:
    """Songs with labels, links and tag names, one row for each difficulty (one without, if there is none)."""
    child = difficulties.select(
        F.col("song_map_id").alias("_id"),
        "characteristic",
        "difficulty",
        C.characteristic_label(F.col("characteristic")).alias("characteristic_label"),
        C.difficulty_label(F.col("difficulty")).alias("difficulty_label"),
        "stars_ss",
        "stars_bl",
        "njs",
        "bombs",
        "notes",
        "obstacles",
        C.flag_labels(F.col("mods"), C.MOD_LABELS).alias("mod_labels"),
    )
    parent = songs.select(
        "map_id",
        "song_name",
        C.flag_labels(F.col("ranked_states"), C.RANKED_LABELS).alias("ranked_labels"),
        C.flag_labels(F.col("upload_flags"), C.UPLOAD_LABELS).alias("upload_labels"),
        C.tag_names(F.col("tags"), F.array(*(F.lit(t) for t in tag_list))).alias("tag_names"),
        C.duration_text(F.col("duration")).alias("duration_text"),
        C.iso_date(F.col("upload_time")).alias("uploaded"),
        C.map_page_url(F.col("key")).alias("page_url"),
    )
    return parent.join(child, F.col("map_id") == F.col("_id"), "left").drop("_id").orderBy("map_id", "characteristic", "difficulty")


def catalog_stats(songs: DataFrame, meta: DataFrame) -> DataFrame:
    """Song count, end of the scrape and tag list."""
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    known = meta.agg(value("scrape_ended_time").cast("bigint").alias("scrape_ended_time"), F.from_json(value("tag_list"), "array<string>").alias("tag_list"))
    return songs.agg(F.count(F.lit(1)).alias("song_count")).join(known, F.lit(True))


def library_stats(tracks: DataFrame) -> DataFrame:
    return tracks.agg(F.count(F.lit(1)).alias("track_count"), F.max("fetched_at").alias("last_fetched_at"))


def all_songs(songs: DataFrame) -> DataFrame:
    return songs


def all_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.orderBy("artist", "title")
