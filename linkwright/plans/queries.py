"""The library's queries on the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions import columns as C
from linkwright.functions import similarity as S
from linkwright.functions import textkeys as T
from linkwright.plans import linkage_sql as L
from linkwright.operators import catalog as cat
from linkwright.operators import linkage as link
from linkwright.operators import results as res
from linkwright.operators import search_index
from linkwright.operators.catalog import Filters, Query
from linkwright.plans.fixtures import SCRAPED, TAGS, view, with_views
from linkwright.sources import library, sinks, snapshots, store
from linkwright.storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return keep


def songs(spark, d):
    return view(spark, d, "songs")


def difficulties(spark, d):
    return view(spark, d, "difficulties")


def tracks(spark, d):
    return view(spark, d, "tracks")


def scored(spark, d):
    return view(spark, d, "scored")


def _known(name):
    """Missing numbers as -1, so that tables compare whatever a driver makes of nulls among integers."""
    return F.coalesce(name, F.lit(-1)).alias(name)


TAG_SQL = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"
PARTS = 64
SNAPSHOT_SONGS = 500


# ---- sources ----


def nested(spark, d):
    return snapshots.nest(songs(spark, d), difficulties(spark, d), F.col("map_id") % PARTS, TAGS)


def nested_by_size(spark, d):
    """Snapshots of SNAPSHOT_SONGS songs: their number grows with the table, not their size."""
    return snapshots.nest(songs(spark, d), difficulties(spark, d), F.floor(F.col("map_id") / SNAPSHOT_SONGS), TAGS)


query("s01_flatten_songs", "SELECT * REPLACE (CASE WHEN uploader_name IS NULL THEN level_author ELSE uploader_name END AS uploader_name) FROM songs")(
    lambda spark, d: snapshots.flatten_songs(snapshots.validate_snapshots(nested_by_size(spark, d)))
)
query("s02_flatten_difficulties", "SELECT difficulties.* FROM difficulties JOIN songs ON song_map_id = map_id")(lambda spark, d: snapshots.flatten_difficulties(nested_by_size(spark, d)))


@query("s03_validate_snapshots",
    f"SELECT CAST(map_id % {PARTS} AS INT) AS part, CASE WHEN map_id % {PARTS} % 4 = 1 THEN 'unsupported format version 2' "
    f"ELSE 'hash blob too short' END AS error FROM songs WHERE map_id % {PARTS} % 4 IN (1, 2) GROUP BY ALL")
def s03(spark, d):
    n = nested(spark, d).withColumn("part", (F.col("songs")[0]["map_id"] % PARTS).cast("int"))
    n = n.withColumn("format_version", F.when(F.col("part") % 4 == 1, 2).otherwise(F.col("format_version")))
    n = n.withColumn("song_hashes", F.when(F.col("part") % 4 == 2, F.substring("song_hashes", F.lit(1), F.length("song_hashes") - 1)).otherwise(F.col("song_hashes")))
    return snapshots.split_snapshots(n)[1].select("part", "error")


query(
    "s04_snapshot_meta",
    f"SELECT key, value, count(*) AS n FROM (SELECT DISTINCT map_id % {PARTS} AS p FROM songs) CROSS JOIN "
        f"(SELECT 'scrape_ended_time' AS key, '{SCRAPED}' AS value UNION ALL "
        f"SELECT 'tag_list', '[\"' || array_to_string({TAG_SQL}, '\",\"') || '\"]') GROUP BY 1, 2",
)(lambda spark, d: snapshots.snapshot_meta(nested(spark, d)).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")))


def pages(spark, d):
    """Pages of a hundred tracks: every seventh failed, every eleventh without results."""
    t = tracks(spark, d).withColumn("page", F.floor(F.col("id").cast("long") / 100))
    # no artist stands for a missing one
    song = F.struct("id", "title", F.lit(False).alias("isDir"), F.when(F.col("id").cast("long") % 13 != 0, F.col("artist")).alias("artist"), "album", "duration", "year", F.lit(7).alias("track"))
    p = t.groupBy("page").agg(F.collect_list(song).alias("song"))
    failed = F.struct(F.lit("failed").alias("status"), F.lit("1.16.1").alias("version"), F.struct(F.lit(40).alias("code"), F.lit("Wrong username or password").alias("message")).alias("error"))
    bare = F.struct(F.lit("ok").alias("status"), F.lit("1.16.1").alias("version"))
    full = F.struct(F.lit("ok").alias("status"), F.lit("1.16.1").alias("version"), F.struct("song").alias("searchResult3"))
    wrap = lambda s: F.to_json(F.struct(s.alias("subsonic-response")))
    return p.select("page", F.when(F.col("page") % 7 == 3, wrap(failed)).when(F.col("page") % 11 == 5, wrap(bare)).otherwise(wrap(full)).alias("json"))


_OK = "(CAST(id AS BIGINT) // 100) % 7 <> 3 AND (CAST(id AS BIGINT) // 100) % 11 <> 5"
query("s05_read_track_pages",
    f"SELECT id, title, CASE WHEN CAST(id AS BIGINT) % 13 <> 0 THEN artist END AS artist, album, coalesce(duration, -1) "
    f"AS duration, coalesce(year, -1) AS year, 7 AS track FROM tracks WHERE {_OK}")(
    lambda spark, d: library.tracks_of(library.split_ok_failed(library.parse_pages(pages(spark, d)))[0]).select("id", "title", "artist", "album", _known("duration"), _known("year"), "track")
)
query("s06_failed_pages",
    "SELECT 'failed' AS status, 'Wrong username or password (code 40)' AS error, count(DISTINCT CAST(id AS BIGINT) // 100) "
    "AS n FROM tracks WHERE (CAST(id AS BIGINT) // 100) % 7 = 3")(
    lambda spark, d: library.split_ok_failed(library.parse_pages(pages(spark, d)))[1].groupBy("response.status", "error").agg(F.count(F.lit(1)).alias("n"))
)
_KEY = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', '', 'g')"
_PROJECTED = (
    f"SELECT id, title, coalesce(a, '') AS artist, {_KEY.format("coalesce(a, '') || ' ' || title")} "
    f"AS normalized_key, album, coalesce(duration, -1) AS duration, coalesce(year, -1) AS year, 7 AS track_number, 123 "
    f"AS fetched_at FROM (SELECT *, CASE WHEN CAST(id AS BIGINT) % 13 <> 0 THEN artist END AS a FROM tracks WHERE {_OK})"
)


@query("s07_project_tracks", _PROJECTED)
def s07(spark, d):
    raw = library.tracks_of(library.split_ok_failed(library.parse_pages(pages(spark, d)))[0])
    return library.project_tracks(raw, F.lit(123)).select("id", "title", "artist", "normalized_key", "album", _known("duration"), _known("year"), "track_number", "fetched_at")


def _out(spark, name):
    import uuid

    return f"{shared_dir(spark)}/linkwright/out-{name}-{uuid.uuid4().hex}"


@query("s08_write_catalog", "SELECT (SELECT count(*) FROM songs) AS songs, (SELECT count(*) FROM difficulties) AS difficulties")
def s08(spark, d):
    return sinks.write_catalog(songs(spark, d), difficulties(spark, d), snapshots.snapshot_meta(nested(spark, d)), _out(spark, "catalog"))


@query("s09_write_and_clear_tracks", "SELECT count(*) AS tracks, 0 AS after_clear FROM tracks")
def s09(spark, d):
    at = _out(spark, "tracks")
    n = sinks.write_tracks(tracks(spark, d), at).first()[0]
    sinks.clear_tracks(spark, at)
    return sinks.read_tracks(spark, at).agg(F.lit(n).cast("long").alias("tracks"), F.count(F.lit(1)).alias("after_clear"))


@query("s10_export_for_matching", "SELECT map_id, key, song_name, song_author, level_author FROM songs")
def s10(spark, d):
    at = _out(spark, "export")
    sinks.export_for_matching(songs(spark, d), tracks(spark, d), at)
    return spark.read.schema("map_id bigint, key string, song_name string, song_author string, level_author string").json(f"{at}/songs")


query("s10_tracks_for_matching", "SELECT id, title, coalesce(artist, '') AS artist, album FROM tracks")(lambda spark, d: sinks.tracks_for_matching(tracks(spark, d)))
query("s11_all_songs", "SELECT map_id, song_name FROM songs")(lambda spark, d: cat.all_songs(songs(spark, d)).select("map_id", "song_name"))
query("s11_all_tracks", "SELECT id, artist, title FROM tracks")(lambda spark, d: cat.all_tracks(tracks(spark, d)).select("id", "artist", "title"))

# ---- projections ----

query("p01_rating", "SELECT map_id, rating FROM songs")(lambda spark, d: songs(spark, d).select("map_id", C.rating(F.col("upvotes"), F.col("downvotes")).alias("rating")))
query("p02_map_key", "SELECT map_id, printf('%x', map_id) AS key FROM songs")(lambda spark, d: songs(spark, d).select("map_id", C.map_key(F.col("map_id")).alias("key")))
query("p03_hash_at", "SELECT map_id, hash FROM songs")(lambda spark, d: snapshots.flatten_songs(nested_by_size(spark, d)).select("map_id", "hash"))
query("p04_uploader",
    "SELECT map_id, CASE WHEN map_id % 3 = 0 THEN level_author WHEN map_id % 3 = 1 THEN '' ELSE uploader_name END "
    "AS uploader FROM songs")(
    lambda spark, d: songs(spark, d).select("map_id", C.uploader(F.when(F.col("map_id") % 3 == 1, "").when(F.col("map_id") % 3 == 2, F.col("uploader_name")), F.col("level_author")).alias("uploader"))
)
query("p05_hundredths", "SELECT song_map_id, notes, notes / 100.0e0 AS stars FROM difficulties")(lambda spark, d: difficulties(spark, d).select("song_map_id", "notes", C.hundredths(F.col("notes")).alias("stars")))
query("p06_tag_names",
    f"SELECT map_id, array_to_string([{TAG_SQL}[i + 1] FOR i IN range(0, 17) IF (tags >> i) & 1 = 1], ',') AS tag_names "
    f"FROM songs")(
    lambda spark, d: songs(spark, d).select("map_id", F.array_join(C.tag_names(F.col("tags"), F.array(*map(F.lit, TAGS))), ",").alias("tag_names"))
)
query("p07_tag_positions",
    "SELECT name, max(pos) AS bit FROM (SELECT song_author AS name, row_number() OVER (PARTITION BY map_id % 64 "
    "ORDER BY map_id) - 1 AS pos FROM songs) GROUP BY 1")(
    lambda spark, d: snapshots.tag_positions(
        songs(spark, d).groupBy(F.col("map_id") % 64).agg(F.transform(F.sort_array(F.collect_list(F.struct("map_id", "song_author"))), lambda s: s["song_author"]).alias("tag_list"))
    )
)
query("p08_has_flag", "SELECT map_id, (ranked_states & 4) = 4 AS qualified, (upload_flags & 2) = 2 AS verified FROM songs")(
    lambda spark, d: songs(spark, d).select("map_id", C.has_flag(F.col("ranked_states"), 4).alias("qualified"), C.has_flag(F.col("upload_flags"), 2).alias("verified"))
)


def _labels_sql(c: str, labels: dict[int, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} & {b} = {b} THEN '{n}' END" for b, n in labels.items()) + "], lambda x: x IS NOT NULL), ',')"


query("p09_flag_labels",
    f"SELECT map_id, {_labels_sql('ranked_states', C.RANKED_LABELS)} "
    f"AS ranked, {_labels_sql('upload_flags', C.UPLOAD_LABELS)} AS upload FROM songs")(
    lambda spark, d: songs(spark, d).select(
        "map_id", F.array_join(C.flag_labels(F.col("ranked_states"), C.RANKED_LABELS), ",").alias("ranked"), F.array_join(C.flag_labels(F.col("upload_flags"), C.UPLOAD_LABELS), ",").alias("upload")
    )
)
query("p09_mod_labels", f"SELECT mods, {_labels_sql('mods', C.MOD_LABELS)} AS labels, count(*) AS n FROM difficulties GROUP BY 1, 2")(
    lambda spark, d: difficulties(spark, d).groupBy("mods", F.array_join(C.flag_labels(F.col("mods"), C.MOD_LABELS), ",").alias("labels")).agg(F.count(F.lit(1)).alias("n"))
)


def _code_sql(c: str, names) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + f" ELSE 'Unknown(' || CAST({c} AS VARCHAR) || ')' END"


query("p10_code_labels",
    f"SELECT {_code_sql('bombs', C.CHARACTERISTICS)} AS characteristic, {_code_sql('obstacles', C.DIFFICULTIES)} "
    f"AS difficulty, count(*) AS n FROM difficulties GROUP BY 1, 2")(
    lambda spark, d: difficulties(spark, d).groupBy(C.characteristic_label(F.col("bombs")).alias("characteristic"), C.difficulty_label(F.col("obstacles")).alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))
)
query("p11_duration_text",
    "SELECT map_id, CAST(d // 60 AS VARCHAR) || ':' || lpad(CAST(d % 60 AS VARCHAR), 2, '0') AS text FROM "
    "(SELECT map_id, duration * 7 + map_id % 60 AS d FROM songs)")(
    lambda spark, d: songs(spark, d).select("map_id", C.duration_text(F.col("duration") * 7 + F.col("map_id") % 60).alias("text"))
)
query(
    "p12_iso_times",
    "SELECT map_id, strftime(make_timestamp(upload_time * 1000000), '%Y-%m-%d') "
        "AS day, strftime(make_timestamp(upload_time * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') "
        "AS at, strftime(make_timestamp(upload_time * 1000000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(map_id % 1000 "
        "AS VARCHAR), 3, '0') || 'Z' AS at_ms FROM songs",
)(lambda spark, d: songs(spark, d).select("map_id", C.iso_date(F.col("upload_time")).alias("day"), C.iso_datetime(F.col("upload_time")).alias("at"), C.iso_datetime_ms(F.col("upload_time") * 1000 + F.col("map_id") % 1000).alias("at_ms")))
query("p13_links",
    f"SELECT map_id, '{C.ONE_CLICK}' || key AS one_click, '{C.MAP_PAGE}' || key AS page, '{C.DOWNLOAD}' || key "
    f"AS zip, '{C.COVER}' || hash || '.jpg' AS cover FROM songs")(
    lambda spark, d: songs(spark, d).select("map_id", C.one_click_url(F.col("key")).alias("one_click"), C.map_page_url(F.col("key")).alias("page"), C.download_url(F.col("key")).alias("zip"), C.cover_url(F.col("hash")).alias("cover"))
)
query("p14_percent_text", "SELECT map_id, CAST(CAST(floor(rating * 100 + 0.5) AS BIGINT) AS VARCHAR) AS percent FROM songs")(lambda spark, d: songs(spark, d).select("map_id", C.percent_text(F.col("rating")).alias("percent")))
query("p14_percent_one_digit", "SELECT track_id, map_id, printf('%.1f', floor(score * 1000 + 0.5) / 10) AS percent FROM scored")(
    lambda spark, d: scored(spark, d).select("track_id", "map_id", C.percent_text(F.col("score"), 1).alias("percent"))
)

# ---- filters ----

FILTERS: dict[str, tuple[Filters, str]] = {
    "f01_text_search": (Filters(search=" Red_Widget "),
        "lower(song_name) LIKE '%red_widget%' OR lower(song_author) LIKE '%red_widget%' "
        "OR lower(level_author) LIKE '%red_widget%' OR lower(uploader_name) LIKE '%red_widget%' "
        "OR lower(key) LIKE '%red_widget%' OR lower(hash) LIKE '%red_widget%'"),
    "f02_ranked_all": (Filters(ranked_states=5), "ranked_states & 5 = 5"),
    "f03_ranked_any": (Filters(ranked_states_any=6), "ranked_states & 6 > 0"),
    "f04_upload_flags": (Filters(upload_flags=2), "upload_flags & 2 = 2"),
    "f05_bpm": (Filters(bpm_min=185.0, bpm_max=230.0), "bpm >= 185 AND bpm <= 230"),
    "f06_upload_time": (Filters(upload_from=SCRAPED + 36000, upload_to=SCRAPED + 3600000), f"upload_time BETWEEN {SCRAPED + 36000} AND {SCRAPED + 3600000}"),
    "f07_tags_any": (Filters(tags=(3, 9)), "tags & 520 > 0"),
    "f08_characteristic": (Filters(characteristics=(1, 2)), "EXISTS (FROM difficulties WHERE song_map_id = map_id AND characteristic IN (1, 2))"),
    "f09_difficulty": (Filters(difficulties=(4,)), "EXISTS (FROM difficulties WHERE song_map_id = map_id AND difficulty = 4)"),
    "f10_stars": (Filters(stars_min=9.0, stars_max=10.0, stars_source="ss"), "EXISTS (FROM difficulties WHERE song_map_id = map_id AND stars_ss >= 9 AND stars_ss <= 10)"),
    "f10_stars_other_source": (Filters(stars_min=8.0, stars_source="bl"), "EXISTS (FROM difficulties WHERE song_map_id = map_id AND stars_bl >= 8)"),
    "f11_mods_any": (Filters(mods=6), "EXISTS (FROM difficulties WHERE song_map_id = map_id AND mods & 6 > 0)"),
    "f12_min_counts": (Filters(min_notes=900, min_obstacles=3, min_bombs=0), "EXISTS (FROM difficulties WHERE song_map_id = map_id AND notes >= 900 AND obstacles >= 3 AND bombs >= 0)"),
    "j01_same_child": (Filters(characteristics=(1,), difficulties=(4,), stars_min=5.0, mods=1, bpm_min=190.0),
        "bpm >= 190 AND EXISTS (FROM difficulties WHERE song_map_id = map_id AND characteristic = 1 AND difficulty = 4 "
        "AND stars_ss >= 5 AND mods & 1 > 0)"),
}
for _name, (_f, _sql) in FILTERS.items():
    query(_name, f"SELECT map_id, song_name FROM songs WHERE {_sql}")(lambda spark, d, f=_f: cat.catalog_filter(songs(spark, d), difficulties(spark, d), f).select("map_id", "song_name"))

_LIB = "lower(title) LIKE '%ring%' OR lower(artist) LIKE '%ring%' OR lower(album) LIKE '%ring%'"
query("f13_library_search", f"SELECT id, title FROM tracks WHERE {_LIB}")(lambda spark, d: tracks(spark, d).where(cat.matches_any(cat.LIBRARY_SEARCHED, " RING ")).select("id", "title"))
query("f14_result_search",
    "SELECT DISTINCT id FROM scored JOIN tracks ON id = track_id WHERE contains(lower(title), 'widg') "
    "OR contains(lower(artist), 'widg')")(
    lambda spark, d: res.search_results(tracks(spark, d).join(scored(spark, d), F.col("id") == F.col("track_id"), "left_semi"), "WidG").select("id")
)
query("f15_min_rating",
    "SELECT track_id, scored.map_id, score FROM scored JOIN songs ON scored.map_id = songs.map_id "
    "WHERE rating >= 80 / 100.0e0")(lambda spark, d: res.prune_by_rating(scored(spark, d), songs(spark, d), 80))



def _searched(spark, d, rows, id_col, columns, search):
    """A search with postings that were written before."""
    at = _out(spark, "postings")
    store.publish(spark, at, {"postings": search_index.search_postings(rows, id_col, columns)}, {"postings": "trigram"})
    return search_index.indexed_search(rows, store.read(spark, at)["postings"], search, id_col, columns)


query("f01_indexed_search", f"SELECT map_id, song_name FROM songs WHERE {FILTERS['f01_text_search'][1]}")(lambda spark, d: _searched(spark, d, songs(spark, d), "map_id", cat.SEARCHED, " Red_Widget ").select("map_id", "song_name"))
query("f13_indexed_search", f"SELECT id, title FROM tracks WHERE {_LIB}")(lambda spark, d: _searched(spark, d, tracks(spark, d), "id", cat.LIBRARY_SEARCHED, " RING ").select("id", "title"))
query("f08_characteristic_and_notes",
    "SELECT map_id, song_name FROM songs WHERE EXISTS (FROM difficulties WHERE song_map_id = map_id AND characteristic IN "
    "(1, 2) AND notes >= 960)")(
    lambda spark, d: cat.catalog_filter(songs(spark, d), difficulties(spark, d), Filters(characteristics=(1, 2), min_notes=960)).select("map_id", "song_name")
)
query("f11_mods_of_hard_ones",
    "SELECT map_id, song_name FROM songs WHERE EXISTS (FROM difficulties WHERE song_map_id = map_id AND mods & 1 > 0 "
    "AND difficulty = 4 AND stars_ss >= 8)")(
    lambda spark, d: cat.catalog_filter(songs(spark, d), difficulties(spark, d), Filters(mods=1, difficulties=(4,), stars_min=8.0)).select("map_id", "song_name")
)
# ---- joins, aggregates and orders of the catalog ----

query("j02_max_stars", "SELECT map_id, max(stars_ss) AS stars FROM songs LEFT JOIN difficulties ON song_map_id = map_id GROUP BY 1")(lambda spark, d: cat.with_stars(songs(spark, d), difficulties(spark, d)).select("map_id", "stars"))
query("j03_children", "SELECT difficulties.* FROM difficulties WHERE song_map_id IN (SELECT map_id FROM songs WHERE ranked_states = 3)")(
    lambda spark, d: cat.difficulties_of(difficulties(spark, d), songs(spark, d).where("ranked_states = 3").select("map_id"))
)
query("a01_filtered_count",
    "SELECT count(*) AS total FROM songs WHERE bpm >= 200 AND EXISTS (FROM difficulties WHERE song_map_id = map_id "
    "AND notes >= 500)")(
    lambda spark, d: cat.query_catalog(songs(spark, d), difficulties(spark, d), Query(Filters(bpm_min=200.0, min_notes=500)))[1]
)
query("a02_catalog_stats", f"SELECT count(*) AS song_count, CAST({SCRAPED} AS BIGINT) AS scrape_ended_time, {len(TAGS)} AS tags FROM songs")(
    lambda spark, d: cat.catalog_stats(songs(spark, d), snapshots.snapshot_meta(nested(spark, d))).select("song_count", "scrape_ended_time", F.size("tag_list").alias("tags"))
)
query("a03_library_stats", "SELECT count(*) AS track_count, max(fetched_at) AS last_fetched_at FROM tracks")(lambda spark, d: cat.library_stats(tracks(spark, d)))
query("a04_stars_by_song", "SELECT song_map_id, max(stars_bl) AS stars FROM difficulties GROUP BY 1")(lambda spark, d: cat.max_stars(difficulties(spark, d), "bl"))
query("w01_keep_last", "SELECT l_partkey AS id, max(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1")(
    lambda spark, d: snapshots.keep_last(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")), "id", "pos")
)
for _key in cat.SORT_KEYS:
    _col = "(SELECT max(stars_ss) FROM difficulties WHERE song_map_id = map_id)" if _key == "stars" else f"lower({_key})" if _key in cat.TEXT_KEYS else _key
    query(f"l01_sort_{_key}",
        f"SELECT map_id, row_number() OVER () AS n FROM (SELECT map_id FROM songs ORDER BY {_col} DESC NULLS LAST, map_id "
        f"LIMIT 50)".replace("row_number() OVER () AS n", "0 AS n"))(
        lambda spark, d, k=_key: cat.query_catalog(songs(spark, d), difficulties(spark, d), Query(sort=k))[0].select("map_id", F.lit(0).alias("n"))
    )


def in_order(page):
    """A page's rows with their positions in it, as they come."""
    return page.coalesce(1).withColumn("position", F.monotonically_increasing_id())


for _key in cat.SORT_KEYS:
    _col = "(SELECT max(stars_ss) FROM difficulties WHERE song_map_id = map_id)" if _key == "stars" else f"lower({_key})" if _key in cat.TEXT_KEYS else _key
    query(f"l01_order_{_key}",
        f"SELECT map_id, row_number() OVER (ORDER BY {_col} DESC NULLS LAST, map_id) - 1 AS position FROM songs ORDER BY position "
        f"LIMIT 50")(
        lambda spark, d, k=_key: in_order(cat.query_catalog(songs(spark, d), difficulties(spark, d), Query(sort=k))[0]).select("map_id", "position")
    )
query("l02_catalog_order",
    "SELECT map_id, row_number() OVER (ORDER BY rating, map_id) - 76 AS position FROM songs ORDER BY position "
    "LIMIT 25 OFFSET 75")(
    lambda spark, d: in_order(cat.query_catalog(songs(spark, d), difficulties(spark, d), Query(sort="rating", ascending=True, page=4, page_size=25))[0]).select("map_id", "position")
)
query("l03_library_order",
    f"SELECT id, row_number() OVER (ORDER BY lower(title) DESC, id) - 101 AS position FROM tracks WHERE {_LIB} "
    f"ORDER BY position LIMIT 100 OFFSET 100")(
    lambda spark, d: in_order(cat.query_tracks(tracks(spark, d).withColumn("normalized_key", F.lit("")), "ring", "title", page=2)[0]).select("id", "position")
)
for _key in cat.LIBRARY_SORT_KEYS:
    _col = f"lower({_key})" if _key in cat.TEXT_KEYS else _key
    for _way, _up, _nulls in (("asc", True, "FIRST"), ("desc", False, "LAST")):
        query(f"l03_order_{_key}_{_way}",
            f"SELECT id, row_number() OVER (ORDER BY {_col} {_way} NULLS {_nulls}, id) - 1 AS position FROM tracks ORDER BY position "
            f"LIMIT 100")(
            lambda spark, d, k=_key, up=_up: in_order(cat.query_tracks(tracks(spark, d).withColumn("normalized_key", F.lit("")), "", k, up)[0]).select("id", "position")
        )
query("l02_catalog_page","SELECT map_id FROM songs ORDER BY rating ASC, map_id LIMIT 25 OFFSET 75")(
    lambda spark, d: cat.query_catalog(songs(spark, d), difficulties(spark, d), Query(sort="rating", ascending=True, page=4, page_size=25))[0].select("map_id")
)
query("l03_library_page",
    f"SELECT id, title, artist, album, coalesce(duration, -1) AS duration, coalesce(year, -1) AS year, fetched_at FROM tracks "
    f"WHERE {_LIB} ORDER BY lower(title) DESC, id LIMIT 100 OFFSET 100")(
    lambda spark, d: cat.query_tracks(tracks(spark, d).withColumn("normalized_key", F.lit("")), "ring", "title", page=2)[0].select("id", "title", "artist", "album", _known("duration"), _known("year"), "fetched_at")
)
_K12_PAGE = (
    "SELECT * FROM songs WHERE bpm BETWEEN 190 AND 250 AND EXISTS (FROM difficulties WHERE song_map_id = map_id "
    "AND difficulty IN (3, 4) AND stars_ss >= 4) ORDER BY (SELECT max(stars_ss) FROM difficulties "
    "WHERE song_map_id = map_id) DESC, map_id LIMIT 50"
)
query("k12_query_catalog", _K12_PAGE)(
    lambda spark, d: cat.query_catalog(songs(spark, d), difficulties(spark, d), Query(Filters(bpm_min=190.0, bpm_max=250.0, difficulties=(3, 4), stars_min=4.0), sort="stars"))[0]
)
query("k13_query_tracks", f"SELECT count(*) AS total FROM tracks WHERE {_LIB}")(lambda spark, d: cat.query_tracks(tracks(spark, d).withColumn("normalized_key", F.lit("")), "ring")[1])
_K12 = Query(Filters(bpm_min=190.0, bpm_max=250.0, difficulties=(3, 4), stars_min=4.0), sort="stars")
_K12_FOUND = (
    "FROM songs WHERE bpm BETWEEN 190 AND 250 AND EXISTS (FROM difficulties WHERE song_map_id = map_id AND difficulty IN "
    "(3, 4) AND stars_ss >= 4)"
)


@query("k12_on_written_tables", _K12_PAGE)
def k12_on_written_tables(spark, d):
    """The query on tables dealt out by song."""
    at = _out(spark, "catalog")
    sinks.write_catalog(songs(spark, d), difficulties(spark, d), snapshots.snapshot_meta(nested(spark, d)), at)
    tables = sinks.read_catalog(spark, at)
    return cat.query_catalog(tables["songs"], tables["difficulties"], _K12)[0]


query(
    "k12_page_and_total",
    f"SELECT map_id, song_name, total FROM (SELECT *, count(*) OVER () AS total {_K12_FOUND}) ORDER BY (SELECT max(stars_ss) "
        f"FROM difficulties WHERE song_map_id = map_id) DESC NULLS LAST, map_id LIMIT 50",
)(lambda spark, d: cat.with_total(*cat.catalog_page(songs(spark, d), difficulties(spark, d), _K12)).select("map_id", "song_name", "total"))
query("k13_page_and_total",
    f"SELECT id, title, total FROM (SELECT *, count(*) OVER () AS total FROM tracks WHERE {_LIB}) "
    f"ORDER BY lower(artist) DESC, id LIMIT 100")(
    lambda spark, d: cat.with_total(*cat.library_page(tracks(spark, d).withColumn("normalized_key", F.lit("")), "ring")).select("id", "title", "total")
)


def after(make, tie, pages=2):
    """The page that is reached by going on from the last row of each page before it."""
    last = None
    for _ in range(pages - 1):
        last = cat.end_of(make(last), tie)
    return in_order(make(last))


for _key in cat.SORT_KEYS:
    _col = "(SELECT max(stars_ss) FROM difficulties WHERE song_map_id = map_id)" if _key == "stars" else f"lower({_key})" if _key in cat.TEXT_KEYS else _key
    for _way, _up, _nulls in (("asc", True, "FIRST"), ("desc", False, "LAST")):
        query(f"l02_after_{_key}_{_way}",
            f"SELECT map_id, row_number() OVER (ORDER BY {_col} {_way} NULLS {_nulls}, map_id) - 81 AS position FROM songs "
            f"ORDER BY position LIMIT 40 OFFSET 80")(
            lambda spark, d, k=_key, up=_up: after(lambda last: cat.catalog_after(songs(spark, d), difficulties(spark, d), Query(sort=k, ascending=up, page_size=40), last), "map_id", 3).select("map_id", "position")
        )
for _key in cat.LIBRARY_SORT_KEYS:
    _col = f"lower({_key})" if _key in cat.TEXT_KEYS else _key
    for _way, _up, _nulls in (("asc", True, "FIRST"), ("desc", False, "LAST")):
        query(f"l03_after_{_key}_{_way}",
            f"SELECT id, row_number() OVER (ORDER BY {_col} {_way} NULLS {_nulls}, id) - 101 AS position FROM tracks "
            f"ORDER BY position LIMIT 100 OFFSET 100")(
            lambda spark, d, k=_key, up=_up: after(lambda last: cat.library_after(tracks(spark, d).withColumn("normalized_key", F.lit("")), last, "", k, up), "id").select("id", "position")
        )
query(
    "k14_song_detail",
    f"SELECT map_id, song_name, {_labels_sql('ranked_states', C.RANKED_LABELS)} "
        f"AS ranked_labels, {_code_sql('characteristic', C.CHARACTERISTICS)} "
        f"AS characteristic_label, {_code_sql('difficulty', C.DIFFICULTIES)} "
        f"AS difficulty_label, stars_ss, {_labels_sql('mods', C.MOD_LABELS)} AS mod_labels FROM songs LEFT JOIN difficulties "
        f"ON song_map_id = map_id",
)(
    lambda spark, d: cat.song_detail(songs(spark, d), difficulties(spark, d), TAGS).select(
        "map_id", "song_name", F.array_join("ranked_labels", ",").alias("ranked_labels"), "characteristic_label", "difficulty_label", "stars_ss", F.array_join("mod_labels", ",").alias("mod_labels")
    )
)

# ---- text keys ----

_SENTENCE = "split_part(coalesce(text, ''), '.', 1)"


def sentences(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.split_part(F.coalesce("text", F.lit("")), F.lit("."), F.lit(1)).alias("s"))


_DUP = f"(SELECT doc_id, {_SENTENCE} AS s FROM documents)"
_VARIANTS = "list_filter(list_distinct([regexp_replace({0}, '[^a-z0-9]+', '', 'g'), trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'))]), lambda v: v <> '')"
_STRIPPED = "regexp_replace({0}, '[^a-z0-9]+', '', 'g')"
_SPACED = "trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'))"
_LOW = "lower(strip_accents(s))"
query("n01_fold_lookalikes", f"SELECT doc_id, translate(s || '’–“', '’–“', '''-\"') AS folded FROM {_DUP}")(lambda spark, d: sentences(spark, d).select("doc_id", T.fold_lookalikes(F.concat("s", F.lit("’–“"))).alias("folded")))
query("n02_fold_diacritics", f"SELECT doc_id, strip_accents(s) AS folded FROM {_DUP}")(lambda spark, d: sentences(spark, d).select("doc_id", T.fold_diacritics(F.col("s")).alias("folded")))
query("n03_normalize_variants",
    f"SELECT doc_id, CASE WHEN a = b THEN a ELSE concat_ws('|', nullif(a, ''), nullif(b, '')) END AS variants FROM "
    f"(SELECT doc_id, {_STRIPPED.format(_LOW)} AS a, {_SPACED.format(_LOW)} AS b FROM {_DUP})")(
    lambda spark, d: sentences(spark, d).select("doc_id", F.array_join(T.normalize_variants(F.col("s")), "|").alias("variants"))
)
query("n04_strip_trailing_parens", "SELECT map_id, rtrim(regexp_replace(song_name, '\\s*\\([^()]*\\)$', '')) AS bare FROM songs")(
    lambda spark, d: link._looked_up(songs(spark, d).select("map_id", "song_name"), T.text_keys(songs(spark, d).select(F.col("song_name").alias("text"))), "song_name", bare="bare").select("map_id", "bare")
)
_FILLER = "[" + ", ".join(f"'{w}'" for w in T.FILLER_WORDS) + "]"
query("n05_strip_filler_words",
    f"SELECT map_id, trim(array_to_string(list_filter(string_split_regex(song_name, '\\s+'), lambda w: NOT "
    f"list_contains({_FILLER}, regexp_replace(lower(w), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'))), ' ')) AS kept FROM songs")(
    lambda spark, d: songs(spark, d).select("map_id", T.strip_filler_words(F.col("song_name")).alias("kept"))
)
query("n07_normalized_key", f"SELECT id, {_KEY.format("artist || ' ' || title")} AS normalized_key FROM tracks")(lambda spark, d: tracks(spark, d).select("id", T.normalized_key(F.col("artist"), F.col("title")).alias("normalized_key")))


def keys_of_songs(spark, d):
    return link.song_keys(songs(spark, d))


def keys_of_tracks(spark, d):
    return link.track_keys(tracks(spark, d))


def _texts(spark, d):
    return T.text_keys(songs(spark, d).select(F.explode(F.array("song_author", "song_name")).alias("text")))




def _texts_sql(columns):
    return f"WITH {L.KEYS} SELECT text, {columns} FROM keys SEMI JOIN (SELECT unnest([song_author, song_name]) AS text FROM songs) USING (text)"


query("n06_split_artist_credit", _texts_sql("array_to_string(credit, chr(10)) AS credit"))(lambda spark, d: _texts(spark, d).select("text", F.array_join("credit", "\n").alias("credit")))
query("n08_remix_tags",
    "SELECT DISTINCT song_name AS text, CASE WHEN contains(song_name, 'Alpha Remix') THEN 'alpha' "
    "WHEN contains(song_name, 'Beta Remix') THEN 'beta' WHEN contains(song_name, 'Gamma flip') THEN 'gamma' ELSE '' END "
    "AS tags FROM songs")(
    lambda spark, d: T.text_keys(songs(spark, d).select(F.col("song_name").alias("text"))).select("text", F.array_join("tags", "|").alias("tags"))
)
query("n09_field_variants", _texts_sql("array_to_string(title, '|') AS variants"))(lambda spark, d: _texts(spark, d).select("text", F.array_join("title", "|").alias("variants")))
query("n10_artist_variants", _texts_sql("array_to_string(artist, '|') AS variants"))(lambda spark, d: _texts(spark, d).select("text", F.array_join("artist", "|").alias("variants")))
query("n11_song_keys",
    f"WITH {L.SIDES} SELECT map_id, array_to_string(artist, '|') AS artist, array_to_string(title, '|') "
    f"AS title, array_to_string(tags, '|') AS tags FROM sk")(lambda spark, d: keys_of_songs(spark, d).select("map_id", F.array_join("artist", "|").alias("artist"), F.array_join("title", "|").alias("title"), F.array_join("tags", "|").alias("tags")))
query("n12_track_keys",
    f"WITH {L.TRACK_SIDE} SELECT id, array_to_string(artist, '|') AS artist, array_to_string(title, '|') "
    f"AS title, array_to_string(tags, '|') AS tags FROM tk")(lambda spark, d: keys_of_tracks(spark, d).select("id", F.array_join("artist", "|").alias("artist"), F.array_join("title", "|").alias("title"), F.array_join("tags", "|").alias("tags")))
_TRI = "CASE WHEN length(s) < 3 THEN [s] ELSE list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) END"
query("n13_trigrams", f"SELECT doc_id, array_to_string({_TRI}, '|') AS trigrams FROM {_DUP}")(lambda spark, d: sentences(spark, d).select("doc_id", F.array_join(T.trigrams(F.col("s")), "|").alias("trigrams")))
query("n14_unique_trigrams", f"SELECT doc_id, CASE WHEN length(s) < 3 THEN 0 ELSE len(list_distinct({_TRI})) END AS n FROM {_DUP}")(lambda spark, d: sentences(spark, d).select("doc_id", F.size(T.unique_trigrams(F.col("s"))).alias("n")))
query("n15_signature", f"SELECT doc_id, array_to_string([{_STRIPPED.format(_LOW)}, 'x'], '|') AS sig FROM {_DUP}")(
    lambda spark, d: sentences(spark, d).select("doc_id", T.signature(F.array(F.regexp_replace(F.lower(T.fold_diacritics(F.col("s"))), "[^a-z0-9]+", ""), F.lit("x"))).alias("sig"))
)

# The same six over whole texts. The SQL of the above is fixed to first sentences, so these have names and SQL of their own.


def whole_texts(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("s"))


_WHOLE = "(SELECT doc_id, coalesce(text, '') AS s FROM documents)"
for _name, _column, _made in [
    ("n01_fold_lookalikes", "folded", lambda s: T.fold_lookalikes(F.concat(s, F.lit("’–“")))),
    ("n02_fold_diacritics", "folded", T.fold_diacritics),
    ("n03_normalize_variants", "variants", lambda s: F.array_join(T.normalize_variants(s), "|")),
    ("n13_trigrams", "trigrams", lambda s: F.array_join(T.trigrams(s), "|")),
    ("n14_unique_trigrams", "n", lambda s: F.size(T.unique_trigrams(s))),
    ("n15_signature", "sig", lambda s: T.signature(F.array(F.regexp_replace(F.lower(T.fold_diacritics(s)), "[^a-z0-9]+", ""), F.lit("x")))),
]:
    query(f"{_name}_whole", ORACLES[_name].replace(_DUP, _WHOLE))(lambda spark, d, column=_column, made=_made: whole_texts(spark, d).select("doc_id", made(F.col("s")).alias(column)))

# Every look-alike by its code point, behind each whole text (fixed values).
_CODES = {
    "''": [*range(0x2018, 0x201C), 0x2039, 0x203A],
    '"': [*range(0x201C, 0x2020), 0xAB, 0xBB],
    "-": [*range(0x2010, 0x2016)],
    ".": [0x2026],
    "*": [0x2022],
    " ": [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000],
}
_ALIKE = "".join(chr(c) for codes in [*_CODES.values(), range(0xFF01, 0xFF5F)] for c in codes)
_FOLDED = " ".join(f"WHEN unicode(c) IN ({', '.join(map(str, codes))}) THEN '{plain}'" for plain, codes in _CODES.items())
query(
    "n01_fold_every_lookalike",
    f"SELECT doc_id, array_to_string(list_transform(string_split(s || '{_ALIKE}', ''), lambda c: "
    f"CASE {_FOLDED} WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE c END), '') AS folded FROM {_WHOLE}",
)(lambda spark, d: whole_texts(spark, d).select("doc_id", T.fold_lookalikes(F.concat("s", F.lit(_ALIKE))).alias("folded")))

# ---- similarity: names of consecutive parts ----


def name_pairs(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    a = p.select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("a"))
    b = p.select((F.col("p_partkey") * 3).alias("k"), F.col("p_name").alias("b"))
    return a.join(b, "k")


_PAIRS = (
    "(SELECT x.p_partkey AS k, x.p_name || ' ' || lower(x.p_type) AS a, y.p_name AS b, "
    "list_distinct(string_split(x.p_name || ' ' || lower(x.p_type), ' ')) AS ta, list_distinct(string_split(y.p_name, ' ')) "
    "AS tb FROM part x JOIN part y ON x.p_partkey = y.p_partkey * 3)"
)
_CONTAINS = "CASE WHEN a = b THEN 1.0e0 WHEN least(length(a), length(b)) >= 3 AND (contains(a, b) OR contains(b, a)) THEN 0.8e0 ELSE 0.0e0 END"
query("g03_word_jaccard", f"SELECT k, len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb)))::DOUBLE AS score FROM {_PAIRS}")(lambda spark, d: name_pairs(spark, d).select("k", S.word_jaccard(F.col("a"), F.col("b")).alias("score")))
query("g04_token_set", f"SELECT k, 2.0e0 * len(list_intersect(ta, tb)) / (len(ta) + len(tb)) AS score FROM {_PAIRS}")(lambda spark, d: name_pairs(spark, d).select("k", S.token_set(F.col("a"), F.col("b")).alias("score")))
query("g05_contains_score", f"SELECT k, {_CONTAINS} AS score FROM {_PAIRS}")(lambda spark, d: name_pairs(spark, d).select("k", S.contains_score(F.col("a"), F.col("b")).alias("score")))
query("g09_contains_significant",
    f"SELECT k, (least(length(a), length(b)) >= 6 OR contains(CASE WHEN length(a) <= length(b) THEN a ELSE b END, ' ')) "
    f"AND contains(' ' || CASE WHEN length(a) <= length(b) THEN b ELSE a END || ' ', ' ' || CASE "
    f"WHEN length(a) <= length(b) THEN a ELSE b END || ' ') AS hit FROM {_PAIRS}")(
    lambda spark, d: name_pairs(spark, d).select("k", S.contains_significant(F.col("a"), F.col("b")).alias("hit"))
)
# Jaro in SQL: matched characters are found one after another with a recursive list fold
_JARO = f"""
WITH p AS (SELECT DISTINCT a, b, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS w FROM {_PAIRS}),
m AS (SELECT a, b, w, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(1, length(a) + 1), lambda i: [i])),
  lambda acc, x: list_append(acc, coalesce(list_min(list_filter(range(greatest(1, x[1] - w), least(length(b), x[1] + w) + 1), lambda j: substr(b, j, 1) = substr(a, x[1], 1) AND NOT list_contains(acc, j))), 0))) AS hit FROM p),
q AS (SELECT a, b, len(list_filter(hit, lambda h: h > 0)) AS n, list_filter(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN hit[i] > 0 THEN substr(a, i, 1) ELSE '' END), lambda c: c <> '') AS x,
  list_transform(list_sort(list_filter(hit, lambda h: h > 0)), lambda h: substr(b, h, 1)) AS y FROM m),
j AS (SELECT a, b, CASE WHEN a = b THEN 1.0e0 WHEN n = 0 THEN 0.0e0 ELSE (n * 1.0e0 / length(a) + n * 1.0e0 / length(b) + (n - len(list_filter(range(1, n + 1), lambda i: x[i] <> y[i])) / 2.0e0) / n) / 3 END AS jaro FROM q)
"""
_PREFIX = (
    "CASE WHEN substr(a, 1, 1) <> substr(b, 1, 1) THEN 0 WHEN substr(a, 2, 1) <> substr(b, 2, 1) THEN 1 "
    "WHEN substr(a, 3, 1) <> substr(b, 3, 1) THEN 2 WHEN substr(a, 4, 1) <> substr(b, 4, 1) THEN 3 "
    "ELSE least(4, length(a), length(b)) END"
)
query("g01_jaro", f"{_JARO} SELECT k, round(jaro, 9) AS score FROM {_PAIRS} JOIN j USING (a, b)".lstrip())(lambda spark, d: name_pairs(spark, d).select("k", F.round(S.jaro(F.col("a"), F.col("b")), 9).alias("score")))
query("g02_jaro_winkler", f"{_JARO} SELECT k, round(jaro + 0.1e0 * ({_PREFIX}) * (1 - jaro), 9) AS score FROM {_PAIRS} JOIN j USING (a, b)".lstrip())(lambda spark, d: name_pairs(spark, d).select("k", F.round(S.jaro_winkler(F.col("a"), F.col("b")), 9).alias("score")))
_FUZZY = f"greatest({_CONTAINS}, jaro + 0.1e0 * ({_PREFIX}) * (1 - jaro), 2.0e0 * len(list_intersect(ta, tb)) / (len(ta) + len(tb)))"
query("g06_fuzzy_score", f"{_JARO} SELECT k, round({_FUZZY}, 9) AS score FROM {_PAIRS} JOIN j USING (a, b)".lstrip())(lambda spark, d: name_pairs(spark, d).select("k", F.round(S.fuzzy_score(F.col("a"), F.col("b")), 9).alias("score")))
query("g07_fuzzy_at_least", f"{_JARO} SELECT k, {_FUZZY} >= 0.75 AS hit FROM {_PAIRS} JOIN j USING (a, b)".lstrip())(lambda spark, d: name_pairs(spark, d).select("k", S.fuzzy_at_least(F.col("a"), F.col("b"), 0.75).alias("hit")))
query("g08_token_aware",
    f"WITH {L.aware(_PAIRS, 0.75)} SELECT k, a = b OR EXISTS (FROM aware w WHERE w.a = p.a AND w.b = p.b) AS hit "
    f"FROM {_PAIRS} p".replace("WITH \n", "WITH "))(lambda spark, d: name_pairs(spark, d).select("k", S.token_aware(F.col("a"), F.col("b"), 0.75).alias("hit")))
# The same nine with a pair for every part: the part of the next key, or the first part where there is none.


def next_pairs(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    a = p.select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("a"))
    b = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("b"))
    first = p.agg(F.min_by("p_name", "p_partkey").alias("first"))
    return a.join(b, "k", "left").crossJoin(F.broadcast(first)).select("k", "a", F.coalesce("b", "first").alias("b"))


_NEXT = _PAIRS.replace(
    "part x JOIN part y ON x.p_partkey = y.p_partkey * 3",
    "part x CROSS JOIN (SELECT min(p_partkey) AS low FROM part) LEFT JOIN part z ON z.p_partkey = x.p_partkey + 1 "
        "JOIN part y ON y.p_partkey = coalesce(z.p_partkey, low)",
)
for _name, _column, _made in [
    ("g01_jaro", "score", lambda a, b: F.round(S.jaro(a, b), 9)),
    ("g02_jaro_winkler", "score", lambda a, b: F.round(S.jaro_winkler(a, b), 9)),
    ("g03_word_jaccard", "score", S.word_jaccard),
    ("g04_token_set", "score", S.token_set),
    ("g05_contains_score", "score", S.contains_score),
    ("g06_fuzzy_score", "score", lambda a, b: F.round(S.fuzzy_score(a, b), 9)),
    ("g07_fuzzy_at_least", "hit", lambda a, b: S.fuzzy_at_least(a, b, 0.75)),
    ("g08_token_aware", "hit", lambda a, b: S.token_aware(a, b, 0.75)),
    ("g09_contains_significant", "hit", S.contains_significant),
]:
    query(f"{_name}_whole", ORACLES[_name].replace(_PAIRS, _NEXT) if _name in ORACLES else None)(
        lambda spark, d, column=_column, made=_made: next_pairs(spark, d).select("k", made(F.col("a"), F.col("b")).alias(column))
    )
query("g12_stripped_sibling", "SELECT map_id, CASE WHEN contains(song_name, ' ') THEN true ELSE false END AS sibling FROM songs")(
    lambda spark, d: songs(spark, d).select("map_id", S.is_stripped_sibling(F.array(F.replace("song_name", F.lit(" "), F.lit("")), F.when(F.col("song_name").contains(" "), F.col("song_name"))), F.lit(0)).alias("sibling"))
)


# ---- linkage ----


def _sides(spark, d):
    return link.distinct_keys(keys_of_tracks(spark, d), "tkey"), link.distinct_keys(keys_of_songs(spark, d), "mkey")


def shown(*columns):
    """Lists of texts as one text each."""
    return [T.signature(F.col(c)).alias(c) for c in columns]


@query(
    "g13_remix_compatible",
    f"WITH {L.DISTINCT} "
        f"SELECT DISTINCT {', '.join(f"array_to_string({side}.{part}, '|') AS {side}_{part}" for side in 'tm' for part in ('title', 'tags', 'artist'))}, {L.compatible('t', 'm')} "
        f"AS compatible FROM t JOIN m ON list_has_any(t.title, m.title) WHERE len(t.tags) + len(m.tags) > 0",
)
def g13(spark, d):
    """Keys with a title in common, of which one has tags: which of them the job lets pass."""
    t, m = _sides(spark, d)
    ids = lambda df, side: df.select(f"{side}key", *(F.col(c).alias(f"{side}_{c}") for c in ("who", "what", "title", "tags", "artist")))
    both = link.exact_title_pairs(t, m).join(ids(t, "t"), "tkey").join(ids(m, "m"), "mkey")
    both = link.materialize(both.where(F.size("t_tags") + F.size("m_tags") > 0))
    passed = link.compatible(both.select(*link.MATCHED), t, m).distinct().withColumn("passed", F.lit(True))
    both = both.join(passed, list(link.MATCHED), "left").withColumn("compatible", F.coalesce("passed", F.lit(False)))
    return both.select(*shown("t_title", "t_tags", "t_artist", "m_title", "m_tags", "m_artist"), "compatible").distinct()


@query(
    "g10_artist_pairs",
    f"WITH {L.DISTINCT}, grams AS (SELECT variant, {L._GRAMS.format('variant')} AS u FROM known), votes AS "
        f"(SELECT DISTINCT sig, variant FROM (SELECT sig, {L._GRAMS.format('own')} AS g FROM owns) JOIN grams ON len(g) > 0 "
        f"AND len(list_intersect(g, u)) >= greatest(2, ceil(len(g) * 0.25))), {L.aware('(SELECT own AS a, variant AS b FROM votes JOIN owns USING (sig))', link.THRESHOLD)} "
        f"SELECT DISTINCT sig, variant FROM votes JOIN owns USING (sig) LEFT JOIN aware ON a = own AND b = variant "
        f"WHERE own = variant OR {L.significant('own', 'variant')} OR a IS NOT NULL",
)
def g10(spark, d):
    sigs, variants = link.signatures(keys_of_tracks(spark, d)), link.artist_variants(keys_of_songs(spark, d))
    return link.pair_matches(link.trigram_votes(sigs, variants), sigs, link.THRESHOLD)


@query(
    "g11_titles_match",
    f"WITH {L.paths(link.THRESHOLD)} SELECT DISTINCT array_to_string(x, '|') AS t_title, array_to_string(y, '|') "
        f"AS m_title, EXISTS (FROM agree WHERE agree.x = brought.x AND agree.y = brought.y) AS agree FROM brought",
)
def g11(spark, d):
    """Titles of compatible keys that an accepted artist brings together: which of them the job finds to match."""
    tk, sk = _keys(spark, d)
    t, m = link.materialize(link.distinct_keys(tk, "tkey")), link.materialize(link.distinct_keys(sk, "mkey"))
    accepted = link.materialize(link.accepted_of(t, m, link.THRESHOLD))
    carried = m.select(F.col("who").alias("m_who"), F.explode("artist").alias("variant")).distinct()
    artists = link.materialize(accepted.select(F.col("who").alias("t_who"), "variant").join(carried, "variant").select("t_who", "m_who").distinct())
    brought = link.compatible_titles(artists, t, m)
    found = link.artist_rows(t, m, sk, accepted, link.THRESHOLD).select("t_what", "m_what").distinct().withColumn("found", F.lit(True))
    both = brought.join(found, ["t_what", "m_what"], "left").join(link._named(t, "t", "what", "title"), "t_what").join(link._named(m, "m", "what", "title"), "m_what")
    return both.select(*shown("t_title", "m_title"), F.coalesce("found", F.lit(False)).alias("agree")).distinct()


def plain_sigs(spark, d):
    """Artists of tracks and songs in their one stripped form, as SQL can make them too."""
    form = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    s = tracks(spark, d).select(form(F.col("artist")).alias("sig")).distinct().select("sig", F.array("sig").alias("variants"))
    v = songs(spark, d).select(form(F.col("song_author")).alias("variant")).where("variant <> ''").distinct()
    return s, v


_SIGS = (
    "s AS (SELECT DISTINCT regexp_replace(lower(artist), '[^a-z0-9]+', '', 'g') AS sig FROM tracks), v AS "
    "(SELECT DISTINCT regexp_replace(lower(song_author), '[^a-z0-9]+', '', 'g') AS variant FROM songs "
    "WHERE song_author <> '')"
)
_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"
query("k01_exact_artists", f"WITH {_SIGS} SELECT sig, variant FROM s JOIN v ON sig = variant")(lambda spark, d: link.exact_artists(*plain_sigs(spark, d)))
query("k02_trigram_votes",
    f"WITH {_SIGS}, g AS (SELECT sig, {_GRAMS.format('sig')} AS t FROM s), h AS (SELECT variant, {_GRAMS.format('variant')} "
    f"AS u FROM v) SELECT sig, variant FROM g JOIN h ON len(list_intersect(t, u)) >= greatest(2, ceil(len(t) * 0.25))")(
    lambda spark, d: link.trigram_votes(*plain_sigs(spark, d))
)
query("a14_trigram_frequency",
    f"WITH {_SIGS}, h AS (SELECT unnest({_GRAMS.format('variant')}) AS trigram FROM v WHERE length(variant) >= 3) "
    f"SELECT trigram, count(*) AS df FROM h GROUP BY 1")(lambda spark, d: link.trigram_frequency(plain_sigs(spark, d)[1]))
query("j05_fuzzy_only_artists", f"WITH {_SIGS} SELECT sig FROM s WHERE sig NOT IN (SELECT variant FROM v)")(
    lambda spark, d: plain_sigs(spark, d)[0].join(link.exact_artists(*plain_sigs(spark, d)), "sig", "left_anti").select("sig")
)
query("j07_title_variant_join",
    "SELECT DISTINCT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') "
    "AS tkey, regexp_replace(lower(song_name), '[^a-z0-9]+', '', 'g') AS mkey FROM tracks JOIN songs "
    "ON regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(song_name), '[^a-z0-9]+', '', 'g')")(
    lambda spark, d: link.exact_title_pairs(
        tracks(spark, d).select(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "").alias("tkey")).select("tkey", F.array("tkey").alias("title"), F.array("tkey").alias("artist")),
        songs(spark, d).select(F.regexp_replace(F.lower("song_name"), "[^a-z0-9]+", "").alias("mkey")).select("mkey", F.array("mkey").alias("title")),
    )
)
query("k03_fuzzy_artists", f"WITH {L.accepted(link.THRESHOLD)} SELECT sig, variant FROM fuzzy")(lambda spark, d: link.accepted_artists(link.signatures(keys_of_tracks(spark, d)), link.artist_variants(keys_of_songs(spark, d)), link.THRESHOLD).where("NOT exact").select("sig", "variant"))
query(
    "k04_artist_candidates",
    "SELECT sig, map_id FROM (SELECT DISTINCT regexp_replace(lower(artist), '[^a-z0-9]+', '', 'g') AS sig FROM tracks) JOIN "
        "(SELECT map_id, regexp_replace(lower(song_author), '[^a-z0-9]+', '', 'g') AS variant FROM songs "
        "WHERE song_author <> '') ON sig = variant",
)(
    lambda spark, d: link.artist_candidates(
        link.exact_artists(*plain_sigs(spark, d)).withColumn("exact", F.lit(True)), songs(spark, d).select("map_id", F.array(F.regexp_replace(F.lower("song_author"), "[^a-z0-9]+", "")).alias("artist"))
    ).select("sig", "map_id")
)
query("w02_candidate_cap", "SELECT variant AS sig, least(count(*), 2000) AS n FROM (SELECT 'all' AS variant FROM lineitem) GROUP BY 1")(
    lambda spark, d: link.artist_candidates(
        spark.createDataFrame([("all", "all", False)], "sig string, variant string, exact boolean"),
        spark.read.parquet(f"{d}/lineitem.parquet").select(F.monotonically_increasing_id().alias("map_id"), F.array(F.lit("all")).alias("artist")),
    ).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
)

def _found_sql(relation):
    return f"WITH {L.paths(link.THRESHOLD)} SELECT DISTINCT track_id, map_id FROM {L.fanned(relation)}"


def _keys(spark, d):
    return link.materialize(keys_of_tracks(spark, d)), link.materialize(keys_of_songs(spark, d))


@query("k05_exact_title_path", _found_sql("by_title"))
def k05(spark, d):
    tk, sk = _keys(spark, d)
    t, m = link.distinct_keys(tk, "tkey"), link.distinct_keys(sk, "mkey")
    found = link.exact_title_path(t, m, link.THRESHOLD)
    return link.fanned_out(link.as_keys(found.withColumn("map_id", F.lit(None).cast("bigint"))), tk, sk).select(F.col("id").alias("track_id"), "map_id")


@query("k06_artist_path", _found_sql("by_artist"))
def k06(spark, d):
    tk, sk = _keys(spark, d)
    t, m = link.distinct_keys(tk, "tkey"), link.distinct_keys(sk, "mkey")
    found = link.artist_path(t, m, sk, link.materialize(link.accepted_of(t, m, link.THRESHOLD)), link.THRESHOLD)
    return link.fanned_out(link.materialize(link.as_keys(found)), tk, sk).select(F.col("id").alias("track_id"), "map_id")


# an artist found by trigrams brings a bounded number of songs, those with the least map_id
query(
    "w02_capped_candidates",
    f"WITH {L.accepted(link.THRESHOLD)}, met AS (SELECT DISTINCT sig, map_id FROM (SELECT map_id, unnest(artist) AS variant "
        f"FROM sk) JOIN fuzzy USING (variant)) SELECT sig, map_id FROM (SELECT *, row_number() OVER (PARTITION BY sig "
        f"ORDER BY map_id) AS n FROM met) WHERE n <= 20",
)(
    lambda spark, d: link.artist_candidates(
        link.accepted_artists(link.signatures(keys_of_tracks(spark, d)), link.artist_variants(keys_of_songs(spark, d)), link.THRESHOLD).where("NOT exact"), keys_of_songs(spark, d), 20
    ).select("sig", "map_id")
)
query("k07_match_tracks", _found_sql("found"))(lambda spark, d: link.match_tracks(tracks(spark, d), songs(spark, d)))
_SCORED = (
    f"WITH {L.scores(link.THRESHOLD)}, pairs_of AS (SELECT DISTINCT track_id, map_id, score FROM {L.fanned('found')} f "
    f"JOIN scores USING (t, m))"
)
query("k08_score_matches", _SCORED + " SELECT track_id, map_id, round(score, 9) AS score FROM pairs_of")(
    lambda spark, d: link.score_matches(tracks(spark, d), songs(spark, d), digits=9)
)
query("k10_match_one", _found_sql("found") + " WHERE track_id = (SELECT min(id) FROM tracks)")(
    lambda spark, d: link.match_one(tracks(spark, d).orderBy("id"), songs(spark, d))
)
@query("k10_on_kept_index", _found_sql("found") + " WHERE track_id = (SELECT min(id) FROM tracks)")
def k10_on_kept_index(spark, d):
    """One track against keys that are kept with the songs."""
    at = _out(spark, "catalog")
    kept = link.match_index(songs(spark, d))
    sinks.write_catalog(songs(spark, d), difficulties(spark, d), snapshots.snapshot_meta(nested(spark, d)), at, more=kept, keys=link.INDEX_KEYS)
    return link.match_indexed(tracks(spark, d).orderBy("id").limit(1), sinks.read_catalog(spark, at))


query("k11_exact_artist_signatures", f"WITH {L.DISTINCT} SELECT DISTINCT sig FROM exact")(lambda spark, d: link.exact_artist_signatures(tracks(spark, d), songs(spark, d)))
_TERMS = ["red widget", "small ring", "no such title"]
query("j10_search_titles", L.searched(_TERMS, 0.8, 5))(
    lambda spark, d: link.search_titles(tracks(spark, d), songs(spark, d), _TERMS).withColumn("score", F.round("score", 9))
)
query("g15_explain_pairs", L.explained(
    "SELECT track_id, map_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, map_id) AS rank "
    "FROM scored) WHERE rank = 1", 0.5))(
    lambda spark, d: link.explain_pairs(tracks(spark, d), songs(spark, d), res.top_matches(scored(spark, d), 1).select("track_id", "map_id")).withColumn("score", F.round("score", 9))
)
query("a12_empty_keys", f"WITH {L.SIDES} SELECT count(*) AS rows, count(*) FILTER (len(title) = 0) AS empty FROM sk")(lambda spark, d: res.empty_keys(keys_of_songs(spark, d)))
query("a12_empty_track_keys", f"WITH {L.SIDES} SELECT count(*) AS rows, count(*) FILTER (len(title) = 0) AS empty FROM tk")(lambda spark, d: res.empty_keys(keys_of_tracks(spark, d)))
@query(
    "a13_size_profile",
    f"WITH {L.paths(link.THRESHOLD)}, pairs_of AS (SELECT DISTINCT track_id, map_id FROM {L.fanned('found')}) SELECT (SELECT "
        f"count(DISTINCT v) FROM (SELECT unnest(artist) AS v FROM sk)) AS artist_variants, (SELECT count(DISTINCT v) FROM "
        f"(SELECT unnest(title) AS v FROM sk)) AS title_variants, (SELECT count(DISTINCT track_id) FROM pairs_of) "
        f"AS matched_tracks, (SELECT count(*) FROM pairs_of) AS pairs",
)
def a13(spark, d):
    tk, sk = _keys(spark, d)
    t, m = link.materialize(link.distinct_keys(tk, "tkey")), link.materialize(link.distinct_keys(sk, "mkey"))
    return res.size_profile(sk, link.match_totals(link.materialize(link.match_keys(t, m, sk, link.THRESHOLD)), tk, sk))




def listed(groups, matches):
    """Groups with their songs' ids as one text, for display."""
    ids = matches.groupBy(*res.GROUP).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "map_id"))), lambda x: x["map_id"].cast("string")), ",").alias("map_ids"))
    return groups.join(ids, list(res.GROUP))


@query(
    "k09_group_results",
    _SCORED
    + ", g AS (SELECT lower(artist) AS a, lower(title) AS t, min((artist, title, id)) AS first, count(*) AS n FROM tracks "
        "WHERE id IN (SELECT track_id FROM pairs_of) GROUP BY 1, 2), "
    "best AS (SELECT lower(artist) AS a, lower(title) AS t, map_id, max(score) AS score FROM pairs_of JOIN tracks "
        "ON id = track_id GROUP BY 1, 2, 3), "
    "listed AS (SELECT a, t, string_agg(map_id, ',' ORDER BY score DESC, map_id) AS map_ids FROM best GROUP BY 1, 2) "
        "SELECT first[1] AS artist, first[2] AS title, n AS n_instances, map_ids FROM g JOIN listed USING (a, t)",
)
def k09(spark, d):
    """A group's scores come from one track of each of its keys, so that copies of tracks are only counted."""
    t = tracks(spark, d)
    tk, sk = _keys(spark, d)
    found = link.scored_keys(tk, sk)
    best = link.materialize(link.fanned_out(found, link.one_of_each(tk, res.with_group(t), *res.GROUP), sk).select(F.col("id").alias("track_id"), "map_id", "score"))
    return listed(res.group_results(best, t, link.matched_ids(found, tk)), res.group_matches(best, t)).select("artist", "title", "n_instances", "map_ids")


# ---- results, on scored pairs by a plain rule ----

query("a05_best_score_of_group",
    "SELECT lower(artist) AS group_artist, lower(title) AS group_title, map_id, max(score) AS score FROM scored JOIN tracks "
    "ON id = track_id GROUP BY 1, 2, 3")(lambda spark, d: res.group_scores(scored(spark, d), tracks(spark, d)))
query("a06_track_groups",
    "SELECT lower(artist) AS group_artist, lower(title) AS group_title, arg_min(id, (artist, title, id)) AS primary_id, "
    "count(*) AS n_instances FROM tracks WHERE id IN (SELECT track_id FROM scored) GROUP BY 1, 2")(
    lambda spark, d: res.track_groups(scored(spark, d), tracks(spark, d)).select("group_artist", "group_title", "primary_id", "n_instances")
)
query("k09_grouped_scored",
    "SELECT group_artist, group_title, array_to_string(list(map_id ORDER BY score DESC, map_id), ',') AS map_ids FROM "
    "(SELECT lower(artist) AS group_artist, lower(title) AS group_title, map_id, max(score) AS score FROM scored JOIN tracks "
    "ON id = track_id GROUP BY 1, 2, 3) GROUP BY 1, 2")(
    lambda spark, d: listed(res.group_results(scored(spark, d), tracks(spark, d)), res.group_matches(scored(spark, d), tracks(spark, d))).select("group_artist", "group_title", "map_ids")
)
_BEST = (
    "(SELECT lower(artist) AS group_artist, lower(title) AS group_title, map_id, max(score) AS score FROM scored JOIN tracks "
    "ON id = track_id GROUP BY 1, 2, 3)"
)
_GROUPED = (
    "(SELECT lower(artist) AS group_artist, lower(title) AS group_title, min((artist, title, id)) AS first, count(*) "
    "AS n_instances FROM tracks WHERE id IN (SELECT track_id FROM scored) GROUP BY 1, 2)"
)
query(
    "k09_group_rows",
    f"SELECT group_artist, group_title, first[3] AS primary_id, first[1] AS artist, first[2] AS title, n_instances, n_matches, best FROM {_GROUPED} "
    f"JOIN (SELECT group_artist, group_title, count(*) AS n_matches, max(score) AS best FROM {_BEST} GROUP BY 1, 2) USING "
        f"(group_artist, group_title)",
)(lambda spark, d: res.group_results(scored(spark, d), tracks(spark, d)))
query(
    "k09_group_matches",
    f"SELECT group_artist, group_title, row_number() OVER (PARTITION BY group_artist, group_title "
        f"ORDER BY score DESC, map_id) AS position, map_id, score FROM {_BEST}",
)(lambda spark, d: res.group_matches(scored(spark, d), tracks(spark, d)))
query(
    "a06_group_instances",
    "SELECT group_artist, group_title, row_number() OVER (PARTITION BY group_artist, group_title ORDER BY artist, title, id) AS position, id "
    "FROM (SELECT *, lower(artist) AS group_artist, lower(title) AS group_title FROM tracks WHERE id IN (SELECT track_id FROM scored))",
)(lambda spark, d: res.group_instances(scored(spark, d), tracks(spark, d)))
query("a08_coverage",
    "SELECT count(DISTINCT (lower(artist), lower(title))) AS groups, count(DISTINCT (lower(artist), lower(title))) FILTER "
    "(id IN (SELECT track_id FROM scored)) AS matched_groups, floor(count(DISTINCT (lower(artist), lower(title))) FILTER "
    "(id IN (SELECT track_id FROM scored)) / count(DISTINCT (lower(artist), lower(title)))::DOUBLE * 100 * 10 + 0.5) / 10 "
    "AS coverage FROM tracks")(
    lambda spark, d: res.coverage(scored(spark, d), tracks(spark, d))
)
_COUNTS = "(SELECT track_id, count(*) AS matches, max(score) AS best FROM scored GROUP BY 1)"
query("a09_match_count_histogram", f"SELECT matches, count(*) AS tracks FROM {_COUNTS} GROUP BY 1")(lambda spark, d: res.match_count_histogram(scored(spark, d)))
query("a10_score_buckets",
    f"SELECT CASE WHEN best >= 1 THEN '1.0' WHEN best >= 0.9 THEN '0.9-0.99' WHEN best >= 0.8 THEN '0.8-0.89' "
    f"WHEN best >= 0.7 THEN '0.7-0.79' ELSE '<0.7' END AS bucket, count(*) AS n, count(*) / (SELECT count(DISTINCT track_id) "
    f"FROM scored)::DOUBLE AS share FROM {_COUNTS} GROUP BY 1")(
    lambda spark, d: res.score_buckets(scored(spark, d)).withColumnRenamed("tracks", "n")
)
query("a11_match_summary",
    f"SELECT count(*) AS matched, avg(matches) AS average_matches, (SELECT count(*) FROM tracks) AS n, count(*) / (SELECT "
    f"count(*) FROM tracks)::DOUBLE AS share FROM {_COUNTS}")(
    lambda spark, d: res.match_summary(scored(spark, d), tracks(spark, d)).withColumnRenamed("tracks", "n")
)
query("j09_hydrate",
    "SELECT track_id, scored.map_id, score, title, artist, song_name, bpm FROM scored JOIN tracks ON id = track_id "
    "JOIN songs ON songs.map_id = scored.map_id")(
    lambda spark, d: res.hydrate(scored(spark, d), tracks(spark, d), songs(spark, d)).select("track_id", "map_id", "score", "title", "artist", "song_name", "bpm")
)
query("w03_top_matches",
    "SELECT track_id, map_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id "
    "ORDER BY score DESC, map_id) AS rank FROM scored) WHERE rank <= 2")(lambda spark, d: res.top_matches(scored(spark, d), 2))
query("l04_sort_matches",
    "SELECT track_id, scored.map_id, row_number() OVER (PARTITION BY track_id "
    "ORDER BY rating DESC, score DESC, scored.map_id) AS position FROM scored JOIN songs ON songs.map_id = scored.map_id")(
    lambda spark, d: res.sort_matches(res.hydrate(scored(spark, d), tracks(spark, d), songs(spark, d)), "rating").select("track_id", "map_id", "position")
)
for _key, _col in [("bpm", "bpm"), ("duration", "duration"), ("upload_time", "upload_time"), ("score", "score"), ("ranked", "ranked_states")]:
    for _way, _up in (("asc", True), ("desc", False)):
        query(f"l04_sort_{_key}_{_way}",
            f"SELECT track_id, scored.map_id, row_number() OVER (PARTITION BY track_id ORDER BY {_col} {_way}, scored.map_id) "
            f"AS position FROM scored JOIN songs ON songs.map_id = scored.map_id")(
            lambda spark, d, k=_key, up=_up: res.sort_matches(res.hydrate(scored(spark, d), tracks(spark, d), songs(spark, d)), k, up).select("track_id", "map_id", "position")
        )
# Text keys in locale order, which DuckDB takes from a library of its own.
for _key in res.MATCH_SORTS[:3]:
    for _way, _up in (("asc", True), ("desc", False)):
        query(
            f"l04_sort_{_key}_{_way}",
            f"SELECT track_id, scored.map_id, row_number() OVER (PARTITION BY track_id ORDER BY {_key} COLLATE en {_way}, scored.map_id) AS position "
            "FROM scored JOIN songs ON songs.map_id = scored.map_id",
        )(lambda spark, d, k=_key, up=_up: res.sort_matches(res.hydrate(scored(spark, d), tracks(spark, d), songs(spark, d)), k, up).select("track_id", "map_id", "position"))
query(
    "l05_page_in_locale_order",
    f"SELECT group_artist, group_title, row_number() OVER "
        f"(ORDER BY first[1] COLLATE en, first[2] COLLATE en, first[3]) - 1001 AS position FROM {_GROUPED} ORDER BY position "
        f"LIMIT 500 OFFSET 1000",
)(lambda spark, d: in_order(res.result_page(res.track_groups(scored(spark, d), tracks(spark, d)), 3, 500)).select("group_artist", "group_title", "position"))
query("p14_coverage_text",
    "SELECT printf('%.1f', floor(count(DISTINCT (lower(artist), lower(title))) FILTER (id IN (SELECT track_id "
    "FROM scored)) / count(DISTINCT (lower(artist), lower(title)))::DOUBLE * 1000 + 0.5) / 10) AS percent FROM tracks")(
    lambda spark, d: res.coverage(scored(spark, d), tracks(spark, d)).select(C.percent_text(F.col("matched_groups") / F.col("groups"), 1).alias("percent"))
)
query("l05_result_page",
    "SELECT group_artist, group_title FROM (SELECT lower(artist) AS group_artist, lower(title) AS group_title, arg_min(id, "
    "(artist, title, id)) AS pid, min(artist) AS a FROM tracks WHERE id IN (SELECT track_id FROM scored) "
    "AND NOT regexp_matches(artist || title, '[^a-z ]') GROUP BY 1, 2) ORDER BY group_artist, group_title, pid "
    "LIMIT 20 OFFSET 20")(
    lambda spark, d: res.result_page(res.track_groups(scored(spark, d), tracks(spark, d).where(~F.concat("artist", "title").rlike("[^a-z ]"))), 2, 20).select("group_artist", "group_title")
)
# All matched groups; hexadecimal digits sort alike in the page's collation and in bytes, so both engines share the order.
query("l05_result_page_whole",
    "SELECT group_artist, group_title FROM (SELECT DISTINCT lower(artist) AS group_artist, lower(title) AS group_title "
    "FROM tracks WHERE id IN (SELECT track_id FROM scored)) ORDER BY group_artist, group_title LIMIT 20 OFFSET 20")(
    lambda spark, d: res.result_page(res.track_groups(scored(spark, d), tracks(spark, d)).withColumns({"artist": F.hex("group_artist"), "title": F.hex("group_title")}), 2, 20).select("group_artist", "group_title")
)
query("l06_busiest_tracks", f"SELECT track_id, matches, best FROM {_COUNTS} ORDER BY matches DESC, track_id LIMIT 15")(lambda spark, d: res.busiest_tracks(scored(spark, d)))
query("l07_best_tracks", f"SELECT track_id, matches, best FROM {_COUNTS} ORDER BY best DESC, track_id LIMIT 30")(lambda spark, d: res.best_tracks(scored(spark, d)))
query("l08_borderline", "SELECT track_id, map_id, score FROM scored WHERE score >= 0.80 AND score < 0.86 ORDER BY track_id, map_id LIMIT 20")(lambda spark, d: res.borderline(scored(spark, d)))
