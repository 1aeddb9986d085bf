"""Catalog and library views over the driver's tables.

Each view is one SELECT in SQL that Spark and DuckDB read alike but for the names in DIALECTS; tables are
named in braces. Spark's views and the SQL of the oracles come from the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {"hexed": "lower(hex({0}))", "arr": "array({0})"},
    "duckdb": {"hexed": "printf('%x', {0})", "arr": "[{0}]"},
}
TAGS = "accuracy dance ambient folk electronic metal joke speedcore trance disney fnf rbp stream tech jump fitness balanced".split()
SCRAPED = 1700000000

_NAME = "p_name || CASE p_partkey % 8 WHEN 1 THEN ' (Remaster)' WHEN 2 THEN ' (radio edit)' WHEN 3 THEN ' (Alpha Remix)' WHEN 4 THEN ' - Beta Remix' WHEN 5 THEN ' Deluxe Edition' WHEN 6 THEN ' [Gamma flip]' WHEN 7 THEN ' Theme' ELSE '' END"
_AUTHOR = "p_type || ' ' || p_brand"
_RATING = "CASE WHEN p_partkey % 97 + p_partkey % 13 = 0 THEN 0.0 ELSE floor(((p_partkey % 97) * 1.0e0 / (p_partkey % 97 + p_partkey % 13) - ((p_partkey % 97) * 1.0e0 / (p_partkey % 97 + p_partkey % 13) - 0.5e0) * power(2.0e0, -(ln((p_partkey % 97 + p_partkey % 13) / 2.0e0 + 1) / ln(3.0e0)))) * 1000 + 0.5e0) / 1000.0e0 END"

SONGS = f"""
SELECT p_partkey AS map_id, <hexed:p_partkey> AS key, md5(CAST(p_partkey AS STRING)) || substr(md5(CAST(p_partkey AS STRING)), 1, 8) AS hash,
  CAST(CAST(p_retailprice / 5 AS FLOAT) AS DOUBLE) AS bpm, CAST(p_partkey % 97 AS INT) AS upvotes, CAST(p_partkey % 13 AS INT) AS downvotes, {_RATING} AS rating,
  {SCRAPED} + p_partkey * 3600 AS upload_time, p_size * 10 AS duration,
  CASE WHEN p_partkey % 5 = 3 THEN {_AUTHOR} || ' - ' || p_name ELSE {_NAME} END AS song_name,
  CASE p_partkey % 5 WHEN 0 THEN {_AUTHOR} WHEN 1 THEN {_AUTHOR} || ' feat. Guest' WHEN 2 THEN {_AUTHOR} || ' (mapped by Zed)' WHEN 3 THEN '' ELSE {_AUTHOR} || ' | beatmap by Kay' END AS song_author,
  p_brand AS level_author, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE 'user ' || CAST(p_partkey % 50 AS STRING) END AS uploader_name,
  p_partkey % 16 AS ranked_states, {SCRAPED} + p_partkey * 3600 + 86400 AS ranked_change_time, p_partkey % 131072 AS tags, p_partkey % 4 AS upload_flags,
  CAST({SCRAPED} AS BIGINT) AS scrape_ended_time
FROM {{part}}"""

DIFFICULTIES = """
SELECT l_partkey AS song_map_id, CAST(l_suppkey % 8 AS INT) AS characteristic, CAST((l_linenumber - 1) % 5 AS INT) AS difficulty, round(l_discount * 10000) / 100.0e0 AS stars_ss,
  round(l_tax * 10000) / 100.0e0 AS stars_bl, l_quantity / 2 AS njs, CAST(l_suppkey % 11 AS INT) AS bombs, CAST(l_quantity * 20 AS INT) AS notes,
  CAST(l_linenumber AS INT) AS obstacles, l_orderkey % 16 AS mods
FROM {lineitem}"""

_TRACK = "(SELECT o_orderkey AS k, o_orderpriority AS priority, p_name AS name, p_type || ' ' || p_brand AS author FROM {orders} JOIN {part} ON p_partkey = (o_orderkey * 7919) % (SELECT count(*) FROM {part}))"
TRACKS = f"""
SELECT CAST(k AS STRING) AS id,
  CASE k % 10 WHEN 1 THEN substr(name, 1, length(name) - 1) WHEN 2 THEN upper(name) WHEN 3 THEN replace(replace(name, 'e', 'é'), 'o', 'ö') WHEN 4 THEN name || ' (Alpha Remix)' WHEN 5 THEN name || ' (Live)' ELSE name END AS title,
  CASE k % 10 WHEN 0 THEN substr(author, 1, 2) || substr(author, 4, 1) || substr(author, 3, 1) || substr(author, 5) WHEN 2 THEN upper(author) WHEN 6 THEN author || ' feat. Guest' ELSE author END AS artist,
  CASE WHEN k % 11 = 0 THEN NULL ELSE priority END AS album, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 600 AS INT) END AS duration,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(1960 + k % 60 AS INT) END AS year, CAST({SCRAPED}000 + k % 1000 AS BIGINT) AS fetched_at
FROM {_TRACK} t"""

#: Scored pairs by a plain rule, for what is made of scored matches.
SCORED = """
SELECT CAST(o_orderkey AS STRING) AS track_id, (o_orderkey * 31 + j * 17) % (SELECT count(*) FROM {part}) AS map_id, ((o_orderkey * 37 + j * 11) % 41) / 100.0e0 + 0.6e0 AS score
FROM (SELECT o_orderkey, j FROM {orders} CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) c WHERE o_orderkey % 3 <> 0 AND j <= o_orderkey % 4) s"""

VIEWS = {"songs": SONGS, "difficulties": DIFFICULTIES, "tracks": TRACKS, "scored": SCORED}


def in_dialect(sql: str, dialect: str) -> str:
    for name, form in DIALECTS[dialect].items():
        while (at := sql.find(f"<{name}:")) >= 0:
            end = sql.index(">", at)
            sql = sql[:at] + form.format(sql[at + len(name) + 2 : end]) + sql[end + 1 :]
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = in_dialect(VIEWS[name], "spark")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders", "lineitem") if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ", ".join(f"{n} AS ({in_dialect(VIEWS[n], 'duckdb').format(part='part', orders='orders', lineitem='lineitem')})" for n in used)
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else ""
    body = sql.lstrip()
    if body.upper().startswith("WITH "):
        body = body[5 + len(recursive) :]
        return f"WITH {recursive}{ctes}, {body}"
    return f"WITH {ctes} {body}"
