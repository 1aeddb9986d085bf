"""Text search with a kept index of trigrams.

A row can only match a pattern if each run of letters between the pattern's wildcards stands in one of its columns,
and then all trigrams of the run do. Rows that have all trigrams of all runs are candidates; the pattern
itself decides on them. Patterns whose runs are all shorter than three letters are looked for in every row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.textkeys import unique_trigrams
from linkwright.operators.catalog import LOWER, UPPER, ascii_lower, matches_any


def search_postings(rows: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """(trigram, id): the trigrams of a row's columns in small letters, each once."""
    texts = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*(ascii_lower(F.col(c)) for c in columns))).alias("text")).where("text IS NOT NULL")
    return texts.select("id", F.explode(unique_trigrams(F.col("text"))).alias("trigram")).distinct().select("trigram", "id")


def wanted_trigrams(search: str) -> list[str]:
    """The trigrams that a match must have; those of a text that stands between wildcards."""
    folded = search.strip().translate(str.maketrans(UPPER, LOWER))
    return sorted({run[k : k + 3] for run in re.split("[%_]", folded) for k in range(len(run) - 2)})


def candidates(postings: DataFrame, search: str) -> DataFrame | None:
    """(id) of rows that have all trigrams of the pattern; None if it has none, so that all rows are candidates."""
    wanted = wanted_trigrams(search)
    if not wanted:
        return None
    met = postings.where(F.col("trigram").isin(wanted)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return met.where(F.col("n") == len(wanted)).select("id")


def indexed_search(rows: DataFrame, postings: DataFrame, search: str, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """The rows that match, as ``matches_any`` finds them; a blank search finds all."""
    if not search.strip():
        return rows
    ids = candidates(postings, search)
    exact: Column = matches_any(columns, search)
    if ids is None:
        return rows.where(exact)
    return rows.join(ids.withColumnRenamed("id", "_candidate"), F.col(id_col) == F.col("_candidate"), "left_semi").where(exact)
