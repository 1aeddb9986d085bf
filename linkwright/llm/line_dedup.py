"""Line dedup with overlapping three-line windows.

Every three consecutive lines of a document are hashed (two 64-bit hashes of all three). A window that
occurs several times in the whole corpus stays where it is first, in the order of (doc_id, line); all later
occurrences are removed. Windows overlap, so the positions that they cover are merged before lines go.

Defined results: null text counts as empty; documents of fewer than three lines, and windows of three empty
lines, are left alone; a null doc_id comes first; rows that agree in doc_id and text are one document and
each get its result; texts may have any number of lines, which are rows of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import materialize

SPAN = 3


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, line): where later occurrences of windows start; lines count from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"))
    rows = rows.where(F.size("lines") >= SPAN)
    three = F.transform(F.sequence(F.lit(1), F.size("lines") - SPAN + 1), lambda i: F.slice("lines", i, SPAN))
    hashed = F.transform(three, lambda w: F.when(F.array_join(w, "") != "", F.struct(F.xxhash64(w).alias("h1"), F.xxhash64(F.lit("second"), F.array_join(w, "\n")).alias("h2"))))
    windows = rows.select("doc_id", "text_hash", F.posexplode(hashed).alias("line", "h")).where("h IS NOT NULL").select("doc_id", "text_hash", "line", "h.h1", "h.h2")
    windows = materialize(windows)
    at = F.struct(F.coalesce(F.col("doc_id").isNotNull(), F.lit(False)).alias("k"), "doc_id", "line")
    first = windows.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select("_h1", "_h2", "first"))
    met = windows.join(first, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    return met.where(at > F.col("first")).select("doc_id", "text_hash", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, text): the lines that stay, in order."""
    later = repeated_windows(docs, id_col, text_col)
    starts = later.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("line").alias("starts"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("_key", F.xxhash64("text"))
    both = rows.join(starts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")), "left")
    lines = F.split("text", "\n", -1)
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + SPAN - 1)))
    both = both.withColumn("_lines", lines).withColumn("_stay", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered))
    kept = F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n"))
    removed = F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_stay"))
    return both.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), kept.alias("text"))
