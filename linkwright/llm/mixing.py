"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks of ``block_docs`` in doc_id order. With a weight of p parts in a cycle
of q slots, its block i may start at slot floor(i*q/p) and is due before slot ceil((i+1)*q/p). In each
slot the released block with the earliest deadline runs, so that after t slots a source has received less
than one block more or less than t*p/q, for as long as it has blocks. All sources are even at the end of a
cycle, so one cycle's schedule, of q rows, serves every cycle.

Defined results: every row gets a place, whatever its source; sources without a weight, and null ones,
share ``other_parts``; null doc_ids come first in their source; rows that repeat a doc_id each get a place
of their own; a source that has run out leaves its slots unused; texts
are carried and never read; an empty table gives no rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Width of the doc_id ranges in which rows are numbered, and ranges of a span; they are put together by running sums.
RANGE_IDS = 4096
#: Bound on a cycle, and so on the broadcast schedule.
MAX_PARTS = 10_000
#: What ``mix`` adds; columns of these names are replaced.
MIX_COLUMNS = ("mix_stratum", "mix_block", "mix_slot", "mix_offset", "mix_release", "mix_deadline")
#: What ``placed`` adds.
PLACE = ("mix_slot", "mix_offset")


def cycle(spark: SparkSession, parts: Mapping[str, int], other_parts: int) -> DataFrame:
    """One cycle's schedule: (stratum, parts, turn, slot, release, deadline); stratum null is for all other sources."""
    rows = [(k, s, int(p)) for k, (s, p) in enumerate([*parts.items(), (None, other_parts)])]
    q = sum(p for _, _, p in rows)
    if not 0 < q <= MAX_PARTS or any(p < 1 for _, _, p in rows):
        raise ValueError(f"parts must be positive and come to {MAX_PARTS} at most")
    weights = spark.createDataFrame(rows, "rank int, stratum string, parts int")
    jobs = weights.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("turn")).select(
        F.struct(
            F.ceil((F.col("turn") + 1) * q / F.col("parts")).cast("int").alias("deadline"),
            "rank",
            F.floor(F.col("turn") * q / F.col("parts")).cast("int").alias("release"),
            "turn",
            "parts",
            "stratum",
        ).alias("job")
    )
    every = jobs.agg(F.sort_array(F.collect_list("job")).alias("jobs"))
    # Sorted, so the first released job has the earliest deadline. The one-element array binds it once a step.
    due = lambda s, t: F.filter(s["left"], lambda j: j["release"] <= t)[0]
    move = lambda s, d: F.struct(F.concat(s["order"], F.array(d)).alias("order"), F.filter(s["left"], lambda j: j != d).alias("left"))
    step = lambda s, t: F.transform(F.array(due(s, t)), lambda d: move(s, d))[0]
    none = F.filter("jobs", lambda j: F.lit(False))
    order = every.select(F.aggregate(F.sequence(F.lit(0), F.lit(q - 1)), F.struct(none.alias("order"), F.col("jobs").alias("left")), step)["order"].alias("order"))
    return order.select(F.posexplode("order").alias("slot", "job")).select("slot", "job.*").drop("rank")


def mix(docs: DataFrame, parts: Mapping[str, int], other_parts: int = 1, block_docs: int = 16, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with its place in the mix: mix_stratum, mix_block, mix_slot, mix_offset, mix_release, mix_deadline.

    The mix is the order of (mix_slot, mix_offset).
    """
    plan = cycle(docs.sparkSession, parts, other_parts)
    q = sum(parts.values()) + other_parts
    stratum = F.when(F.col(source_col).isin(list(parts)), F.col(source_col)).alias("_stratum")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), stratum, F.floor(F.col(id_col) / RANGE_IDS).alias("_range"))
    counts = docs.select(stratum.alias("_s"), F.floor(F.col(id_col) / RANGE_IDS).alias("_r")).groupBy("_s", "_r").agg(F.count(F.lit(1)).alias("_n"))
    # running sums in two steps: over the ranges of a span, and over the spans of a source
    counts = counts.withColumn("_span", F.floor(F.col("_r") / RANGE_IDS))
    spans = counts.groupBy(F.col("_s").alias("_t"), F.col("_span").alias("_u")).agg(F.sum("_n").alias("_m"))
    sums = lambda n, order, *by: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("_first", sums("_m", "_u", "_t"))
    before = counts.withColumn("_inside", sums("_n", "_r", "_s", "_span")).join(spans, F.col("_s").eqNullSafe(F.col("_t")) & F.col("_span").eqNullSafe(F.col("_u")))
    before = before.select("_s", "_r", (F.col("_first") + F.col("_inside")).alias("_before"))
    same = F.col("_stratum").eqNullSafe(F.col("_s")) & F.col("_range").eqNullSafe(F.col("_r"))
    ordinal = F.col("_before") + F.row_number().over(Window.partitionBy("_stratum", "_range").orderBy("_id")) - 1
    rows = rows.join(before, same).withColumn("_ordinal", ordinal)
    width = F.coalesce(F.create_map(*[F.lit(x) for s, p in parts.items() for x in (s, int(p))])[F.coalesce("_stratum", F.lit(""))], F.lit(other_parts))
    rows = rows.withColumn("mix_block", F.floor(F.col("_ordinal") / block_docs)).withColumn("mix_offset", (F.col("_ordinal") % block_docs).cast("int"))
    rows = rows.withColumn("_cycle", F.floor(F.col("mix_block") / width)).withColumn("_turn", (F.col("mix_block") % width).cast("int"))
    rows = rows.join(F.broadcast(plan), F.col("_stratum").eqNullSafe(F.col("stratum")) & (F.col("_turn") == F.col("turn")))
    at = lambda c: F.col("_cycle") * q + F.col(c)
    new = [F.col("_stratum").alias("mix_stratum"), F.col("mix_block"), at("slot").alias("mix_slot"), F.col("mix_offset"), at("release").alias("mix_release"), at("deadline").alias("mix_deadline")]
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in MIX_COLUMNS], *new)


def placed(docs: DataFrame, parts: Mapping[str, int], other_parts: int = 1, block_docs: int = 16) -> DataFrame:
    """The rows of ``docs``, all of them, with mix_slot and mix_offset: the mix is their order. Whole rows are dealt out once and not sorted."""
    row = docs.select(F.struct(*(c for c in docs.columns if c not in PLACE)).alias("row"), "doc_id", "source")
    return mix(row, parts, other_parts, block_docs).select("row.*", *PLACE)
