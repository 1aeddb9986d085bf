"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and numbered, so
that two blocks have one integer name exactly if their bytes agree. Adjacent names are then paired
and the distinct pairs are named the same way, again and again, until each document has one name.
A hash only says which bucket a value is sorted in; within the bucket whole values are compared,
so names never collide. Values are reduced to distinct ones in each task before they are dealt to buckets, so one
that very many rows share costs a row for each task; rows look their names up by bucket and a second hash, and
should two values of a bucket agree in that one too, the job stops instead of giving both one name.

Defined results: null text counts as empty; a null doc_id ranks below every other; rows that agree
in doc_id and text are the same document and all carry the same result; a very long text is many blocks, each a row
of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import body, materialize, without

#: Bytes of a block.
BLOCK_BYTES = 8192
#: Values are sorted in 2^BUCKET_BITS buckets; a name is the bucket's number and the rank in it.
BUCKET_BITS = 40
RANK_BITS = 62 - BUCKET_BITS


def _bucket(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - BUCKET_BITS)


def _join_name(rank: Column) -> Column:
    full = F.raise_error(F.lit("more distinct values in one bucket than ranks"))
    return F.when(rank < (1 << RANK_BITS), F.shiftleft(F.col("_bucket"), RANK_BITS) + rank).otherwise(full.cast("long"))


def _second(value: Column) -> Column:
    return F.xxhash64(F.lit("second"), value)


def name_values(df: DataFrame, value: str) -> DataFrame:
    """Replace column ``value`` by ``name``: equal integers for equal values, and only for those."""
    dealt = df.withColumn("_bucket", _bucket(F.col(value)))
    sorted_ = dealt.groupBy("_bucket").agg(F.array_sort(F.collect_set(value)).alias("_values"))
    apart = F.size(F.array_distinct(F.transform("_values", _second))) == F.size("_values")
    clash = F.raise_error(F.lit("two values of one bucket have equal hashes"))
    ranked = sorted_.select("_bucket", F.posexplode(F.when(apart, F.col("_values")).otherwise(clash.cast(sorted_.schema["_values"].dataType))).alias("_rank", "_value"))
    names = ranked.select("_bucket", _second(F.col("_value")).alias("_second"), _join_name(F.col("_rank").cast("long")).alias("name"))
    rows = dealt.withColumn("_second", _second(F.col(value))).drop(value)
    return rows.join(materialize(names, narrow=True), ["_bucket", "_second"]).drop("_bucket", "_second")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_hash, n_blocks, name): documents are equal exactly if (n_blocks, name) are."""
    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("_body"))
    rows = rows.withColumn("text_hash", F.xxhash64("_body"))
    n = F.greatest(F.ceil(F.length("_body") / block_bytes), F.lit(1)).cast("int")
    blocks = rows.select(
        "doc_id",
        "text_hash",
        n.alias("n_blocks"),
        F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("_body"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"),
    )
    level = materialize(name_values(blocks, "block"))
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    key = ["doc_id", "text_hash", "n_blocks"]
    done = level.where("n_blocks = 1").select(*key, "name").distinct()
    level = level.where("n_blocks > 1")
    width = 1
    while width < longest:
        half = F.shiftright("pos", 1)
        of = lambda side: F.max(F.when(F.col("pos") % 2 == side, F.col("name")))
        pairs = level.groupBy(*key, half.alias("pos")).agg(F.struct(of(0).alias("l"), of(1).alias("r")).alias("pair"))
        level = materialize(name_values(pairs, "pair"))
        width *= 2
        done = done.unionByName(level.where((F.col("n_blocks") > width // 2) & (F.col("n_blocks") <= width)).select(*key, "name"))
        level = level.where(F.col("n_blocks") > width)
    return done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, text_hash, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays.
    """
    names = identities(docs, id_col, text_col, block_bytes).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body(text_col)).alias("text_hash"), F.sha2(body(text_col), 256).alias("text_sha256"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    named = materialize(rows.join(names, same).drop("_id", "_hash"))
    groups = materialize(named.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), narrow=True)
    out = named.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", "text_hash", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat one document stay or go together."""
    gone = exact_groups(docs, id_col, text_col).where(~F.col("kept")).select("doc_id", "text_hash")
    return without(docs, gone, F.col(id_col), F.xxhash64(body(text_col)))
