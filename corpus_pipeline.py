"""A corpus pipeline of five operators: language ID, exact dedup, near-duplicate join, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns documents with the
same columns. Rows of written tables keep no order, so the mixing stage adds each document's place to them as
(mix_slot, mix_offset), whose order is the mix; the last stage returns the contract's digests of the encoded
texts with these places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm.bpe import bpe
from linkwright.llm.common import materialize, table
from linkwright.llm.exact_dedup import drop_copies
from linkwright.llm.jaccard_join import keep_one
from linkwright.llm.language_id import keep_identified
from linkwright.llm.mixing import PLACE, placed
from linkwright.llm.q05 import digests, tokenizer_path
from linkwright.llm.q08 import BLOCK, OTHER, PARTS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return placed(docs, PARTS, OTHER, BLOCK)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # places are the mixing stage's alone: documents that it has not placed get none
    place = [c for c in PLACE if c in docs.columns]
    coded = digests(bpe(docs.select(F.struct("doc_id", *place).alias("key"), "text"), tokenizer_path(), "key"))
    return coded.select("doc_id.doc_id", *coded.columns[1:], *(f"doc_id.{c}" for c in place))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", encoding),
]

#: Neither sampled paths nor BPE can be said in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
