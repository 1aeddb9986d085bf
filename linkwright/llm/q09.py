"""Query of the quality classifier."""

from pyspark.sql import functions as F

from linkwright.llm.byte_cnn import classify
from linkwright.llm.common import table


def fold(n):
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op9_quality_classifier(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold(5) != 0)
    out = classify(table(spark, sf_dir, "documents"), labels)
    held = F.coalesce(fold(5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES = {}
