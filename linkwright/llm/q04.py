"""Query of toxicity."""

from pyspark.sql import functions as F

from linkwright.llm.common import table
from linkwright.llm.q09 import fold
from linkwright.llm.toxicity import toxicity


def op4_toxicity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(3) != 1)
    out = toxicity(table(spark, sf_dir, "documents"), labels)
    held = F.coalesce(fold(3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES = {}
