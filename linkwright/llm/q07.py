"""Query of suffix-array dedup."""

from pyspark.sql import functions as F

from linkwright.llm.common import table
from linkwright.llm.suffix_dedup import dedup_passages


def op7_suffix_dedup(spark, sf_dir):
    out = dedup_passages(table(spark, sf_dir, "documents"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES = {}
