"""Query of personal data."""

from pyspark.sql import functions as F

from linkwright.llm.common import table
from linkwright.llm.pii import KINDS, personal_data


def _joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _number_of(kind):
    # a second parameter would be the place in the array
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def op11_pii(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [_number_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    more = (F.size("spans") - F.size("base")).cast("bigint").alias("n_found")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), more)


QUERIES = {"op11_pii": op11_pii}
#: Rounds over a graph of patterns are beyond plain SQL; tests/llm holds the seeds and the scores against plain versions.
ORACLES = {}
