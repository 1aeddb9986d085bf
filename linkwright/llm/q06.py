"""Query of exact dedup."""

from linkwright.llm.common import table
from linkwright.llm.exact_dedup import exact_groups


def op6_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
}
