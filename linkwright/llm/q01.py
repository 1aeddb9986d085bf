"""Queries of language ID."""

from linkwright.llm.common import table
from linkwright.llm.language_id import identify_documents, identify_pages


def op1_language_id(spark, sf_dir):
    return identify_documents(table(spark, sf_dir, "documents"))


def language_id_pages(spark, sf_dir):
    return identify_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op1_language_id": op1_language_id, "language_id_pages": language_id_pages}
ORACLES = {}
