"""Query of the n-gram Jaccard join."""

from linkwright.llm.common import table
from linkwright.llm.jaccard_join import jaccard_classes


def op10_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES = {}
