"""Query of quality rules."""

from linkwright.llm.common import table
from linkwright.llm.quality_rules import quality_rules


def op3_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "failed_rules", "certificate")


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {}
