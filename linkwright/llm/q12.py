"""Query of conversation repair."""

from linkwright.llm.common import table
from linkwright.llm.conversation_repair import damaged_rows, report


def op12_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return report(conversations, damaged_rows(conversations))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
#: Least strings over the paths of a grammar are beyond plain SQL; tests/llm tries all strings of edits.
ORACLES = {}
