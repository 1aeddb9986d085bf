"""Query of line dedup."""

from pyspark.sql import functions as F

from linkwright.llm.common import table
from linkwright.llm.line_dedup import dedup_lines


def op2_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {
    "op2_line_dedup": """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(ls) - 2)) AS line, ls FROM l WHERE len(ls) >= 3),
s AS (SELECT doc_id, line, array_to_string(ls[line + 1:line + 3], chr(10)) AS win FROM w),
later AS (SELECT doc_id, line FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY win ORDER BY doc_id, line) AS k FROM s WHERE win <> chr(10) || chr(10)) WHERE k > 1),
cov AS (SELECT DISTINCT doc_id, line + k AS line FROM later, (SELECT unnest([0, 1, 2]) AS k)),
each AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS body FROM l),
kept AS (SELECT e.doc_id, string_agg(e.body, chr(10) ORDER BY e.line) AS body, count(*) AS n FROM each e ANTI JOIN cov c ON e.doc_id = c.doc_id AND e.line = c.line GROUP BY 1)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM l LEFT JOIN kept k ON l.doc_id = k.doc_id"""
}
