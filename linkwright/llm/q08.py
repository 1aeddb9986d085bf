"""Query of mixing."""

from linkwright.llm.common import table
from linkwright.llm.mixing import mix

#: Target weights, in thousandths.
PARTS = {f"src{k}": 135 if k == 0 else 45 for k in range(20)}
OTHER = 10
BLOCK = 16


def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"), PARTS, OTHER, BLOCK)


QUERIES = {"op8_mixing": op8_mixing}
_P = [*PARTS.values(), OTHER]
ORACLES = {
    "op8_mixing": f"""
WITH RECURSIVE job AS (SELECT unnest(range(1, {len(_P) + 1})) AS k, unnest({_P}) AS p, unnest({list(PARTS)} || [NULL]) AS s),
sched(t, done, k) AS (
  SELECT 0, list_transform({_P}, lambda x: 0), 0
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: CASE WHEN j = c THEN x + 1 ELSE x END), c
  FROM (SELECT t, done, list_min(list_filter(list_transform({_P}, lambda p, j: {{'d': ((done[j] + 1) * 1000 + p - 1) // p, 'o': j, 'r': done[j] * 1000 // p}}),
               lambda x: x.r <= t AND done[x.o] < {_P}[x.o])).o AS c FROM sched WHERE t < 1000)
),
turns AS (SELECT t - 1 AS slot, k, done[k] - 1 AS turn FROM sched WHERE t > 0),
numbered AS (SELECT doc_id, source, s, k, p, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST) - 1 AS n
  FROM documents JOIN job ON CASE WHEN source IN (SELECT s FROM job WHERE s IS NOT NULL) THEN source = s ELSE s IS NULL END)
SELECT doc_id, source, s AS mix_stratum, n // {BLOCK} AS mix_block, n // {BLOCK} // p * 1000 + slot AS mix_slot, n % {BLOCK} AS mix_offset,
       n // {BLOCK} // p * 1000 + turn * 1000 // p AS mix_release, n // {BLOCK} // p * 1000 + ((turn + 1) * 1000 + p - 1) // p AS mix_deadline
FROM numbered JOIN turns USING (k) WHERE turn = n // {BLOCK} % p"""
}
