"""Query of spelling variants, with SQL that finds near words by their deletions."""

from linkwright.llm.common import table
from linkwright.llm.spelling_variants import variant_groups, vocabulary


def op13_spelling_variants(spark, sf_dir):
    return variant_groups(vocabulary(table(spark, sf_dir, "documents")))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}


def crc_sql(text):
    """Unsigned CRC-32 of the UTF-8 bytes of a text: eight shifts for each byte."""
    shift = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END"
    step = "c"
    for _ in range(8):
        step = f"list_transform([{step}], lambda c: {shift})[1]"
    byte = f"('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT"
    folded = f"list_reduce(list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte}), lambda a, b: list_transform([xor(a, b)], lambda c: {step})[1], 4294967295::BIGINT)"
    return f"xor({folded}, 4294967295::BIGINT)"


ORACLES = {
    "op13_spelling_variants": f"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (SELECT run, k, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY 1),
known AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * words.n THEN near END AS form, CASE WHEN near_n >= 10 * words.n THEN near_n END AS form_n
          FROM words LEFT JOIN best USING (word)),
follow(word, root) AS (SELECT word, word FROM known UNION ALL SELECT follow.word, known.form FROM follow JOIN known ON known.word = follow.root WHERE known.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN follow USING (word) WHERE root IN (SELECT word FROM known WHERE form IS NULL)"""
}
