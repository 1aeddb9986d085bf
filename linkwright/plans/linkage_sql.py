"""SQL of the linkage for DuckDB: keys of texts, similarity, and matching by all pairs, without the library's helpers.

Each function gives SQL text. Relations are common table expressions over the views ``songs`` and ``tracks``.
"""

from __future__ import annotations

from linkwright.functions import textkeys as T

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
# The values of textkeys' expressions, as SQL text (fixed values).
_MAPPED = "(?:beatmapp?e?d?|mapp?e?d?|charte?d?|edit(?:ed)?|remapp?e?d?)\\s+by\\b"
_SOFT = "(?i)\\s+(?:feat\\.?|ft\\.?|featuring|vs\\.?|x|×|&|\\+|and|with|w/)\\s+|\\s*,\\s*"


def ordered(values: str) -> str:
    """The distinct values of a list in order."""
    return f"list_transform([{values}], lambda l: list_filter(l, lambda x, i: list_position(l, x) = i))[1]"


def variants(text: str) -> str:
    low = f"lower(strip_accents({text}))"
    both = f"[regexp_replace({low}, '[^a-z0-9]+', '', 'g'), trim(regexp_replace({low}, '[^a-z0-9]+', ' ', 'g'))]"
    return f"list_filter({ordered(both)}, lambda v: v <> '')"


def field_variants(text: str) -> str:
    bare = f"rtrim(regexp_replace({text}, '\\s*\\([^()]*\\)$', ''))"
    kept = (
        f"trim(array_to_string(list_filter(string_split_regex({bare}, '\\s+'), lambda w: NOT "
        f"list_contains({_LIST(T.FILLER_WORDS)}, regexp_replace(lower(w), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'))), ' '))"
    )
    return f"list_filter({variants(kept)}, lambda v: length(v) >= 3)"


def remix_tags(text: str) -> str:
    groups = f"list_transform(regexp_extract_all({text}, '\\([^()]*\\)|\\[[^\\[\\]]*\\]'), lambda c: substr(c, 2, length(c) - 2))"
    clauses = (
        f"list_filter(list_concat({groups}, CASE "
        f"WHEN contains({text}, ' - ') THEN [substr({text}, position(' - ' IN {text}) + 3)] "
        f"ELSE [] END), lambda c: regexp_matches(c, '(?i)\\b(?:{'|'.join(T.REMIX_WORDS)})\\b'))"
    )
    words = f"flatten(list_transform({clauses}, lambda c: string_split(trim(regexp_replace(lower(strip_accents(c)), '[^a-z0-9]+', ' ', 'g')), ' ')))"
    return ordered(
        f"list_filter({words}, lambda w: length(w) >= 3 AND NOT list_contains({_LIST(T.GENERIC_WORDS)}, w) "
        f"AND NOT regexp_full_match(w, '[0-9]+'))")


#: keys(text, credit, artist, title, tags) of all texts of songs and tracks.
KEYS = f"""
texts AS (SELECT DISTINCT text FROM (
  SELECT unnest([song_author, level_author, song_name, CASE WHEN position(' - ' IN song_name) > 1 THEN substr(song_name, 1, position(' - ' IN song_name) - 1) END,
    CASE WHEN position(' - ' IN song_name) > 1 THEN substr(song_name, position(' - ' IN song_name) + 3) END]) AS text FROM songs
  UNION ALL SELECT unnest([artist, title]) FROM tracks) WHERE text IS NOT NULL),
wholes AS (SELECT text, regexp_replace(text, '(?i)[(\\[{{][^()\\[\\]{{}}]*\\b{_MAPPED}[^()\\[\\]{{}}]*[)\\]}}]', ' ', 'g') AS whole FROM texts),
cuts AS (SELECT text, list_prepend(whole, flatten(list_transform(string_split_regex(whole, '\\s*(?:\\|+|//+|;)\\s*'),
  lambda h: CASE WHEN len(string_split_regex(h, '{_SOFT}')) > 1 THEN list_prepend(h, string_split_regex(h, '{_SOFT}')) ELSE [h] END))) AS parts FROM wholes),
credits AS (SELECT text, {ordered(f"list_filter(list_transform(parts, lambda p: trim(p)), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^{_MAPPED}'))")} AS credit FROM cuts),
keys AS (SELECT text, credit, {ordered(f"flatten(list_transform(credit, lambda p: {field_variants('p')}))")} AS artist, {field_variants('text')} AS title, {remix_tags('text')} AS tags FROM credits)"""

#: tk(id, artist, title, tags).
TRACK_SIDE = f"""{KEYS},
tk AS (SELECT id, coalesce(a.artist, []) AS artist, coalesce(n.title, []) AS title, coalesce(n.tags, []) AS tags
  FROM tracks LEFT JOIN keys a ON a.text = tracks.artist LEFT JOIN keys n ON n.text = tracks.title)"""

#: tk and sk(map_id, artist, title, tags).
SIDES = f"""{TRACK_SIDE},
dashed AS (SELECT map_id, song_author, level_author, song_name, position(' - ' IN song_name) AS dash FROM songs),
sk AS (SELECT map_id, {ordered("list_concat(list_concat(coalesce(a.artist, []), coalesce(l.artist, [])), coalesce(c.artist, []))")} AS artist,
  {ordered("list_concat(coalesce(n.title, []), coalesce(r.title, []))")} AS title, coalesce(n.tags, []) AS tags
  FROM dashed LEFT JOIN keys a ON a.text = song_author LEFT JOIN keys l ON l.text = level_author LEFT JOIN keys n ON n.text = song_name
  LEFT JOIN keys c ON dash > 1 AND c.text = substr(song_name, 1, dash - 1) LEFT JOIN keys r ON dash > 1 AND r.text = substr(song_name, dash + 3))"""


def significant(a: str, b: str) -> str:
    short, long_ = f"CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END"
    return f"((length({short}) >= 6 OR contains({short}, ' ')) AND contains(' ' || {long_} || ' ', ' ' || {short} || ' '))"


def jaro(pairs: str, name: str) -> str:
    """Relations that end in ``name``(a, b, score): Jaro-Winkler of distinct pairs, whose matched letters a list fold finds one by one."""
    return f"""
{name}_p AS (SELECT DISTINCT a, b, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS w FROM {pairs} WHERE a <> b),
{name}_m AS (SELECT a, b, w, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(1, length(a) + 1), lambda i: [i])),
  lambda acc, x: list_append(acc, coalesce(list_min(list_filter(range(greatest(1, x[1] - w), least(length(b), x[1] + w) + 1), lambda j: substr(b, j, 1) = substr(a, x[1], 1) AND NOT list_contains(acc, j))), 0))) AS hit FROM {name}_p),
{name}_q AS (SELECT a, b, len(list_filter(hit, lambda h: h > 0)) AS n, list_filter(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN hit[i] > 0 THEN substr(a, i, 1) ELSE '' END), lambda c: c <> '') AS x,
  list_transform(list_sort(list_filter(hit, lambda h: h > 0)), lambda h: substr(b, h, 1)) AS y FROM {name}_m),
{name}_j AS (SELECT a, b, CASE WHEN n = 0 THEN 0.0e0 ELSE (n * 1.0e0 / length(a) + n * 1.0e0 / length(b) + (n - len(list_filter(range(1, n + 1), lambda i: x[i] <> y[i])) / 2.0e0) / n) / 3 END AS j FROM {name}_q),
{name} AS (SELECT a, b, j + 0.1e0 * (coalesce(list_min(list_filter(range(1, least(4, length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))), least(4, length(a), length(b)) + 1) - 1) * (1 - j) AS score FROM {name}_j)"""


_TOKENS = "list_distinct(string_split({0}, ' '))"


def dice(a: str, b: str) -> str:
    x, y = _TOKENS.format(a), _TOKENS.format(b)
    return f"(2.0e0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})))"


def aware(pairs: str, threshold: float, name: str = "aware") -> str:
    """Relations that end in ``name``(a, b): those of distinct pairs that match by words or letters, shared leading words aside."""
    same = "(coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))), least(length(a), length(b)) + 1) - 1)"
    return f"""
{name}_d AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> b),
{name}_s AS (SELECT a, b, {dice('a', 'b')} AS dice, substr(a, 1, {same}) AS lead FROM {name}_d),
{name}_c AS (SELECT a, b, dice, CASE WHEN contains(a, ' ') AND contains(b, ' ') AND contains(lead, ' ') THEN length(lead) - position(' ' IN reverse(lead)) + 1 ELSE 0 END AS cut FROM {name}_s),
{name}_r AS (SELECT a, b, dice, substr(a, cut + 1) AS x, substr(b, cut + 1) AS y FROM {name}_c),{jaro(f"(SELECT x AS a, y AS b FROM {name}_r WHERE dice < {threshold} AND x <> '' AND y <> '')", f"{name}_w")},
{name} AS (SELECT r.a, r.b FROM {name}_r r LEFT JOIN {name}_w w ON w.a = x AND w.b = y WHERE dice >= {threshold} OR w.score >= {threshold})"""


def compatible(t: str, m: str) -> str:
    mention = lambda tags, side: f"len(list_filter({tags}, lambda g: len(list_filter(list_concat({side}.artist, {side}.title), lambda v: contains(v, g))) > 0)) > 0"
    shared = f"len(list_filter({t}.tags, lambda g: len(list_filter({m}.tags, lambda h: contains(g, h) OR contains(h, g))) > 0)) > 0"
    return (
        f"(CASE WHEN len({t}.tags) = 0 AND len({m}.tags) = 0 THEN true WHEN {shared} THEN true "
        f"WHEN len({m}.tags) = 0 THEN {mention(f'{t}.tags', m)} WHEN len({t}.tags) = 0 THEN {mention(f'{m}.tags', t)} "
        f"ELSE false END)"
    )


#: Distinct keys: t(k, sig, artist, title, tags), m(k, artist, title, tags); owns(sig, own) and known(variant).
DISTINCT = f"""{SIDES},
t AS (SELECT row_number() OVER () AS k, array_to_string(artist, '|') AS sig, artist, title, tags FROM (SELECT DISTINCT artist, title, tags FROM tk WHERE len(artist) > 0)),
m AS (SELECT row_number() OVER () AS k, artist, title, tags FROM (SELECT DISTINCT artist, title, tags FROM sk)),
owns AS (SELECT DISTINCT sig, unnest(artist) AS own FROM t),
known AS (SELECT DISTINCT unnest(artist) AS variant FROM m),
exact AS (SELECT DISTINCT sig, own AS variant FROM owns SEMI JOIN known ON own = variant)"""

_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


def accepted(threshold: float) -> str:
    """Relations that end in fuzzy(sig, variant) and accepted(sig, variant)."""
    return f"""{DISTINCT},
grams AS (SELECT variant, {_GRAMS.format('variant')} AS u FROM known),
votes AS (SELECT sig, variant FROM (SELECT sig, {_GRAMS.format('own')} AS g FROM owns ANTI JOIN exact USING (sig)) JOIN grams ON len(g) > 0 AND len(list_intersect(g, u)) >= greatest(2, ceil(len(g) * 0.25)) GROUP BY ALL),{aware("(SELECT own AS a, variant AS b FROM votes JOIN owns USING (sig))", threshold, "near")},
fuzzy AS (SELECT DISTINCT sig, variant FROM votes JOIN owns USING (sig) LEFT JOIN near ON a = own AND b = variant WHERE own = variant OR {significant('own', 'variant')} OR a IS NOT NULL),
accepted AS (SELECT * FROM exact UNION SELECT * FROM fuzzy)"""


def paths(threshold: float) -> str:
    """Relations that end in by_title(t, m) and by_artist(t, m): numbers of matched distinct keys."""
    whole = lambda c: f"list_filter({c}, lambda v, i: contains(v, ' ') OR coalesce({c}[i + 1], '') = '' OR replace({c}[i + 1], ' ', '') <> v)"
    return f"""{accepted(threshold)},
carried AS (SELECT k, unnest(artist) AS variant FROM m),
titled AS (SELECT DISTINCT t.k AS t, m.k AS m, sig FROM (SELECT k, unnest(title) AS v FROM t) x JOIN (SELECT k, unnest(title) AS v FROM m) y USING (v) JOIN t ON t.k = x.k JOIN m ON m.k = y.k WHERE {compatible('t', 'm')}),
asked AS (SELECT DISTINCT sig, variant FROM (SELECT DISTINCT sig, m FROM titled) JOIN carried ON k = m),{aware("(SELECT own AS a, variant AS b FROM asked ANTI JOIN accepted USING (sig, variant) JOIN owns USING (sig))", threshold, "more")},
good AS (SELECT sig, variant FROM asked SEMI JOIN accepted USING (sig, variant) UNION
  SELECT sig, variant FROM asked JOIN owns USING (sig) LEFT JOIN more ON a = own AND b = variant WHERE own = variant OR {significant('own', 'variant')} OR a IS NOT NULL),
by_title AS (SELECT DISTINCT t, m FROM titled JOIN carried ON k = m SEMI JOIN good USING (sig, variant)),
brought AS (SELECT DISTINCT t.k AS t, c.k AS m, t.title AS x, m.title AS y FROM t JOIN accepted USING (sig) JOIN carried c USING (variant) JOIN m ON m.k = c.k WHERE {compatible('t', 'm')}),
both_titles AS (SELECT DISTINCT x, y FROM brought),
pairs AS (SELECT x, y, a, unnest(y) AS b FROM (SELECT x, y, unnest(x) AS a FROM both_titles)),
sure AS (SELECT DISTINCT x, y FROM pairs WHERE a = b OR {significant('a', 'b')}),
letters AS (SELECT x, y, a, unnest({whole('y')}) AS b FROM (SELECT x, y, unnest({whole('x')}) AS a FROM both_titles ANTI JOIN sure USING (x, y))),{aware("letters", threshold, "alike")},
agree AS (SELECT x, y FROM sure UNION SELECT x, y FROM letters SEMI JOIN alike USING (a, b)),
by_artist AS (SELECT t, m FROM brought SEMI JOIN agree USING (x, y)),
found AS (SELECT * FROM by_title UNION SELECT * FROM by_artist)"""


def fanned(relation: str) -> str:
    """(track_id, map_id, t, m) of matched keys."""
    return (
        f"(SELECT tk.id AS track_id, sk.map_id, r.t, r.m FROM {relation} r JOIN t ON t.k = r.t JOIN m ON m.k = r.m JOIN tk "
        f"ON tk.artist = t.artist AND tk.title = t.title AND tk.tags = t.tags JOIN sk ON sk.artist = m.artist "
        f"AND sk.title = m.title AND sk.tags = m.tags)"
    )


_PART = "CASE WHEN least(length(a), length(b)) >= 3 AND (contains(a, b) OR contains(b, a)) THEN 0.8e0 ELSE 0.0e0 END"
#: The score of texts a and b, with ``score`` from Jaro-Winkler.
_FUZZY = f"CASE WHEN a = b THEN 1.0e0 ELSE greatest({_PART}, {dice('a', 'b')}, coalesce(score, 0)) END"


def _each(name: str, lists: str) -> str:
    """Every pair of texts of lists (x, y)."""
    return f"{name} AS (SELECT x, y, a, unnest(y) AS b FROM (SELECT x, y, unnest(x) AS a FROM {lists}))"


def _best(name: str) -> str:
    return f"(SELECT x, y, max({_FUZZY}) AS best FROM {name} LEFT JOIN winkler USING (a, b) GROUP BY x, y)"


_WINKLER = jaro("(SELECT a, b FROM each_artist UNION SELECT a, b FROM each_title)", "winkler")


def scores(threshold: float) -> str:
    """Relations that end in scores(t, m, score)."""
    lists = lambda c: f"(SELECT DISTINCT t.{c} AS x, m.{c} AS y FROM found JOIN t ON t.k = found.t JOIN m ON m.k = found.m)"
    return f"""{paths(threshold)},
{_each('each_artist', lists('artist'))}, {_each('each_title', lists('title'))},{_WINKLER},
scores AS (SELECT found.t, found.m, least(p.best, q.best) AS score FROM found JOIN t ON t.k = found.t JOIN m ON m.k = found.m JOIN {_best('each_artist')} p ON p.x = t.artist AND p.y = m.artist JOIN {_best('each_title')} q ON q.x = t.title AND q.y = m.title)"""


def searched(terms: list[str], least: float, best: int) -> str:
    """For each term the first track whose title holds it against all songs: term, track_id, map_id, score, rank."""
    lists = lambda c: f"(SELECT x, y FROM (SELECT DISTINCT {c} AS x FROM picked), (SELECT DISTINCT {c} AS y FROM sk))"
    return f"""WITH {SIDES},
firsts AS (SELECT term, arg_min(id, (artist, title, id)) AS id FROM (SELECT unnest({_LIST(terms)}) AS term) JOIN tracks ON contains(lower(title), term) GROUP BY term),
picked AS (SELECT term, id, artist, title FROM firsts JOIN tk USING (id)),
{_each('each_artist', lists('artist'))}, {_each('each_title', lists('title'))},{_WINKLER},
scored_pairs AS (SELECT term, picked.id AS track_id, map_id, round(least(p.best, q.best), 9) AS score
  FROM picked CROSS JOIN sk JOIN {_best('each_artist')} p ON p.x = picked.artist AND p.y = sk.artist JOIN {_best('each_title')} q ON q.x = picked.title AND q.y = sk.title)
SELECT term, track_id, map_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, map_id) AS rank FROM scored_pairs WHERE score >= {least}) WHERE rank <= {best}"""


def explained(pairs: str, least: float) -> str:
    """Variant pairs of given (track_id, map_id) that resemble each other: track_id, map_id, part, own, other, score."""
    part = lambda c: (
        f"SELECT track_id, map_id, '{c}' AS part, a, unnest(y) AS b FROM (SELECT track_id, map_id, unnest(tk.{c}) AS a, sk.{c} "
        f"AS y FROM asked JOIN tk ON id = track_id JOIN sk USING (map_id))"
    )
    return f"""WITH {SIDES}, asked AS ({pairs}), parts AS ({part('artist')} UNION ALL {part('title')}),{jaro('parts', 'winkler')}
SELECT track_id, map_id, part, a AS own, b AS other, round({_FUZZY}, 9) AS score FROM parts LEFT JOIN winkler USING (a, b) WHERE {_FUZZY} >= {least}"""
