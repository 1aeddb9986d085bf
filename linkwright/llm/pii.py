"""Personal data by bootstrapped contextual extraction.

Fixed expressions find the seeds: e-mail addresses, IP addresses, card and phone numbers. What stands beside a seed (the
word or the two words before it, the word behind it, both) is a lexical pattern of its kind. The same patterns
also stand beside candidates, identifiers that the expressions leave out: numbers of 7 to 12 digits without a plus sign, card
numbers with other marks between their digits, addresses whose signs are written out or bracketed, IPv6 addresses. Patterns and instances are the two sides of a graph, which Spark
scores in rounds: a pattern has the share of its instances that are known to be of the kind, if
enough of them are; a candidate the chance that not all of its patterns err. Instances count once for a
pattern, whatever the number of copies. Candidates of a high score are found, seeds stay in any case.

Only patterns beside some candidate are scored, and seeds are summed for each pattern once, so that rounds work on
edges of candidates.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; rows are documents, repeated
ones too, and a null doc_id is kept; a candidate that could be of two kinds is of the one with the higher score, of
the first listed where these tie; texts may be as long as memory holds one (all expressions are linear in
them); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.common import materialize
from linkwright.shipping import arrow_map

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Known instances that a pattern needs, the share that makes it one, rounds, and the score that makes a find.
SUPPORT, PATTERN_LEAST, ROUNDS, FOUND_LEAST = 3, 0.5, 3, 0.9
#: Code points before and behind a span in which words of its context are looked for.
REACH = 60

_SOME = re.compile(r"[0-9@]|[(\[{]at[)\]}]|\sat\s", re.I)
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# starts inside a run of digits can't match where its first digit doesn't
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
_BRACKETED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[(\[{]\.[)\]}] ?[0-9]{1,3}){3}(?![0-9])")
_DOT = r"(?:\s?[(\[{](?:dot|\.)[)\]}]\s?|\sdot\s)"
_WRITTEN_AT = re.compile(rf"(?:\s?[(\[{{](?:at|@)[)\]}}]\s?[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)+|\sat\s[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+)", re.I)
_WORD = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]


# ---- seeds ----


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    """Where the run of an address's first part begins that ends at ``at``."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    return start


def seeds(text: str) -> list[Span]:
    """(kind, start, end) by the fixed expressions, by kind and start."""
    out, done = [], 0
    for m in _HOST.finditer(text):
        start = _local_start(text, m.start(), done)
        if start < m.start():
            done = m.end()
            out.append((EMAIL, start, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            out.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((PHONE, m.start(), m.end()))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


# ---- candidates and contexts ----


def candidates(text: str, known: list[Span]) -> list[tuple[int, int, list[int]]]:
    """(start, end, kinds) of identifiers that are no seeds and meet none."""
    some = []
    for m in _NUMBER.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):  # a number that fails its own check is no card in any context
            some.append((m.start(), m.end(), [CARD]))
        elif 7 <= len(digits) <= 12:
            some.append((m.start(), m.end(), [PHONE]))
    some += [(m.start(), m.end(), [IP]) for p in (_IPV6, _BRACKETED_IP) for m in p.finditer(text)]
    done = 0
    for m in _WRITTEN_AT.finditer(text):
        start = _local_start(text, m.start(), done)
        if start < m.start():
            done = m.end()
            some.append((start, done, [EMAIL]))
    out, at, taken = [], 0, sorted((s, e) for _, s, e in known)
    reached = 0
    for start, end, kinds in sorted(some):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= reached and (at == len(taken) or taken[at][0] >= end):
            out.append((start, end, kinds))
            reached = end
    return out


def plain(kind: int, text: str) -> str:
    """What spans of one identifier have in common."""
    if kind == EMAIL:
        text = re.sub(r"\s?[(\[{](?:at|@)[)\]}]\s?|\sat\s", "@", text.lower())
        return re.sub(_DOT, ".", text)
    if kind == IP:
        return re.sub(r"[ (\[{)\]}]", "", text.lower())
    return _digits(text)


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span's context, in its line."""
    before = text[max(0, start - REACH) : start].rpartition("\n")[2]
    behind = text[end : end + REACH].partition("\n")[0]
    left = [w.lower() for w in _WORD.findall(before)[-2:]]
    right = next((m.group().lower() for m in _WORD.finditer(behind)), None)
    out = [f"< {left[-1]}"] if left else []
    if len(left) == 2:
        out.append(f"<< {left[0]} {left[1]}")
    if right is not None:
        out.append(f"> {right}")
        if left:
            out.append(f"<> {left[-1]} {right}")
    return out


_SPAN = "struct<kind:int,start:bigint,end:bigint>"
_SEEN = "struct<start:bigint,end:bigint,kinds:array<int>,norm:string,patterns:array<string>>"
_SPAN_TYPE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_SEEN_TYPE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kinds", pa.list_(pa.int32())), ("norm", pa.string()), ("patterns", pa.list_(pa.string()))])


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, known, open) of every text: seeds, and seeds and candidates with their contexts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            base, known, open_ = [], [], []
            for text in batch["text"].to_pylist():
                spans = seeds(text) if _SOME.search(text) else []
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                known.append([{"start": s, "end": e, "kinds": [k], "norm": plain(k, text[s:e]), "patterns": patterns(text, s, e)} for k, s, e in spans])
                others = candidates(text, spans) if _SOME.search(text) else []
                open_.append([{"start": s, "end": e, "kinds": ks, "norm": plain(ks[0], text[s:e]), "patterns": patterns(text, s, e)} for s, e, ks in others])
            columns = [batch["doc_id"], pa.array(base, pa.list_(_SPAN_TYPE)), pa.array(known, pa.list_(_SEEN_TYPE)), pa.array(open_, pa.list_(_SEEN_TYPE))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "known", "open"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return arrow_map(rows, batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base array<{_SPAN}>, known array<{_SEEN}>, open array<{_SEEN}>")


# ---- the graph ----


def _edges(marks: DataFrame, which: str) -> DataFrame:
    """(pattern, norm, kinds), each once."""
    seen = marks.select(F.explode(which).alias("s")).select("s.norm", "s.kinds", F.explode("s.patterns").alias("pattern"))
    return seen.distinct()


def scored_candidates(marks: DataFrame, support: int = SUPPORT, pattern_least: float = PATTERN_LEAST, rounds: int = ROUNDS) -> DataFrame:
    """(norm, kind, score) of candidates that some pattern speaks for."""
    open_ = materialize(_edges(marks, "open"))
    sure = _edges(marks, "known").select("pattern", "norm", F.col("kinds")[0].alias("kind"))
    # an identifier that is a seed elsewhere is known wherever it stands
    known_norms = marks.select(F.explode("known").alias("s")).select("s.norm", F.col("s.kinds")[0].alias("kind")).distinct()
    beside = open_.select(F.col("pattern").alias("_p")).distinct()
    sure = materialize(sure.join(beside, F.col("pattern") == F.col("_p"), "left_semi"))
    held = sure.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("sure"))
    every = sure.select("pattern", "norm").unionByName(open_.select("pattern", "norm")).distinct().groupBy(F.col("pattern").alias("_all")).agg(F.count(F.lit(1)).alias("total"))
    ways = materialize(open_.select("norm", "pattern", F.explode("kinds").alias("kind")).distinct())
    given = materialize(ways.select("norm", "kind").distinct().join(known_norms, ["norm", "kind"], "left_semi").withColumn("score", F.lit(1.0)))
    scores = given
    new = ways.join(sure.select(F.col("pattern").alias("_p"), F.col("norm").alias("_n"), F.col("kind").alias("_k")), (F.col("pattern") == F.col("_p")) & (F.col("norm") == F.col("_n")) & (F.col("kind") == F.col("_k")), "left_anti")
    new = materialize(new)
    for _ in range(rounds):
        won = new.join(scores, ["norm", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("won"), F.count(F.when(F.col("score") >= FOUND_LEAST, 1)).alias("found"))
        both = held.select("pattern", "kind", "sure", F.lit(0.0).alias("won"), F.lit(0).alias("found")).unionByName(won.select("pattern", "kind", F.lit(0).alias("sure"), "won", "found"))
        rule = both.groupBy("pattern", "kind").agg(F.sum("sure").alias("sure"), F.sum("won").alias("won"), F.sum("found").alias("found")).join(every, F.col("pattern") == F.col("_all"))
        share = (F.col("sure") + F.col("won")) / (F.col("total") + 1)
        rule = rule.where((F.col("sure") + F.col("found") >= support) & (share >= pattern_least)).select("pattern", "kind", share.alias("share"))
        # no pattern is certain, as its share is below one
        said = ways.join(rule, ["pattern", "kind"]).groupBy("norm", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("share"))))).alias("score"))
        scores = materialize(given.unionByName(said).groupBy("norm", "kind").agg(F.max("score").alias("score")))
    return scores


def found_spans(marks: DataFrame, scores: DataFrame, least: float = FOUND_LEAST) -> DataFrame:
    """(row, more) of rows with candidates of a high score: their spans."""
    best = Window.partitionBy("norm").orderBy(F.desc("score"), "kind")
    one = scores.where(F.col("score") >= least).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("norm", "kind")
    seen = marks.where(F.size("open") > 0).select("row", F.explode("open").alias("s")).select("row", "s.norm", "s.start", "s.end")
    span = F.struct(F.col("kind"), F.col("start"), F.col("end"))
    return seen.join(one, "norm").groupBy("row").agg(F.collect_list(span).alias("more"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every document: arrays of (kind, start, end), by kind and start."""
    marks = materialize(marked(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    found = found_spans(marks, scored_candidates(marks)).select(F.col("row").alias("_row"), "more")
    out = marks.select("row", "doc_id", "base").join(found, F.col("row") == F.col("_row"), "left")
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"))
