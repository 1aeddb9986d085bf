"""Normal forms of artist and title texts.

What is regular is a Spark expression. Three things are not, and stay in small helpers that run on
distinct strings: compatibility decomposition, nested parentheses, and splitting artist credits in order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.shipping import arrow_helper, arrow_map

# Characters that look like ASCII ones; full-width forms follow from a rule.
LOOKALIKES = {
    "'": "‘’‚‛‹›",
    '"': "“”„‟«»",
    "-": "‐‑‒–—―",
    ".": "…",
    "*": "•",
    " ": "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000",
}
_FROM = "".join(LOOKALIKES.values()) + "".join(map(chr, range(0xFF01, 0xFF5F)))
_TO = "".join(k * len(v) for k, v in LOOKALIKES.items()) + "".join(map(chr, range(0x21, 0x7F)))
_FOLD = str.maketrans(_FROM, _TO)

# Words and patterns.
FILLER_WORDS = "edition deluxe remaster remastered remix remixed ep lp single explicit clean reissue rerelease expanded anniversary collector bonus version mono stereo and bgm theme ost".split()
GENERIC_WORDS = "remix remixed bootleg flip rework remake edit mix cover mashup radio extended original album club dub single version ver vip instrumental full short size the feat featuring".split()
REMIX_WORDS = "remix remixed bootleg flip rework remake edit mix cover mashup".split()
SPACES = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
MAPPED_BY = rf"(?:beatmapp?e?d?|mapp?e?d?|charte?d?|edit(?:ed)?|remapp?e?d?)[{SPACES}]+by\b"

MIN_LENGTH = 3
_STRIP = "\t\n\x0b\f\r \u2028\u2029\ufeff" + LOOKALIKES[" "]
_FLAGS = re.ASCII | re.IGNORECASE
_BRACKETED_MAPPER = re.compile(rf"[(\[{{][^()\[\]{{}}]*\b{MAPPED_BY}[^()\[\]{{}}]*[)\]}}]", _FLAGS)
_MAPPER_FIRST = re.compile(MAPPED_BY, _FLAGS)
_HARD = re.compile(rf"[{SPACES}]*(?:\|+|//+|;)[{SPACES}]*")
_SOFT = re.compile(rf"[{SPACES}]+(?:feat\.?|ft\.?|featuring|vs\.?|x|×|&|\+|and|with|w/)[{SPACES}]+|[{SPACES}]*,[{SPACES}]*", _FLAGS)
_BLANKS = re.compile(rf"[{SPACES}]+")
_GROUP = re.compile(r"\(([^()]*)\)|\[([^\[\]]*)\]")
_REMIX = re.compile(rf"\b(?:{'|'.join(REMIX_WORDS)})\b", _FLAGS)
_EDGE = re.compile(r"^[^a-z0-9]+|[^a-z0-9]+$")
_OTHER = re.compile(r"[^a-z0-9]+")


# ---- Spark expressions ----


def fold_lookalikes(s: Column) -> Column:
    return F.translate(s, _FROM, _TO)


def variants_of_folded(folded: Column) -> Column:
    """[stripped, spaced] of a text whose diacritics are folded; one where they agree, none where nothing is left."""
    low = F.lower(folded)
    stripped = F.regexp_replace(low, "[^a-z0-9]+", "")
    spaced = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    return F.filter(F.array_distinct(F.array(stripped, spaced)), lambda v: v != "")


def fold_diacritics(s: Column) -> Column:
    """Decomposed (NFKD) without combining marks U+0300 to U+036F."""
    fold = arrow_helper(_fold_batch, "string")
    return F.when(s.rlike("^[\\x00-\\x7f]*$"), s).otherwise(fold(s))


def _fold_batch(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fold_marks(t) for t in texts.to_pylist()], pa.string())


def normalize_variants(s: Column) -> Column:
    return variants_of_folded(fold_diacritics(fold_lookalikes(s)))


def normalized_key(artist: Column, title: Column) -> Column:
    return F.coalesce(F.get(normalize_variants(F.concat(artist, F.lit(" "), title)), F.lit(0)), F.lit(""))


def strip_filler_words(s: Column) -> Column:
    words = F.split(s, f"[{SPACES}]+")
    bare = lambda w: F.regexp_replace(F.lower(w), "^[^a-z0-9]+|[^a-z0-9]+$", "")
    left = F.filter(words, lambda w: ~bare(w).isin(FILLER_WORDS))
    return F.regexp_replace(F.array_join(left, " "), f"^[{SPACES}]+|[{SPACES}]+$", "")


def trigrams(s: Column) -> Column:
    """All substrings of three characters; the text itself if it is shorter."""
    # the text is cut into characters once: a substring is looked for from the text's front, which takes the square of a long text
    places = lambda c: F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0)))
    of = lambda c: F.transform(places(c), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))
    each = F.transform(F.array(F.split(s, "")), of)[0]
    return F.when(F.length(s) < 3, F.array(s)).otherwise(each)


def unique_trigrams(s: Column) -> Column:
    return F.when(F.length(s) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(trigrams(s)))


def signature(variants: Column) -> Column:
    return F.array_join(variants, "|")


# ---- helpers on single strings ----


def fold_marks(s: str) -> str:
    if s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(c) <= 0x36F)


def variants(s: str) -> list[str]:
    low = fold_marks(s.translate(_FOLD)).lower()
    both = [_OTHER.sub("", low), _OTHER.sub(" ", low).strip(" ")]
    return [v for v in dict.fromkeys(both) if v]


def strip_trailing_parens(s: str) -> str:
    """Balanced groups at the end go, one after another, but never the whole text."""
    s = s.rstrip(_STRIP)
    while s.endswith(")"):
        depth = 0
        for at in range(len(s) - 1, -1, -1):
            depth += (s[at] == ")") - (s[at] == "(")
            if depth == 0:
                break
        if depth or at == 0:
            break
        s = s[:at].rstrip(_STRIP)
    return s


def without_filler(s: str) -> str:
    return " ".join(w for w in _BLANKS.split(s) if _EDGE.sub("", w.lower()) not in FILLER_WORDS).strip(_STRIP)


def field_variants(s: str) -> list[str]:
    return [v for v in variants(without_filler(strip_trailing_parens(s))) if len(v) >= MIN_LENGTH]


def split_credit(s: str) -> list[str]:
    """The whole credit, its hard parts, and the soft parts of each, without credits of mappers."""
    whole = _BRACKETED_MAPPER.sub(" ", s)
    found = [whole]
    for hard in _HARD.split(whole):
        soft = _SOFT.split(hard)
        found += [hard, *(soft if len(soft) > 1 else [])]
    found = [x.strip(_STRIP) for x in found]
    return list(dict.fromkeys(x for x in found if x and not _MAPPER_FIRST.match(x)))


def artist_variants(s: str) -> list[str]:
    return list(dict.fromkeys(v for part in split_credit(s) for v in field_variants(part)))


def remix_tags(title: str) -> list[str]:
    """Words that tell whose version a title is."""
    clauses = [m[1] if m[1] is not None else m[2] for m in _GROUP.finditer(title)]
    _, dash, after = title.partition(" - ")
    clauses += [after] if dash else []
    words = [w for c in clauses if _REMIX.search(c) for w in (variants(c) or [""])[-1].split(" ")]
    return list(dict.fromkeys(w for w in words if len(w) >= MIN_LENGTH and w not in GENERIC_WORDS and not w.isdigit()))


TEXT_KEYS = "text string, artist array<string>, title array<string>, tags array<string>, credit array<string>, bare string"


def text_keys(texts: DataFrame) -> DataFrame:
    """TEXT_KEYS of each distinct string in column ``text``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = pa.list_(pa.string())
        for batch in it:
            own = batch["text"].to_pylist()
            columns = [[f(t) for t in own] for f in (artist_variants, field_variants, remix_tags, split_credit)]
            bare = pa.array([strip_trailing_parens(t) for t in own], pa.string())
            yield pa.RecordBatch.from_arrays([batch["text"], *(pa.array(c, many) for c in columns), bare], ["text", "artist", "title", "tags", "credit", "bare"])

    return arrow_map(texts.select("text").where("text IS NOT NULL").distinct(), batches, TEXT_KEYS)
