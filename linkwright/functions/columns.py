"""Derived columns of the catalog: rating, keys, flags, labels, times and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CHARACTERISTICS = ("Custom", "Standard", "One Saber", "No Arrows", "90 Degree", "360 Degree", "Lightshow", "Lawless")
DIFFICULTIES = ("Easy", "Normal", "Hard", "Expert", "Expert+")
RANKED_LABELS = {1: "SS RANKED", 2: "BL RANKED", 4: "SS QUALIFIED", 8: "BL QUALIFIED"}
UPLOAD_LABELS = {1: "CURATED", 2: "VERIFIED"}
MOD_LABELS = {1: "NE", 2: "ME", 4: "CHROMA", 8: "CINEMA"}
ONE_CLICK, MAP_PAGE, DOWNLOAD, COVER = "beatsaver://", "https://beatsaver.com/maps/", "https://beatsaver.com/api/download/key/", "https://cdn.beatsaver.com/"

HASH_BYTES = 20


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves up, as no built-in rounding of doubles does."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def rating(up: Column, down: Column) -> Column:
    """Share of upvotes drawn towards one half when votes are few, to three places; 0 without votes."""
    total = up + down
    share = up / total
    pull = F.pow(F.lit(2.0), -(F.log(total / 2 + 1) / F.log(F.lit(3.0))))
    return F.when(total == 0, F.lit(0.0)).otherwise(half_up(share - (share - 0.5) * pull, 3))


def map_key(map_id: Column) -> Column:
    return F.lower(F.hex(map_id))


def hash_at(blob: Column, i: Column) -> Column:
    """The i-th hash in a blob of hashes laid end to end, in hex."""
    return F.lower(F.hex(F.substring(blob, i * HASH_BYTES + 1, F.lit(HASH_BYTES))))


def uploader(name: Column, level_author: Column) -> Column:
    """An absent uploader is the level's author; an empty name stays empty."""
    return F.coalesce(name, level_author)


def hundredths(x: Column) -> Column:
    return x / 100.0


def tag_names(tags: Column, tag_list: Column) -> Column:
    """Names of the set bits, lowest first; bits without a name are left out."""
    bit = lambda i: F.call_function("shiftrightunsigned", tags.cast("long"), i.cast("int")).bitwiseAND(F.lit(1)) == 1
    named = F.transform(F.slice(tag_list, 1, 64), lambda name, i: F.when(bit(i) & (name != ""), name))
    return F.array_compact(F.coalesce(named, F.array().cast("array<string>")))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) == bit


def flag_labels(flags: Column, labels: dict[int, str]) -> Column:
    return F.array_compact(F.array(*(F.when(has_flag(flags, bit), F.lit(name)) for bit, name in labels.items())))


def code_label(code: Column, names: tuple[str, ...]) -> Column:
    known = reduce(lambda c, kv: c.when(code == kv[0], F.lit(kv[1])), list(enumerate(names))[1:], F.when(code == 0, F.lit(names[0])))
    return known.otherwise(F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")")))


def characteristic_label(code: Column) -> Column:
    return code_label(code, CHARACTERISTICS)


def difficulty_label(code: Column) -> Column:
    return code_label(code, DIFFICULTIES)


def duration_text(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def iso_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def iso_datetime(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_datetime_ms(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def one_click_url(key: Column) -> Column:
    return F.concat(F.lit(ONE_CLICK), key)


def map_page_url(key: Column) -> Column:
    return F.concat(F.lit(MAP_PAGE), key)


def download_url(key: Column) -> Column:
    return F.concat(F.lit(DOWNLOAD), key)


def cover_url(hash_: Column) -> Column:
    return F.concat(F.lit(COVER), hash_, F.lit(".jpg"))


def percent_text(share: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f", half_up(share * 100, digits).cast("double"))
