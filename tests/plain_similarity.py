"""Similarity of single texts, one after another: what batches are held against."""

from __future__ import annotations


def jaro_of(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    mine = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and not free[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            free[j] = False
            mine.append(c)
    if not mine:
        return 0.0
    theirs = [c for c, f in zip(b, free) if not f]
    m = len(mine)
    moved = sum(x != y for x, y in zip(mine, theirs))
    return (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3


def winkler_of(a: str, b: str) -> float:
    j = jaro_of(a, b)
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return j + 0.1 * same * (1 - j)


def dice_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return float(not x and not y)
    return 2 * len(x & y) / (len(x) + len(y))


def part_of(a: str, b: str) -> float:
    return 0.8 if min(len(a), len(b)) >= 3 and (a in b or b in a) else 0.0


def fuzzy_of(a: str, b: str) -> float:
    return 1.0 if a == b else max(part_of(a, b), winkler_of(a, b), dice_of(a, b))  # word Jaccard never exceeds Dice


def compared(a: str, b: str, threshold: float) -> bool | tuple[str, str]:
    """The verdict where words alone decide, else the letters to compare: leading words that both texts share don't count."""
    if a == b or dice_of(a, b) >= threshold:
        return True
    if " " in a and " " in b:
        differ = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        cut = a.rfind(" ", 0, differ) + 1 if differ else 0
        if cut:
            return (a[cut:], b[cut:]) if a[cut:] and b[cut:] else False
    return a, b


def token_aware_of(a: str, b: str, threshold: float) -> bool:
    """Fuzzy match that is not carried by leading words that both texts share."""
    c = compared(a, b, threshold)
    return c if isinstance(c, bool) else winkler_of(*c) >= threshold


def significant_of(a: str, b: str) -> bool:
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    return (len(short) >= 6 or " " in short) and f" {short} " in f" {long_} "


def not_siblings(variants: list[str]) -> list[str]:
    after = [*variants[1:], ""]
    return [v for v, n in zip(variants, after) if " " in v or not n or n.replace(" ", "") != v]


def titles_match(track: list[str], song: list[str], threshold: float) -> bool:
    if any(t == m or significant_of(t, m) for t in track for m in song):
        return True
    return any(token_aware_of(t, m, threshold) for t in not_siblings(track) for m in not_siblings(song))


def best_of(a: list[str], b: list[str]) -> float:
    return max((fuzzy_of(x, y) for x in a for y in b), default=0.0)


def score_of(track_title: list[str], track_artist: list[str], title: list[str], artist: list[str]) -> float:
    """The worse of the best title score and the best artist score."""
    return min(best_of(track_title, title), best_of(track_artist, artist))
