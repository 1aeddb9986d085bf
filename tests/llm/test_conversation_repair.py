"""Conversation repair against all strings of edits in the order of their costs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from linkwright.llm.conversation_repair import damaged_rows, repair, repaired, report

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def damage(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def best_edits(marks):
    """marks: (initial, must go, truncated)."""
    heap = [(0, "", 0, 0)]
    while True:
        cost, done, k, g = heapq.heappop(heap)
        if k == len(marks) and g in (0, 3):
            return cost, done
        for c, to in NEXT[g].items():
            if c != "s" and cost <= 2 * len(marks):
                heapq.heappush(heap, (cost + 5, done + "I", k, to))
        if k < len(marks):
            initial, gone, cut = marks[k]
            heapq.heappush(heap, (cost + 2, done + "D", k + 1, g))
            if not gone:
                if initial in NEXT[g]:
                    heapq.heappush(heap, (cost + 5 * cut, done + "K", k + 1, NEXT[g][initial]))
                for c, to in NEXT[g].items():
                    if c != "s":
                        heapq.heappush(heap, (cost + 1 + 5 * cut, done + "R", k + 1, to))


def brute(rows):
    out = []
    damaged = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        turns = {r[1] for r in own} - {None}
        n = {"blank": 0, "duplicate": 0, "truncated": 0}
        marks, seen = [], set()
        for _, _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(marks, marks[1:]))
        cost, audit = best_edits(marks)
        lines, g, left = [], 0, iter(own)
        for e in audit:
            if e == "I":
                g = NEXT[g]["a" if g == 2 else "u"]
                lines.append(("assistant" if g == 3 else "user") + ":")
                continue
            _, _, role, text = next(left)
            if e == "K":
                g = NEXT[g][role[:1]]
            elif e == "R":
                g = NEXT[g]["a" if g == 2 else "u"]
                role = "assistant" if g == 3 else "user"
            if e != "D":
                lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, conversations, most=7):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(conversations)]:
        for t in range(rng.randint(1, most)):
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 1, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sure"])
            rows.append((c, turn, role, rng.choice(["Yes.", "No", "Why?\n ", " ", None, "", "end!", f"text {rng.randint(0, 99)}."])))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("segment_rows", [1, 2, 5, 256])
def test_all_edits(spark, segment_rows):
    rows = made(segment_rows, 60 if segment_rows > 2 else 25)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", copies int, audit string").repartition(3)
    got = report(df, damaged_rows(df), segment_rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_long_conversation_and_copies(spark):
    """A conversation far longer than a segment, on many tasks, gives what one segment gives."""
    rng = random.Random(3)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"a {t}.", f"b {t}", "again."])) for t in range(900)] + [(8, 0, "user", "same.")] * 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    one = {tuple(r) for r in report(df, damaged_rows(df), 5000).collect()}
    assert {tuple(r) for r in report(df, damaged_rows(df), 16).collect()} == one and len(one) == 2


def test_rows_of_a_repair(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "How are you?"), (1, 2, "user", " "), (2, 0, "system", "Be brief.")], SCHEMA)
    rows, found, _ = repair(df.withColumn("copies", F.lit(1)))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()} == {1: (3, "RKD"), 2: (2, "D")}
    assert [tuple(r) for r in repaired(rows, found).orderBy("conv_id", "position").collect()] == [(1, 0, "user", "Hello."), (1, 1, "assistant", "How are you?")]


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert report(df, damaged_rows(df)).collect() == []
    some = spark.createDataFrame([(1, 1, "user", "Hi.")], SCHEMA)
    got = report(some, damaged_rows(some).where("false")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
