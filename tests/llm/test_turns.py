"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairwell.llm import turns
from pairwell.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
FULL = re.compile(r"[^\x20\x09-\x0D]")
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        if draw == 1:
            text = ""
        elif draw == 2:
            text = re.sub("[.!?]", "", text)
        elif draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def place(row):
    conv, turn, role, text = row
    key = f"{'' if conv is None else conv}:{len(role)}:{role}{text}"
    return turn is not None, turn or 0, role, hashlib.sha256(key.encode()).digest()


def cheapest(rows, faults):
    """(cost, audit) and the repaired rows: the best of what follows for every place and state."""
    expect, to = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
    best = [[None] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        now = [(0, "") if i == len(rows) and q in (0, 3) else (1000, "") for q in range(4)]
        if i < len(rows):
            for q in range(4):
                found = [(2 + best[i + 1][q][0], "D" + best[i + 1][q][1])]
                if faults[i] not in ("blank", "duplicate"):
                    extra = 5 * (faults[i] == "truncated")
                    first = rows[i][2][:1]
                    if first == "s" and q == 0:
                        found.append((extra + best[i + 1][1][0], "K" + best[i + 1][1][1]))
                    if first == expect[q][0]:
                        found.append((extra + best[i + 1][to[q]][0], "K" + best[i + 1][to[q]][1]))
                    found.append((1 + extra + best[i + 1][to[q]][0], "R" + best[i + 1][to[q]][1]))
                now[q] = min(found)
        for _ in range(3):
            now = [min(now[q], (5 + now[to[q]][0], "I" + now[to[q]][1])) for q in range(4)]
        best[i] = now
    cost, audit = best[0][0]
    out, i, q = [], 0, 0
    for edit in audit:
        if edit == "I":
            out.append((expect[q], ""))
            q = to[q]
            continue
        if edit == "K":
            out.append((rows[i][2], rows[i][3]))
            q = 1 if rows[i][2][:1] == "s" else to[q]
        elif edit == "R":
            out.append((expect[q], rows[i][3]))
            q = to[q]
        i += 1
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return cost, audit, out


def report(rows):
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        mine = sorted(by[conv], key=place)
        faults, seen = [], set()
        for _, _, role, text in mine:
            last = [c for c in text if FULL.match(c)][-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        told = [t for _, t, _, _ in mine if t is not None]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        first = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        cost, audit, out = cheapest(mine, faults)
        text = "\n".join(f"{r}:{t}" for r, t in out)
        yield conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def told(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def drawn(seed, conversations, longest):
    draw = random.Random(seed)
    rows = []
    for c in conversations:
        for turn in range(draw.randint(0, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "Sys"])
            text = draw.choice(["Yes.", "No!", "", " \t", "a cut", "é?", None, f"turn {turn}.", f"turn {turn}"])
            rows.append((c, draw.choice([turn, turn, turn, turn + 7, None, 3]), role, text))
    return rows


def test_test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_turn_repair"](spark, FOLDER)
    assert told(got) == sorted(report(rows), key=repr) and got.count() == len({r[0] for r in rows})


@pytest.mark.parametrize("seed", range(3))
def test_odd_rows_and_ties(spark, seed):
    rows = drawn(seed, [None, *range(60)], 12)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit(1)).withColumn("seq", F.lit(2)).repartition(3)
    assert told(turns.repair_report(frame)) == sorted(report(rows), key=repr)


def test_one_conversation_in_all_partitions(spark):
    """Most rows are of one conversation and many are equal; both lie in several partitions."""
    rows = drawn(7, [1, 2, 5], 9) + [(3, t, ("user", "assistant", "system")[t % 7 % 3], ("Same.", f"text {t}.", "cut")[t * t % 5 % 3]) for t in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = turns.Repair(turns.damaged(frame), frame.select("conv_id"))
    assert len({part for part, conv in made.known if conv == 3}) > 2
    expected = sorted(report(rows), key=repr)
    assert told(made.digests()) == expected
    size = turns.PIECE_BYTES
    turns.PIECE_BYTES = 100
    try:
        assert told(made.digests()) == expected
    finally:
        turns.PIECE_BYTES = size
    repaired = made.turns().where("conv_id = 3").orderBy("part", "seq").collect()
    assert len(repaired) == sum(e != "D" for e in next(r[7] for r in expected if r[0] == 3))


def test_long_texts_and_empty_table(spark):
    long = "word. " * 400_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "end."), (1, 2, "assistant", long + "end."), (2, 0, "user", " " * 3_000_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert told(turns.repair_report(frame)) == sorted(report(rows), key=repr)
    assert turns.repair_report(frame.limit(0)).count() == 0
    kept = turns.Repair(frame).turns().orderBy("part", "seq").collect()
    assert [(r["role"], len(r["text"]), r["edit"]) for r in kept if r["conv_id"] == 1][0] == ("user", len(long), "K")
