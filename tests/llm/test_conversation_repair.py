"""Repairs against a plain search over all edits, and the whole report against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barometry.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACE = " \t\n\x0b\x0c\r"


def plain_edits(initials, faults):
    """Least (cost, letters) by the letters so far, state by state; inserts at most twice in a row."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(ways):
        for _ in range(2):
            more = dict(ways)
            for last, (cost, letters) in ways.items():
                to = step[last]
                more[to] = min(more.get(to, (10**9, "")), (cost + 5, letters + "I"))
            ways = more
        return ways

    ways = inserted({"": (0, "")})
    for initial, fault in zip(initials, faults, strict=True):
        after = {}

        def way(last, cost, letters, after=after):
            after[last] = min(after.get(last, (10**9, "")), (cost, letters))

        for last, (cost, letters) in ways.items():
            way(last, cost + 2, letters + "D")
            if fault in (FINE, TRUNCATED):
                more = 5 if fault == TRUNCATED else 0
                if initial == step[last] or (initial == "s" and last == ""):
                    way(initial, cost + more, letters + "K")
                way(step[last], cost + more + 1, letters + "R")
        ways = inserted(after)
    return min(ways[last] for last in ("", "a") if last in ways)


def tiny_edits(initials, faults):
    """Every string of up to six letters tried out."""
    best = None
    for size in range(7):
        for letters in itertools.product("DIKR", repeat=size):
            if sum(x != "I" for x in letters) != len(initials):
                continue
            for choice in itertools.product("ua", repeat=sum(x in "IR" for x in letters)):
                roles, cost, rows, chosen = "", 0, iter(zip(initials, faults, strict=True)), iter(choice)
                for x in letters:
                    if x == "I":
                        roles, cost = roles + next(chosen), cost + 5
                        continue
                    initial, fault = next(rows)
                    if x == "D":
                        cost += 2
                        continue
                    cost += (1 if x == "R" else 0) + (5 if fault == TRUNCATED else 0) + (10**6 if fault in (BLANK, DUPLICATE) else 0)
                    roles += next(chosen) if x == "R" else initial or "?"
                if re.fullmatch("(s?(ua)+)?", roles) and cost < 10**6 and (best is None or (cost, "".join(letters)) < best):
                    best = cost, "".join(letters)
    return best


def plain_report(rows):
    """Report of every conversation of the undamaged ``rows``."""
    found = {}
    for conv_id, turn, role, text in rows:
        kept = found.setdefault(conv_id, [])
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        lot = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 0:
            continue
        if lot == 4:
            role = "user"
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        code = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        kept += [(turn is not None, turn or 0, code, role, text)] * (2 if lot == 3 else 1)
    out = []
    for conv_id, kept in found.items():
        kept.sort()
        numbers = [x[1] for x in kept if x[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults, seen = [], set()
        for *_, role, text in kept:
            bare = text.rstrip(SPACE)
            faults.append(BLANK if not bare else DUPLICATE if (role, text) in seen else TRUNCATED if bare[-1] not in ".!?" else FINE)
            seen.add((role, text))
        initials = [x[3][:1] for x in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = plain_edits(initials, faults)
        turns, rest, roles = [], iter(kept), ""
        for x in audit:
            row = next(rest) if x != "I" else None
            if x != "D":
                fit = "assistant" if roles[-1:] == "u" else "user"
                role = row[3] if x == "K" else fit
                roles += role[:1]
                turns.append(f"{role}:{row[4] if row else ''}")
        assert re.fullmatch("(s?(ua)+)?", roles)
        digest = hashlib.sha256("\n".join(turns).encode()).hexdigest()
        out.append((conv_id, gaps, *(faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, digest))
    return sorted(out, key=str)


def test_small_conversations_against_all_strings_of_letters():
    random.seed(5)
    for _ in range(40):
        n = random.randint(0, 3)
        initials = [random.choice(["s", "u", "a", "t", ""]) for _ in range(n)]
        faults = [random.choice([FINE, FINE, BLANK, DUPLICATE, TRUNCATED]) for _ in range(n)]
        assert repair.cheapest_edits(initials, faults) == plain_edits(initials, faults) == tiny_edits(initials, faults)


@pytest.mark.parametrize("n", [1, 5, 30, 400])
def test_against_a_plain_search(n):
    random.seed(n)
    for _ in range(2000 // n):
        initials = [random.choice("suaaauut") for _ in range(n)]
        faults = [random.choice([FINE, FINE, FINE, BLANK, DUPLICATE, TRUNCATED]) for _ in range(n)]
        assert repair.cheapest_edits(initials, faults) == plain_edits(initials, faults)


def made_up():
    random.seed(3)
    rows = []
    for c in range(300):
        for t in range(random.choice([1, 2, 3, 8, 60])):
            role = random.choice(["system", None, "tool", ""]) if random.random() < 0.1 else ("user", "assistant")[t % 2]
            text = random.choice([None, "", " \t", "a b.", "a b. \n", "no end", "ä!", "x?", f"text {t}.", "字"])
            rows.append((c, t if random.random() < 0.95 else None, role, text))
    return [*rows, (None, None, None, None), (None, 1, "user", "q?"), (2**62, 2**62, "user", "q."), (7, 3, "user", "a."), (7, 3, "user", "a.")]


def test_report_equals_plain_python(spark):
    rows = made_up()
    report = repair.repair_report(repair.damage(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert sorted((tuple(row) for row in report.collect()), key=str) == plain_report(rows)


def test_repaired_turns_have_the_reported_hash(spark):
    damaged = repair.damage(spark.createDataFrame(made_up(), SCHEMA))
    texts = {}
    for conv_id, position, role, text in repair.repaired_turns(damaged).collect():
        texts.setdefault(conv_id, {})[position] = f"{role}:{text}"
    for row in repair.repair_report(damaged).collect():
        turns = texts.get(row.conv_id, {})
        joined = "\n".join(turns[i] for i in range(len(turns)))
        assert row.repaired_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_conversation_of_which_nothing_is_left(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = repair.repair_report(repair.damage(spark.createDataFrame([(c, 0, "user", "x")], SCHEMA))).collect()
    assert [tuple(row) for row in rows] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table_and_clashing_names(spark):
    assert repair.repair_report(repair.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    names = ["gone", "copy", "code", "is_row", "audit", "fault", "cost", "initial"]
    rows = spark.createDataFrame([(1, 0, "user", "x.")], SCHEMA)
    wide = rows.withColumns({name: F.lit("y") for name in names})
    assert repair.repair_report(repair.damage(wide)).collect() == repair.repair_report(repair.damage(rows)).collect()
