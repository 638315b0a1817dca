"""Repair of conversations against all edits of short ones, and against a row-by-row program for long ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shelfwise.llm import repair
from shelfwise.llm.common import numbered, tuned
from shelfwise.session import materialized

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos long, kind string, audit string"


def all_edits(rows):
    """Least (cost, audit) over every choice of edits with at most two insertions in a place."""
    choices = []
    for initial, must_go, truncated in rows:
        left = 5 if truncated else 0
        kept = [] if must_go else [("K", initial, left), ("R", "u", 1 + left), ("R", "a", 1 + left)]
        choices.append([("D", "", 2), *kept])
    gaps = [("", "", 0), ("I", "u", 5), ("I", "a", 5), ("II", "ua", 10), ("II", "au", 10)]
    best = None
    for edits in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            parts = [inserted[0], *(x for pair in zip(edits, inserted[1:]) for x in pair)]
            if re.fullmatch("(s?(ua)+)?", "".join(p[1] for p in parts)):
                entry = sum(p[2] for p in parts), "".join(p[0] for p in parts)
                best = entry if best is None else min(best, entry)
    return best


def row_by_row(rows):
    """The same by a program over states."""
    moves = {"s": [("0", "s")], "u": [("0", "u"), ("s", "u"), ("a", "u")], "a": [("u", "a")]}

    def inserted(states):
        while True:
            more = dict(states)
            for turn in "ua":
                for p, q in moves[turn]:
                    if p in states:
                        entry = states[p][0] + 5, states[p][1] + "I"
                        more[q] = min(more.get(q, entry), entry)
            if more == states:
                return states
            states = more

    states = inserted({"0": (0, "")})
    for initial, must_go, truncated in rows:
        new: dict = {}
        left = 5 if truncated else 0
        for p, (cost, audit) in states.items():
            steps = [(p, 2, "D")]
            if not must_go:
                steps += [(q, left, "K") for a, q in moves.get(initial, []) if a == p]
                steps += [(q, 1 + left, "R") for turn in "ua" for a, q in moves[turn] if a == p]
            for q, more, edit in steps:
                entry = cost + more, audit + edit
                new[q] = min(new.get(q, entry), entry)
        states = inserted(new)
    return min(states[q] for q in ("0", "a") if q in states)


def random_rows(rng, n):
    return [(rng.choice("ssuuuaaat "), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def test_short_conversations_against_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(1, 3))
        assert repair.best(repair.parse([repair.cell_of(*r) for r in rows])) == all_edits(rows) == row_by_row(rows)


@pytest.mark.parametrize("size", [2, 3, 8])
def test_blocks_of_blocks(size):
    rng = random.Random(size)
    for n in (1, size, size + 1, 30, 61):
        rows = random_rows(rng, n)
        cells = [repair.cell_of(*r) for r in rows]
        while len(cells) > 1:
            cells = [repair.parse(cells[i : i + size]) for i in range(0, len(cells), size)]
        assert repair.best(cells[0]) == row_by_row(rows)


def expected(rows):
    """Every conversation by the rule, in plain Python."""
    convs: dict = {}
    for conv, turn, role, text, *_ in rows:
        kept = convs.setdefault(conv, [])
        blank = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, counts = set(), [], dict.fromkeys(repair.FAULTS, 0)
        for _, role, text in kept:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in {"su", "ua", "au"} for a, b in zip(judged, judged[1:]))
        cost, audit = row_by_row(judged) if judged else (0, "")
        said, left, turn = [], iter(kept), 0
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (None, "", "")
            if edit == "D":
                continue
            if edit != "K":
                role = ["user", "assistant"][turn % 2]
            said.append(f"{role}:{text}")
            turn += not role.startswith("s")
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def odd_rows():
    rng = random.Random(2)
    rows = []
    texts = ["Yes.", "No", "", " \t", "Why? ", "Because.", "é漢!", None, "x" * 20_000 + "."]
    for conv in range(120):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}."))
    rows += [(None, t, "user", "Hello.") for t in range(5)] + [rows[3], rows[3]]
    rows += [(1000, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(400)]
    return [(*r, "x", 1, "y", "z") for r in rows]


@pytest.mark.parametrize("size", [3, repair.BLOCK])
def test_odd_conversations(spark, size):
    rows = odd_rows()
    df = tuned(spark).createDataFrame(rows, SCHEMA).repartition(5)
    got = repair.repair_damaged(materialized(df, "conversations"), size).collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(found) == len(got)
    assert found == expected(rows)


def test_no_conversations(spark):
    assert repair.repair_damaged(tuned(spark).createDataFrame([], SCHEMA)).collect() == []


def test_numbered(spark):
    """Places are gapless, in order, in groups larger than a range and in those that are equal rows only."""
    rng = random.Random(1)
    rows = [("a", rng.randint(0, 50)) for _ in range(3000)] + [("b", 7)] * 2000 + [(f"c{i}", i) for i in range(500)]
    df = materialized(spark.createDataFrame(rows, "g string, v long").repartition(7), "rows")
    placed, sizes = numbered(df, "g", ["v"])
    groups: dict = {}
    for r in placed.collect():
        groups.setdefault(r["g"], []).append((r["pos"], r["v"]))
    for values in groups.values():
        values.sort()
        assert [p for p, _ in values] == list(range(len(values)))
        assert [v for _, v in values] == sorted(v for _, v in values)
    assert {r["g"]: r["n"] for r in sizes.collect()} == {g: len(v) for g, v in groups.items()}
