"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("netloom.llm")

from netloom.llm import repair  # noqa: E402

RNG = random.Random(11)
INF = 10**9


def best(rows):
    """The least (cost, audit, repaired) by a plain dynamic program over places and target states; rows are (role, text, fault)."""
    n = len(rows)
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    at = {}
    for i in range(n, -1, -1):
        for _ in range(4):
            for q in after:
                options = [(0, "", ())] if i == n and q in ("", "a") else []
                for role in after[q]:
                    if role != "s" and (i, role) in at:
                        c, a, out = at[i, role]
                        options.append((c + 2, "I" + a, ({"u": "user:", "a": "assistant:"}[role], *out)))
                    if i < n and rows[i][2] in ("", "truncated"):
                        c, a, out = at[i + 1, role]
                        more = rows[i][2] == "truncated"
                        if rows[i][0][:1] == role:
                            options.append((c + more, "K" + a, (f"{rows[i][0]}:{rows[i][1]}", *out)))
                        if role != "s":
                            options.append((c + more + 2, "R" + a, ({"u": "user", "a": "assistant"}[role] + ":" + rows[i][1], *out)))
                if i < n:
                    c, a, out = at[i + 1, q]
                    options.append((c + 3, "D" + a, out))
                options += [at[i, q]] if (i, q) in at else []
                if options:
                    at[i, q] = min(options, key=lambda x: x[:2])
    return at[0, ""]


def expected(data):
    out = {}
    for conv in {r[0] for r in data}:
        rows = []
        for c, turn, role, text in data:
            if c != conv:
                continue
            text, role = " " if text is None else text, " " if role is None else role
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if h == 1:
                text = ""
            if h == 2:
                text = re.sub("[.!?]", "", text)
            if h == 4:
                role = "user"
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, said = best([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def rows_of(conv, n):
    said = ["Yes.", "No!", "why", "Hm?", " ", "", None, "a\nb. ", "long " * 40 + ".", "é?\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"]
    return [(conv, RNG.choice([None, k, k, k, k + RNG.randrange(3)]), RNG.choice(roles), RNG.choice(said)) for k in range(n)]


DATA = [r for conv in range(120) for r in rows_of(conv, conv % 13)] + rows_of(None, 6) + [(500, 3, "user", "Hi."), (500, 3, "user", "Hi."), (500, 3, "user", "Hi."), (501, None, None, None)] + [(600, k, ["user", "assistant"][k % 2], f"{k}.") for k in range(3000)] + [(601, k, "user", "x" * 2_000_000 + ".") for k in range(2)]


def test_against_all_edits(spark):
    table = spark.createDataFrame(DATA, "conv_id long, turn long, role string, text string").withColumn("place", repair.F.lit("clash")).repartition(5)
    turns = repair.damaged(table)
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(turns, turns["copies"]).summary().collect()}
    assert found == expected(DATA)


def test_repaired_turns(spark):
    data = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", "")]
    done = repair.repair(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    said = [(r["role"], r["text"]) for r in done.turns().orderBy("place", "step").collect()]
    assert said == [("system", "Be kind."), ("user", ""), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "")]
    assert done.summary().first()["audit"] == "KIKKDI"


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damaged(none)).summary().count() == 0


def test_states_are_few():
    automaton = repair.Automaton()
    for _ in range(300):
        automaton.repair([RNG.randrange(16) for _ in range(50)])
    assert len(automaton.vectors) < 100
