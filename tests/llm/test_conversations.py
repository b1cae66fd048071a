"""Conversation repair against all edit scripts of least cost."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from attestry.llm import conversation_repair
from attestry.llm.conversation_repair import Division, START, step

WHITE = " \t\n\x0b\x0c\r"
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def scripts(rows):
    """(cost, audit, lines) of the audit-least of all cheapest scripts over rows (role, text, fault)."""
    best = {}

    def least(i, state):
        """Least cost from here to the end."""
        if (i, state) not in best:
            if i == len(rows):
                best[i, state] = {"": 0, "s": 6, "u": 3, "a": 0}[state]
            else:
                best[i, state] = min(cost + least(j, to) for cost, j, to, *_ in moves(i, state, 2))
        return best[i, state]

    def moves(i, state, inserts):
        role, text, fault = rows[i]
        for k in range(inserts + 1):
            if k:
                state = "a" if state == "u" else "u"
            yield 3 * k + 4, i + 1, state, "I" * k + "D", k, None
            if fault in ("blank", "duplicate"):
                continue
            late = 3 * (fault == "truncated")
            if role[:1] and role[:1] in AFTER[state]:
                yield 3 * k + late, i + 1, role[:1], "I" * k + "K", k, f"{role}:{text}"
            into = "a" if state == "u" else "u"
            yield 3 * k + 3 + late, i + 1, into, "I" * k + "R", k, {"u": "user", "a": "assistant"}[into] + f":{text}"

    name = {"u": "user:", "a": "assistant:"}

    def ways(i, state):
        if i == len(rows):
            tail = {"": "", "s": "ua", "u": "a", "a": ""}[state]
            yield "I" * len(tail), [name[c] for c in tail]
            return
        for cost, j, to, edits, k, line in moves(i, state, 2):
            if cost + least(j, to) == least(i, state):
                own, at = [], state
                for _ in range(k):
                    at = "a" if at == "u" else "u"
                    own.append(name[at])
                for audit, lines in ways(j, to):
                    yield edits + audit, own + ([line] if line is not None else []) + lines

    audit, lines = min(ways(0, ""), key=lambda x: x[0])
    return least(0, ""), audit, lines


def brute(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        say = lambda x: " " if x is None else str(x)
        role, text = say(role), say(text)
        fate = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        text = {1: "", 2: text.translate(dict.fromkeys(map(ord, ".!?")))}.get(fate, text)
        convs[conv] += [] if fate == 0 else [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}:{r[2]}"))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.rstrip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {t for t, *_ in rows if t is not None}
        initials = [r[1][:1] for r in rows]
        cost, audit, lines = scripts([(r[1], r[2], f) for r, f in zip(rows, faults)])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def made(n, seed):
    rnd = random.Random(seed)
    texts = ["Hi.", "Hello there!", "cut off", "Why?\n", "  \n", "", None, "same.", "same.", "x. y", "é!", "a. "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ufo"]
    table = []
    for conv in range(n):
        size = rnd.choice([1, 2, 3, 4, 5, 6, 7, 8])
        for turn in range(size):
            at = rnd.choice([turn, turn, turn, turn + 3, None])
            role = ("user", "assistant")[turn % 2] if rnd.random() < 0.6 else rnd.choice(roles)
            row = (None if conv == 5 else conv, at, role, rnd.choice(texts))
            table += [row] * rnd.choice([1, 1, 1, 1, 2, 3])
    return table


def spark_rows(spark, table):
    df = spark.createDataFrame([(*r, 1, 2) for r in table], "conv_id long, turn long, role string, text string, block long, `a.cost` long")
    rows = conversation_repair.repair(df).collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_repair(spark):
    table = made(150, 3)
    assert spark_rows(spark, table) == brute(table)


def test_long_conversations_in_blocks(spark, monkeypatch):
    """The same in blocks of three rows, with turns that go on over a border."""
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", 3)
    table = made(60, 4)
    assert spark_rows(spark, table) == brute(table)
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", 10_000)
    monkeypatch.setattr(conversation_repair, "BLOCK_CHARS", 1)
    assert spark_rows(spark, table) == brute(table)


@pytest.mark.parametrize("seed", range(30))
def test_division_of_many_rows(seed):
    """Borders of the division against a pass that keeps the least audit of every state as text."""
    rnd = random.Random(seed)
    kinds = [step(i, cut) for i in ("s", "u", "a", "") for cut in (False, True)]
    rows = [rnd.choice(kinds) for _ in range(rnd.randint(1, 200))]
    held = {START: (0, "")}
    for audits, (costs, _) in rows:
        found = {}
        for s, (cost, audit) in held.items():
            for t in range(4):
                if (s, t) in audits:
                    found[t] = min(found.get(t, (10**9,)), (cost + costs[s][t], audit + audits[s, t]))
        held = found
    ends = {0: 0, 1: 6, 2: 3, 3: 0}
    cost, audit, last = min((c + ends[s], a, s) for s, (c, a) in held.items())
    division, elements = Division(), [r[1] for r in rows]
    assert division.ending(elements) == (cost, last)
    states = division.borders(elements, START, last)
    assert "".join(r[0][s, t] for r, s, t in zip(rows, states, states[1:])) == audit
    cut = rnd.randrange(len(rows) + 1)
    parts = [division.table(elements[:cut]), division.table(elements[cut:])]
    assert division.borders(parts, START, last)[1] == states[cut] and division.ending(parts)[0] == cost


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.repair(spark.createDataFrame([], schema)).collect() == []
    conv = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = conversation_repair.repair(spark.createDataFrame([(conv, 0, "user", "Hi.")], schema)).collect()
    assert [tuple(r) for r in row] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_text_and_hot_conversation(spark):
    """One conversation that holds nearly all rows, most of them one and the same, and a text of two million characters."""
    table = [(1, i, ("user", "assistant")[i % 2], "again.") for i in range(3000)] + [(1, 9000, "user", "long " * 400_000 + ".")] + [(2, 0, "user", "a?")]
    got = spark_rows(spark, table)
    assert set(got) == {1, 2} and len(got[1][6]) >= got[1][2] > 2000 and got[1][5] >= 4 * got[1][2]
