"""Conversation repair against a search through all edits, and on rows that are odd."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from slicework.llm import repair

FULL = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def blank(text):
    return not re.search(r"[^\x20\x09-\x0D]", text)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_cost(rows, faults):
    """Uniform-cost search over (rows used, roles so far by their last state), ordered by cost and then by audit."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, best = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines[1:]
        if (i, last) in best:
            continue
        best.add((i, last))
        for r in step[last]:
            if r != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", i, r, lines + "\n" + {"u": "user", "a": "assistant"}[r] + ":"))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
            if faults[i] not in "bd":
                more = 3 * (faults[i] == "t")
                if role[:1] in step[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], f"{lines}\n{role}:{text}"))
                for r in step[last]:
                    if r != "s":
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, r, lines + "\n" + {"u": "user", "a": "assistant"}[r] + ":" + text))


def plain_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = "", set()
        for _, _, role, text in own:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults += "b" if blank(text) else "d" if (role, text) in seen else "o" if last in ".!?" else "t"
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = plain_cost([r[2:] for r in own], faults)
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def made(n, seed=5):
    draw, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "USER"])
            rows.append((conv, draw.choice([turn, turn, turn + 3]) if draw.random() < 0.95 else None, role, draw.choice(["Yes.", "No!", "and so", "", " \t", None, "a.\n", f"text {turn}."])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_grammar_equals_search():
    draw = random.Random(2)
    strings = ["".join(draw.choice("uasxUASYX" + "ua" * 4) for _ in range(draw.randint(0, 9))) for _ in range(1500)]
    rules, text = [], list(strings)
    for k in range(6):
        counts = sum((repair.pairs_of(s) for s in text), repair.Counter())
        for pair in repair.choose(list(counts.items()), 8):
            rules.append((pair, chr(0x10000 + len(rules))))
            text = [s.replace(*rules[-1]) for s in text]
    grammar, bare = repair.Grammar(rules), repair.Grammar([])
    assert len(rules) > 20
    for s in strings:
        rows = [({"X": "user", "u": "user", "a": "assistant", "s": "system", "x": "tool", "y": "tool"}[c if c == "X" else c.lower()], "t") for c in s]
        want = plain_cost(rows, "".join("b" if c == "X" else "t" if c.isupper() else "o" for c in s))
        assert grammar.solve(s) == bare.solve(s) == want[:2], s
        assert FULL.fullmatch("".join(line[0] for line in repair.edited(want[1], rows, 0)[0]))


def test_repair_equals_plain(spark):
    rows = made(300) + made(4, 9) + [(None, 1, "user", "Hm."), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as ck", "2 as pid", "'x' as audit")
    assert found(repair.op11_grammar_repair(df)) == plain_repair(rows)
    assert found(repair.op11_grammar_repair(df.repartition(7))) == plain_repair(rows)
    assert repair.op11_grammar_repair(df.limit(0)).collect() == []


def test_pieces(spark, monkeypatch):
    """A long conversation in pieces over many tasks, with repeats across pieces."""
    draw = random.Random(3)
    rows = [(1, t // 2, draw.choice(["user", "assistant", "tool"]), draw.choice(["Yes.", "and so", f"text {t}.", f"text {t} cut"])) for t in range(700)] + made(20)
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.conv_id: r for r in repair.repair_conversations(repair.damage(df)).collect()}
    got = found(repair.op11_grammar_repair(df))
    want = plain_repair(rows)
    assert got == want
    assert {k: hashlib.sha256(r.repaired.encode()).hexdigest() for k, r in out.items()} == {k: v[-1] for k, v in want.items() if v[-1] != EMPTY or k in out}


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert found(repair.op11_grammar_repair(df)) == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
