"""Repair of conversation structure: cheapest edits to role sequences by a dynamic programme over a grammar.

A row becomes one symbol, of its role's initial and its fault; a conversation becomes a string of symbols. Re-Pair
replaces the most frequent pairs of symbols of all conversations by new symbols, round by round, counted in Spark. Each
symbol has a min-plus matrix over the states of ``(s?(ua)+)?``: the least cost from state to state and the
least audit of that cost, as a rope. The matrix of a rule is the product of those of its two parts, so it is worked
out once, bottom-up, for all conversations that share it.

Rows are dealt out by ranges of (conversation, turn), so a conversation of any length lies in many tasks. What
lies whole in a piece of ``CHUNK_ROWS`` rows is repaired in its place; of longer ones only symbols and audits are
brought together, and texts are digested in order, piece by piece.

Nulls are one blank. A blank text is a fault as is an empty one. Rows of one turn are ordered by role and text; equal
rows are duplicates but for the first. Null conversation ids are one conversation. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicework.llm.shared import materialize

#: Rows and characters of a piece of a conversation.
CHUNK_ROWS, CHUNK_CHARS = 256, 4 << 20
#: Bounds of the grammar; symbols that no rule covers are multiplied one by one, with equal results.
MOST_RULES, MOST_ROUNDS = 2048, 16
#: Pairs of a round are at least so frequent, as a share of the most frequent one.
LEAST_OF_TOP = 1 / 8
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a; what a role's initial leads to.
STATES, ENDS = range(4), (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Symbols: forced deletion; a role's initial, or x for any other, in capitals if the text is truncated.
FORCED, PLAIN = "X", "uasx"
ROLE = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"


class Rope:
    """Two audits one after the other, joined to a string only when it is asked for."""

    __slots__ = ("left", "right", "flat")

    def __init__(self, left, right):
        self.left, self.right, self.flat = left, right, None

    def __str__(self) -> str:
        if self.flat is None:
            out, todo = [], [self.right, self.left]
            while todo:
                x = todo.pop()
                if isinstance(x, str) or x.flat is not None:
                    out.append(x if isinstance(x, str) else x.flat)
                else:
                    todo += [x.right, x.left]
            self.flat = "".join(out)
        return self.flat


def _least(options: list):
    """The least cost and of its audits the least; None without options."""
    if not options:
        return None
    low = min(cost for cost, _ in options)
    ties = [audit for cost, audit in options if cost == low]
    return low, ties[0] if len(ties) == 1 else min(ties, key=str)


def inserts() -> dict[tuple[int, int], tuple[int, str]]:
    """From state to state by insertions alone, two at most: more would go in a circle."""
    out = {(p, p): (0, "") for p in STATES}
    for p in STATES:
        at, cost, audit = p, 0, ""
        for _ in range(2):
            at, cost, audit = STEP[at, "a" if at == 2 else "u"], cost + INSERT, audit + "I"
            out.setdefault((p, at), (cost, audit))
    return out


INSERTED = inserts()


def row_matrix(symbol: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Insertions and then the edit of one row. A matrix ends in a row's edit, so none of two audits of equal cost
    begins the other, and the least of a product is a product of least ones."""
    edits: dict[tuple[int, int], list] = {(p, p): [(DELETE, "D")] for p in STATES}
    if symbol != FORCED:
        more = TRUNCATED if symbol.isupper() else 0
        initial = {"Y": "x"}.get(symbol, symbol.lower())
        for p in STATES:
            edits.setdefault((p, STEP[p, "a" if p == 2 else "u"]), []).append((REROLE + more, "R"))
            if (p, initial) in STEP:
                edits.setdefault((p, STEP[p, initial]), []).append((more, "K"))
    return multiply(INSERTED, {k: _least(v) for k, v in edits.items()})


def multiply(a: dict, b: dict) -> dict:
    """Min-plus product of two matrices, with audits."""
    options: dict[tuple[int, int], list] = {}
    for (i, k), (cost, audit) in a.items():
        for j in STATES:
            if (k, j) in b:
                more, rest = b[k, j]
                options.setdefault((i, j), []).append((cost + more, Rope(audit, rest)))
    return {k: _least(v) for k, v in options.items()}


class Grammar:
    """Rules in the order in which they apply, and the matrices of all symbols."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules, self.known = rules, {}
        self.matrix = {s: row_matrix(s) for s in (FORCED, *PLAIN, *"UASY")}
        for pair, symbol in rules:
            self.matrix[symbol] = multiply(self.matrix[pair[0]], self.matrix[pair[1]])

    def compress(self, symbols: str) -> str:
        for pair, symbol in self.rules:
            symbols = symbols.replace(pair, symbol)
        return symbols

    def solve(self, symbols: str) -> tuple[int, str]:
        """Cost and audit of the cheapest edits; kept for strings that come again."""
        if (found := self.known.get(symbols)) is None:
            best = {p: _least([INSERTED[p, q] for q in ENDS if (p, q) in INSERTED]) for p in STATES}
            for symbol in reversed(self.compress(symbols)):
                options: dict[int, list] = {}
                for (p, q), (cost, audit) in self.matrix[symbol].items():
                    options.setdefault(p, []).append((cost + best[q][0], Rope(audit, best[q][1])))
                best = {p: _least(v) for p, v in options.items()}
            found = best[0][0], str(best[0][1])
            if len(symbols) <= CHUNK_ROWS and len(self.known) < 1 << 16:
                self.known[symbols] = found
        return found


def pairs_of(symbols: str) -> Counter:
    """Adjacent pairs, those of two like symbols without overlaps."""
    out, before = Counter(), -1
    for i in range(len(symbols) - 1):
        if symbols[i] == symbols[i + 1] and before == i - 1:
            before = -1
            continue
        before = i if symbols[i] == symbols[i + 1] else -1
        out[symbols[i : i + 2]] += 1
    return out


def choose(counts: list[tuple[str, int]], most: int) -> list[str]:
    """The most frequent pairs that can't overlap one another, so that their counts hold whichever is replaced first."""
    out, lefts, rights = [], set(), set()
    for pair, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        if len(out) == most or n < LEAST_OF_TOP * max(counts, key=lambda x: x[1])[1]:
            break
        a, b = pair
        if a not in rights and b not in lefts and (a != b or (a not in lefts and b not in rights)):
            out.append(pair)
            lefts.add(a)
            rights.add(b)
    return out


def fit_grammar(sequences: DataFrame, most_rules: int = MOST_RULES, most_rounds: int = MOST_ROUNDS) -> Grammar:
    """Re-Pair over ``sequences`` (``symbols``, ``n``: how often). Counts cover all rows; what comes to the driver is
    one row for each pair of symbols, of which there are fewer than (9 + most_rules)^2 / 2."""
    rules: list[tuple[str, str]] = []
    for _ in range(most_rounds):
        if len(rules) == most_rules:
            break

        def count(batches: Iterator[pa.RecordBatch], rules=tuple(rules)) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                    for pair, symbol in rules:
                        symbols = symbols.replace(pair, symbol)
                    for pair, k in pairs_of(symbols).items():
                        total[pair] += k * n
            yield pa.RecordBatch.from_pydict({"pair": list(total), "n": list(total.values())}, pa.schema([("pair", pa.string()), ("n", pa.int64())]))

        counts = sequences.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").collect()
        chosen = choose([(r.pair, r.n) for r in counts], most_rules - len(rules)) if counts else []
        if not chosen:
            break
        rules += [(pair, chr(0x10000 + len(rules) + i)) for i, pair in enumerate(chosen)]
    return Grammar(rules)


def symbol_of(initial: str, fault: str) -> str:
    if fault in "bd":
        return FORCED
    s = initial if initial and initial in "uas" else "x"
    return s if fault == "o" else {"x": "Y"}.get(s, s.upper())


def fault_of(text: str) -> str:
    """b: blank, t: truncated, o: neither."""
    text = text.rstrip(SPACES)
    return "b" if not text else "o" if text[-1] in ".!?" else "t"


def edited(audit: str, rows: list[tuple[str, str]], state: int) -> tuple[list[str], int]:
    """The lines that an audit makes of rows (role, text), and the state after them."""
    out, at = [], iter(rows)
    for edit in audit:
        role, text = next(at) if edit != "I" else ("", "")
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else "a" if state == 2 else "u"
        state = STEP[state, initial]
        out.append(f"{role if edit == 'K' else ROLE[initial]}:{text}")
    return out, state


CHUNK = "ck string, pid int, no int, open boolean, symbols string, gaps long, blank long, duplicate long, truncated long, illegal long, turns array<long>, faults string, keys array<binary>, roles array<string>, texts array<string>"
ARROW = pa.schema([
    ("ck", pa.string()), ("pid", pa.int32()), ("no", pa.int32()), ("open", pa.bool_()), ("symbols", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")),
    ("turns", pa.list_(pa.int64())), ("faults", pa.string()), ("keys", pa.list_(pa.binary())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])


def totals(turns: list, faults: str, roles: list[str]) -> dict[str, int]:
    """Gaps and faults of a whole conversation; of a piece, the last turn before may stand first in ``turns``."""
    seen = {t for t in turns if t is not None}
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return {"gaps": max(seen) - min(seen) + 1 - len(seen) if seen else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": illegal}


def _key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows as pieces. A conversation that is one piece, and neither the first nor the last of its task, is
    whole, so its symbols are known here; the others are open."""
    pid, no, out, size = TaskContext.get().partitionId(), 0, [], 0
    ck, rows, chars, first, whole = None, [], 0, True, True

    def close(last: bool) -> dict:
        nonlocal no
        roles, texts = [r for _, r, _ in rows], [t for _, _, t in rows]
        row = {"ck": ck, "pid": pid, "no": no, "open": not whole or last, "turns": [t for t, _, _ in rows], "roles": roles, "texts": texts, "keys": [_key(r, t) for r, t in zip(roles, texts)], "faults": "".join(map(fault_of, texts))}
        no += 1
        seen, faults = set(), ""
        for key, fault in zip(row["keys"], row["faults"]):
            faults += "d" if fault != "b" and key in seen else fault
            seen.add(key)
        row["symbols"] = "".join(symbol_of(r[:1], f) for r, f in zip(roles, faults))
        if not row["open"]:
            row |= totals(row["turns"], faults, roles) | {"faults": None, "keys": None, "turns": None}
        return row

    for batch in batches:
        for c, turn, role, text in zip(*(batch.column(k).to_pylist() for k in ("ck", "turn", "role", "text"))):
            if c != ck or len(rows) == CHUNK_ROWS or chars > CHUNK_CHARS:
                if rows:
                    whole = whole and c != ck
                    out.append(close(False))
                    size += chars
                    first = first and c == ck
                whole, rows, chars = c != ck and not first, [], 0
                ck = c
            rows.append((turn, role, text))
            chars += len(text)
            if size > CHUNK_CHARS or len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, ARROW)
                out, size = [], 0
    if rows:
        out.append(close(True))
    if out:
        yield pa.RecordBatch.from_pylist(out, ARROW)


def _open_totals(pieces: list[dict], grammar: Grammar) -> tuple[dict, list[dict]]:
    """Totals, cost and audit of one conversation from its pieces in order, and the audit and state of each piece."""
    low = high = None
    distinct = 0
    for p in pieces:
        if p["low"] is not None:
            distinct += p["distinct"] - (high == p["low"])
            low, high = p["low"] if low is None else low, p["high"]
    out = {"gaps": high - low + 1 - distinct if low is not None else 0}
    out |= {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(pieces, pieces[1:]))
    symbols = "".join(p["symbols"] for p in pieces)
    out["cost"], out["audit"] = grammar.solve(symbols)
    parts, at, state = [], 0, 0
    for i, p in enumerate(pieces):
        begin, left = at, len(p["symbols"])
        while left:
            left -= out["audit"][at] != "I"
            at += 1
        at = len(out["audit"]) if i == len(pieces) - 1 else at
        part = out["audit"][begin:at]
        parts.append({"pid": p["pid"], "no": p["no"], "part": part, "state": state})
        # the state after a piece follows from the initials alone
        state = edited(part, [(x, "") for x in p["initials"]], state)[1]
    return out, parts


def _solved_open(opened: DataFrame, grammar) -> DataFrame:
    """Of conversations in several pieces: duplicates across pieces, then one row for each piece with its part of the audit."""
    kind = "ck string, pid int, no int, part string, state int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    place = F.struct("pid", "no", "at").alias("place")
    keys = opened.select("ck", "pid", "no", F.posexplode("keys").alias("at", "key")).select("ck", "key", place)
    first = keys.groupBy("ck", "key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("ck", "key", "first")
    again = keys.join(first, ["ck", "key"]).where("place > first").groupBy("ck", "place.pid", "place.no").agg(F.collect_list("place.at").alias("again"))
    ends = opened.select("ck", "pid", "no", "faults", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"), F.array_min("turns").alias("low"), F.array_max("turns").alias("high"), F.size(F.array_distinct(F.array_compact("turns"))).alias("distinct"))
    slim = ends.join(again, ["ck", "pid", "no"], "left")

    def solve(key, pdf):
        import pandas as pd

        pieces = []
        for p in pdf.sort_values(["pid", "no"]).to_dict("records"):
            dup = set(p["again"] if p["again"] is not None else ())
            faults = "".join("d" if i in dup and f != "b" else f for i, f in enumerate(p["faults"]))
            initials = list(p["initials"])
            known = p["low"] is not None and p["low"] == p["low"]
            low, high = (int(p["low"]), int(p["high"])) if known else (None, None)
            pieces.append(totals([], faults, initials) | {"pid": p["pid"], "no": p["no"], "low": low, "high": high, "distinct": p["distinct"], "initials": initials, "first": initials[0], "last": initials[-1], "symbols": "".join(map(symbol_of, initials, faults))})
        out, parts = _open_totals(pieces, grammar.value)
        empty = {"gaps": None, "audit": None} | {c: None for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
        rows = [{"ck": key[0]} | part | (out if i == 0 else empty) for i, part in enumerate(parts)]
        return pd.DataFrame(rows).astype({c: "Int64" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")})

    return slim.groupBy("ck").applyInPandas(solve, kind)


def repair_conversations(rows: DataFrame, texts: bool = True) -> DataFrame:
    """Of rows (``conv_id``, ``turn``, ``role``, ``text``): each conversation's gaps, faults, cost and audit of its cheapest
    edits, and what they make of it: ``repaired`` as text, or with ``texts=False`` its SHA-256, for which conversations
    of many pieces are digested as a stream.
    """
    keyed = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("ck"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    order = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # the last key parts equal rows, which are interchangeable
    dealt = keyed.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("any")).sortWithinPartitions(*order)
    chunks = materialize(dealt.mapInArrow(_chunks, CHUNK), "conversation-pieces")
    closed, opened = chunks.where("not open"), chunks.where("open")
    sequences = materialize(chunks.groupBy("symbols").agg(F.count("*").alias("n")), "conversation-symbols")
    grammar = rows.sparkSession.sparkContext.broadcast(fit_grammar(sequences))
    out = "repaired" if texts else "repaired_sha256"
    finish = (lambda lines: lines) if texts else (lambda lines: hashlib.sha256(lines.encode()).hexdigest())
    kept = ["ck", "gaps", "blank", "duplicate", "truncated", "illegal"]
    kind = "ck string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, " + out + " string"

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = [grammar.value.solve(s) for s in batch.column("symbols").to_pylist()]
            lines = [finish("\n".join(edited(audit, list(zip(r, t)), 0)[0])) for (_, audit), r, t in zip(solved, batch.column("roles").to_pylist(), batch.column("texts").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string()), pa.array(lines, pa.string())], [*kept, "cost", "audit", out])

    done = closed.select(*kept, "symbols", "roles", "texts").mapInArrow(repair, kind)
    parts = materialize(_solved_open(opened, grammar), "conversation-audits")
    joined = opened.select("ck", "pid", "no", "roles", "texts").join(parts.select("ck", "pid", "no", "part", "state"), ["ck", "pid", "no"])

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = ["\n".join(edited(part, list(zip(r, t)), state)[0]) if part.strip("D") else None for part, state, r, t in zip(*(batch.column(c).to_pylist() for c in ("part", "state", "roles", "texts")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ck", "pid", "no")), pa.array(got, pa.string())], ["ck", "pid", "no", "lines"])

    lines = joined.mapInArrow(lines_of, "ck string, pid int, no int, lines string").where("lines is not null")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ck, state = None, None
        for batch in batches:
            for c, text in zip(batch.column("ck").to_pylist(), batch.column("lines").to_pylist()):
                if c != ck:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"ck": [ck], out: [state.hexdigest()]})
                    ck, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.encode())
        if state is not None:
            yield pa.RecordBatch.from_pydict({"ck": [ck], out: [state.hexdigest()]})

    if texts:
        whole = lines.groupBy("ck").agg(F.sort_array(F.collect_list(F.struct("pid", "no", "lines"))).alias("all")).select("ck", F.array_join("all.lines", "\n").alias(out))
    else:
        whole = lines.repartition("ck").sortWithinPartitions("ck", "pid", "no").mapInArrow(stream, f"ck string, {out} string")
    nothing = "" if texts else hashlib.sha256(b"").hexdigest()
    long = parts.where("cost is not null").drop("pid", "no", "part", "state").join(whole, "ck", "left").fillna(nothing, out)
    ids = F.when(F.col("ck") != "", F.expr("substring(ck, 2)")).cast(rows.schema["conv_id"].dataType)
    return done.unionByName(long).select(ids.alias("conv_id"), *kept[1:], "cost", "audit", out)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the query puts in, by the checksum of ``conv_id:turn``; nulls are one blank."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op11_grammar_repair(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table after ``damage``: faults, cheapest edits and the digest of what they give.

    A conversation without rows after the damage has zeros, an empty audit and the digest of the empty string.
    """
    done = repair_conversations(damage(conversations), texts=False)
    ids = conversations.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.join(done, ids.conv_id.eqNullSafe(done.conv_id), "left").select(ids.conv_id, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
