import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from tickloom.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    """Cheapest audit by trying, per turn and state, all edits, with whole audits compared."""
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                to = repair.NEXT[s]
                best[to] = min(best.get(to, (1 << 60, "")), (c + 5, a + "I"))
        return best

    best = inserted(best)
    for t in turns:
        fault, r = divmod(int(t), 4)
        new = {}
        for s, (c, a) in best.items():
            ways = [(2, "D", s)]
            if fault not in (1, 2):
                x = 5 if fault == 3 else 0
                ways.append((1 + x, "R", repair.NEXT[s]))
                if (s, r) in {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}:
                    ways.append((x, "K", r))
            for d, e, to in ways:
                new[to] = min(new.get(to, (1 << 60, "")), (c + d, a + e))
        best = inserted(new)
    return min(best[s] for s in (0, 3) if s in best)


def conversation(rows):
    """The contract in plain Python for the (turn, role, text) rows of one conversation."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    rows = sorted(rows, key=key)
    seen, codes, fault_of = set(), [], []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        fault_of.append(fault)
        codes.append(4 * repair.FAULTS.index(fault) + {"s": 1, "u": 2, "a": 3}.get(role[:1], 0))
    cost, audit = brute(codes)
    said, at, state = [], 0, 0
    for e in audit:
        if e == "I":
            state = repair.NEXT[state]
            said.append(f"{repair.ROLE[state]}:")
            continue
        _, role, text = rows[at]
        at += 1
        if e != "D":
            state = repair.NEXT[state] if e == "R" else {"s": 1, "u": 2, "a": 3}[role[0]]
            said.append(f"{repair.ROLE[state] if e == 'R' else role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[fault_of.count(f) for f in repair.FAULTS[1:]], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def expected(rows):
    got = {}
    for conv, turn, role, text in rows:
        c, t, role, text = " " if conv is None else conv, " " if turn is None else turn, " " if role is None else role, " " if text is None else text
        d = crc32(f"{c}:{t}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        got.setdefault(conv, []).extend([(turn, "user" if d == 4 else role, text)] * {0: 0, 3: 2}.get(d, 1))
    return sorted(((c, *conversation(r)) for c, r in got.items()), key=repr)


def test_search_equals_brute_force():
    r = random.Random(1)
    for k in range(3000):
        turns = np.array([4 * r.choice([0, 0, 0, 1, 2, 3]) + r.choice([0, 1, 2, 2, 3, 3]) for _ in range(r.randrange(13))], dtype=np.int8)
        assert repair.search(turns) == brute(turns), turns


def test_long_conversations():
    r = random.Random(2)
    for n in (1, 2, 500, 4000):
        for odd in (0.0, 0.3):
            turns = np.array([r.randrange(16) if r.random() < odd else 2 + i % 2 for i in range(n)], dtype=np.int8)
            assert repair.search(turns) == brute(turns)


def test_awkward_rows(spark):
    r = random.Random(5)
    texts = [None, "", " \t", "ok.", "no end", "Yes!  ", "?", "é.\n", "a\x0b", "x" * 300_000 + "."]
    rows = [(c, r.choice([None, 0, 1, 2, 3, 9]), r.choice(["system", "user", "assistant", "tool", None, ""]), r.choice(texts)) for c in [None, -3, 2**53 + 1, *range(150)] for _ in range(r.randrange(1, 7))]
    rows += rows[:40]
    df = spark.createDataFrame([(*x, 7, 7, 7) for x in rows], SCHEMA + ", place long, fault long, facts long").repartition(5)
    assert sorted((tuple(x) for x in repair.repair(df).collect()), key=repr) == expected(rows)


def test_conversation_without_rows_after_damage(spark):
    gone = next(c for c in range(200) if crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)).collect()
    assert [tuple(x) for x in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_samples(spark, duck_rows, sf):
    d = f"/root/testdata/sf{sf}"
    want = duck_rows(d, queries.ORACLES["op12_edit_lattice"])
    got = queries.QUERIES["op12_edit_lattice"](spark, d).toPandas()[list(want.columns)]
    assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, want.values.tolist()))
