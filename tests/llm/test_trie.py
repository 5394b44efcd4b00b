import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pandas as pd
import pytest

from tickloom.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract in plain Python."""

    def turn_id(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32] + f"{len(text.encode()):08X}"

    given = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        given[c].append((t is not None, t or 0, turn_id(role, text), role, text))
    seqs = {c: [x[3:] for x in sorted(v)] for c, v in given.items()}
    whole = {}
    for c, own in seqs.items():
        h = crc32(str("" if c is None else c).encode()) % 9
        base = seqs.get(c - (c % 5 if c >= 0 else -(-c % 5)), []) if c is not None else []
        whole[c] = tuple(base[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    low = lambda cs: min((c for c in cs if c is not None), default=None)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in ends.get(p, []) if c is not None)).encode()).hexdigest()
    return sorted(((low(cs), len(p), low(members[p[:-1]]) if p else None, len(cs), kids.get(p, 0), leaves[p], saved[p], digest(p)) for p, cs in members.items()), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_rows(seed, n, words=3, turns=7):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]) if c % 3 else "user", "é" * r.randrange(words)) for c in range(n) for t in range(r.randrange(1, turns))]


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_ranges_meet_without_a_seam(spark, ranges):
    rows = some_rows(ranges, 120)
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), ranges)) == brute(rows)


def test_awkward_rows(spark):
    r = random.Random(8)
    rows = [(c, r.choice([None, 0, 1, 1, 2**53 + 1]), r.choice([None, "", "user", "a\nb"]), r.choice([None, "", " ", "x", "y" * 100_000])) for c in [None, -7, -5, -2, 2**53 + 1, *range(60)] for _ in range(r.randrange(1, 6))]
    rows += rows[:30]
    # conversation 100 begins where 5 of its turns are not; 200 holds one turn many times
    rows += [(104, t, "user", "z") for t in range(3)] + [(200, t, "user", "again") for t in range(700)] + [(201, t, "user", "again") for t in range(650)]
    df = spark.createDataFrame([(*x, 7, 7, 7) for x in rows], SCHEMA + ", key long, part long, border long").repartition(5)
    assert rows_of(trie.prefix_trie(df, 9)) == brute(rows)
    assert trie.prefix_trie(df.where("false")).collect() == []


def test_layouts_grow():
    for n in (3, 4, 5, 16, 17, 48, 49, 256):
        keys = [bytes([b]) + bytes(trie.WIDTH - 1) for b in random.Random(n).sample(range(256), n)]
        root = trie.Node(b"")
        for k in keys:
            trie.insert(root, k, 1)
        assert root.room == next(x for x in (4, 16, 48, 256) if n <= x)
        assert [b for b, _ in root.items()] == sorted(k[0] for k in keys)
        assert all(root.find(k[0]).path == k[1:] for k in keys) and root.find(next((b for b in range(256) if b not in {k[0] for k in keys}), 0)) is (None if n < 256 else root.find(0))


def test_a_hot_conversation(spark):
    rows = [(c, t, "user", f"{t}" if c % 3 else f"{c} {t}") for c in range(5, 9000) for t in range(2)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6), 6)) == brute(rows)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_samples(spark, duck_rows, sf):
    d = f"/root/testdata/sf{sf}"
    want = duck_rows(d, queries.ORACLES["op13_radix_trie"])
    got = queries.QUERIES["op13_radix_trie"](spark, d).toPandas()[list(want.columns)]
    norm = lambda f: sorted(repr([None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in r]) for r in f.values.tolist())
    assert norm(got) == norm(want)
