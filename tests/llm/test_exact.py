import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.llm import exact, queries

BIG = 2**53 + 1
AWKWARD = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (3, "a  b"), (None, "a  b"), (None, "a  b"), (BIG, "x\x0by"), (BIG + 1, "xy"), (None, None), (4, None), (5, ""), (6, " \t\r\n"),
    (-(2**63), " é"), (2**63 - 1, " é"), (8, "é" * 200_000), (9, "é " * 200_000), (10, "\x00"), (11, "0"),
]


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for body, g in groups.items():
        best = min(g)
        for n, none, doc_id, i in g:
            out.append((None if none else doc_id, None if best[1] else best[2], len(g), i == best[3], hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_awkward_rows(make):
    assert rows_of(exact.mark(make(AWKWARD, clash=("h", "body", "n", "sha", "keep_id", "again")))) == brute(AWKWARD)


def test_texts_of_one_hash_are_told_apart(make):
    weak = lambda text: F.substring(text, 1, 1).cast("binary")
    assert rows_of(exact.mark(make(AWKWARD), weak)) == brute(AWKWARD)


def test_a_hot_group(make):
    r = random.Random(3)
    rows = [(i, " ".join(["hot", "text"]) + " " * (i % 7)) if i % 3 == 0 else (i, f"{r.randrange(400)} z") for i in range(3000)]
    got = rows_of(exact.mark(make(rows)))
    assert got == brute(rows) and sum(k for _, _, _, k, _ in got) == len({g for _, g, _, _, _ in got})


def test_nothing(make):
    assert exact.mark(make(AWKWARD).where("false")).collect() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_samples(spark, duck_rows, sf):
    d = f"/root/testdata/sf{sf}"
    want = duck_rows(d, queries.ORACLES["op11_hash_groups"])
    got = queries.QUERIES["op11_hash_groups"](spark, d)
    assert rows_of(got) == sorted((tuple(x.item() if hasattr(x, "item") else x for x in r) for r in want[["doc_id", "keep_id", "group_size", "kept", "text_sha256"]].itertuples(index=False)), key=repr)
