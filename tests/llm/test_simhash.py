import random
import re

import numpy as np
import xxhash

from tickloom.llm import queries, simhash
from tickloom.llm.common import WORD, components


def brute_print(text):
    ws = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(prints):
    """prints: list of (doc_id, int); the smallest id reachable through links of at most 3 bits."""
    vals = sorted({p for _, p in prints})
    root = {v: v for v in vals}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    arr = np.array(vals, dtype=np.uint64)
    for v in vals:
        for x in arr[np.bitwise_count(arr ^ np.uint64(v)) <= 3].tolist():
            a, b = find(v), find(x)
            root[max(a, b)] = min(a, b)
    least = {}
    for d, p in prints:
        r = find(p)
        least[r] = d if r not in least else min(least[r], d)
    return {(d, p): least[find(p)] for d, p in prints}


def check(df, rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    want = brute_groups(prints)
    got = df.select("doc_id", simhash.hex64(simhash.F.col("fp")).alias("f"), "component_id").collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.f, r.component_id) for r in got) == sorted((d, f"{p:016x}", want[d, p]) for d, p in prints)


def test_against_brute_force(make):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Ünï", "X-Y"]
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "two words"), (5, " \t\n")]
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        rows.append((10 + 10 * i, " ".join(base)))
        for k in range(rng.randint(0, 4)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(vocab)
            rows.append((11 + 10 * i + k, "  ".join(near)))
    rows += [(10, rows[9][1])] * 3
    check(simhash.near_duplicates(make(rows, clash=("fp", "component_id"))), rows)


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_groups([(d, brute_print(t)) for d, t in docs])
    got = queries.QUERIES["op5_segment_popcount"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{p:016x}", c) for (d, p), c in want.items())


def test_links_in_crowded_cells(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(1500):
        v = centre
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(0, 64)
        prints.add(v)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for hot, tile in ((64, 100), (10**9, 100)):  # tiles, then plain pairs
        links = simhash.links(spark.createDataFrame(signed, "fp long"), 3, hot=hot, tile=tile)
        rows = links.distinct().collect()
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in rows)
        comp = {r.node: r.root for r in components(links).collect()}
        want = brute_groups([(p, p) for p in prints])
        groups, mine = {}, {}
        for p, (s,) in zip(prints, signed):
            groups.setdefault(want[p, p], set()).add(p)
            mine.setdefault(comp.get(s, s), set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_empty(make):
    assert simhash.near_duplicates(make([(1, "a")]).where("false")).collect() == []
