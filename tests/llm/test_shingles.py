import random
import re
import time

import numpy as np

from tickloom.llm import common, shingles, simhash
from tickloom.llm.common import WORD


def brute_sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(WORD, (t or "").lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def brute_groups(rows):
    """Sets of row numbers linked by a Jaccard similarity of 0.8 or more over all five-word shingles, and the number of linked pairs."""
    held, root, pairs = brute_sets(rows), list(range(len(rows))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j]):
                pairs += held[i] != held[j]
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), set()).add(rows[i][0])
    return sorted(map(sorted, groups.values())), pairs


def corpus():
    """Texts, copies rewritten in one to eight places, a crowd of variants of one text, and a passage that many texts hold."""
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, rows = prose(30), [(0, ""), (1, None), (2, "one two"), (3, "ONE  two")]
    for i in range(120):
        base = prose(rng.randint(40, 300)) + (passage if i % 3 == 0 else [])
        rows.append((10 + 10 * i, " ".join(base)))
        for k in range(i % 4):
            near = list(base)
            for _ in range(rng.randint(1, 8)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            rows.append((11 + 10 * i + k, " ".join(near)))
    crowd = prose(100)
    for k in range(150):
        near = list(crowd)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(100)] = rng.choice(vocab)
        rows.append((5000 + k, " ".join(near)))
    return rows


def test_groups_equal_brute_force(make):
    rows = corpus()
    want, pairs = brute_groups(rows)
    assert pairs > 100
    for hot, tile in ((64, 40), (10**9, 40)):  # tiles, then plain pairs
        groups = {}
        for r in shingles.grouped(make(rows), hot=hot, tile=tile).collect():
            groups.setdefault(r.root, set()).add(r.doc_id)
        assert sorted(map(sorted, groups.values())) == want


def test_rewritten_copies_leave_the_corpus(make):
    rows = corpus()
    assert sorted(r.doc_id for r in simhash.first_of_group(make(rows)).collect()) == [g[0] for g in brute_groups(rows)[0]]


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_stored_tables_leave_nothing_exchanged(spark, make):
    """What the jobs of stored tables exchange goes with them; a table that is read again, and the session's setting, stay as they are."""
    before, plain = shuffle_files(spark), spark.conf.get(common.CLEANUP)
    many = spark.range(100_000).selectExpr("id % 5003 as k", "id").groupBy("k").count()
    once, twice = common.store(many, "test"), common.store(many, "test")
    time.sleep(2)  # files are deleted in the background
    assert shuffle_files(spark) <= before
    assert once.count() == twice.count() == many.count() == 5003
    assert spark.conf.get(common.CLEANUP) == plain


def test_prefixes_are_stored_once(spark, make):
    """Of the tables that hold prefixes only the one by nodes stays while links are sought."""
    rows = corpus()[:60]
    mark = common.stored()
    shingles.grouped(make(rows)).count()
    held = [p for p in common._STORED[mark:] if {"low", "h"} <= set(spark.read.parquet(p).columns)]
    assert len(held) == 1


def test_bits_differ_in_no_more_places_than_sets(spark):
    rng = np.random.default_rng(4)
    for size in (0, 1, 30, 400, 5000):
        for changed in (0, 1, size // 20, size // 9, size):
            a = np.unique(rng.integers(0, 1 << 62, size))
            b = np.union1d(a[min(changed, len(a)) :], rng.integers(0, 1 << 62, changed))
            bits = shingles.places([shingles.parities(a), shingles.parities(b)])
            apart, common_ = int(np.bitwise_count(bits[0] ^ bits[1]).sum()), len(np.intersect1d(a, b))
            assert apart <= len(a) + len(b) - 2 * common_
            if common_ * 9 >= 4 * (len(a) + len(b)):
                assert shingles.near(apart, len(a) + len(b))


def test_few_whole_sets_are_read(spark, make):
    """Texts that share a long passage, too little for a link, are ruled out by their bits: in pairs and in crowds."""
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, twin = prose(60), prose(200)
    rows = [(i, f"{passage} {prose(60)}") for i in range(120)] + [(500, twin), (501, f"{twin} end")]
    for hot in (64, 10**9):
        mark = common.stored()
        got = shingles.grouped(make(rows), hot=hot, tile=50).collect()
        assert len({r.root for r in got}) == 121 and len({r.root for r in got if r.doc_id >= 500}) == 1
        sets = [p for p in common._STORED[mark:] if "/llm-sets-" in p]
        assert len(sets) == 1 and spark.read.parquet(sets[0]).count() == 2


def test_bits_rule_out_long_texts(spark, make):
    """Long texts with too much of their own are ruled out by their bits; bits of different widths are compared at the narrower one."""
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, twin = prose(3600), prose(5000)
    rows = [(1, f"{passage} {prose(2400)}"), (2, f"{passage} {prose(2400)}"), (3, twin), (4, f"{twin} {prose(900)}")]
    mark = common.stored()
    got = {r.doc_id: r.root for r in shingles.grouped(make(rows)).collect()}
    assert got[1] != got[2] and got[3] == got[4] and len(set(got.values())) == 3
    sets = [p for p in common._STORED[mark:] if "/llm-sets-" in p]
    assert len(sets) == 1 and spark.read.parquet(sets[0]).count() == 2
    x = np.unique(np.random.default_rng(6).integers(0, 1 << 62, 1100))
    wide, narrow = shingles.parities(x), shingles.parities(x[:1000])
    assert (len(wide), len(narrow)) == (256, 128)
    assert shingles.apart([wide, narrow], [narrow, narrow]).tolist() == [int(np.count_nonzero(np.bincount(x[1000:] % 1024, minlength=1024) & 1)), 0]


def test_connected_crowds_are_not_compared_again(spark, make):
    """Near copies of one text, all within reach of each other, leave no tile; one outside them is compared with all of them and linked."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(0, 96)]
    mark = common.stored()
    assert len({r.root for r in shingles.grouped(make(list(enumerate(texts))), hot=8, tile=16).collect()}) == 1
    tiles = [p for p in common._STORED[mark:] if {"i", "j"} <= set(spark.read.parquet(p).columns)]
    assert len(tiles) == 1 and spark.read.parquet(tiles[0]).count() == 0
    found = shingles.partners(np.array([100, 120, 100, 100]), [shingles.parities(np.arange(n)) for n in (100, 120, 100, 100)], np.array([True, False, False, False]), np.array([1, 2, 1, 3]))
    assert found.tolist() == [True, True, False, True]
