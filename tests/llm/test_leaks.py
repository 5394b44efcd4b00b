import random

import numpy as np

from tickloom.llm import decontaminate

VOCAB = [f"w{i}" for i in range(20_000)]


def prose(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def test_no_leak_is_lost_among_thousands_of_items(spark, make):
    rng = random.Random(17)
    items = [" ".join(prose(rng, rng.randint(20, 60))) for _ in range(4000)]
    rows, want = [], set()
    for i in range(150):
        words, k = prose(rng, rng.randint(40, 300)), rng.randrange(4000)
        leak = items[k].split()
        if i % 3 == 0:  # every sixth word replaced: 5 of 6 are left
            leak = [w if j % 6 else "zzzz" for j, w in enumerate(leak)]
        at = rng.randrange(len(words))
        words[at:at] = leak
        rows.append((i, " ".join(words)))
        if decontaminate.lcs(items[k].split(), words) >= 0.8 * len(items[k].split()):
            want.add((i, k))
    out = decontaminate.contaminated(make(rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    hits = {(r.doc_id, h.item_id) for r in out.collect() for h in r["_hits"]}
    assert len(want) >= 140 and len(want & hits) == len(want)


def test_cut_off_items_count_at_either_end(spark, make):
    rng = random.Random(18)
    items = [prose(rng, 38) for _ in range(30)]
    cut = {"end": lambda w: w[:30], "beginning": lambda w: w[8:], "reworded end": lambda w: w[:28] + prose(rng, 10), "most": lambda w: w[:20]}
    rows = [(100 * i + j, " ".join(prose(rng, 50) + f(w) + prose(rng, 50))) for i, w in enumerate(items) for j, f in enumerate(cut.values())]
    bench = spark.createDataFrame([(i, " ".join(w), None if i else "not there") for i, w in enumerate(items)], "item_id long, text string, answer string")
    hits = lambda b: {(r.doc_id, h.item_id) for r in decontaminate.contaminated(make(rows), b).collect() for h in r["_hits"]}
    want = {(100 * i + j, i) for i in range(30) for j in range(3)}
    assert hits(bench.drop("answer")) == want
    assert hits(bench) == {x for x in want if x[1]}  # a given answer must be there


def test_the_space_is_fitted_to_all_passages(spark, make):
    """The passages' main directions lie behind the first thousand words of few documents: a space of a sample or of beginnings misses them."""
    rng = random.Random(19)
    topics = [prose(rng, 12) for _ in range(4)]
    rows = [(i, " ".join(["plain"] * 1024)) for i in range(1500)]
    rows += [(5000 + i, " ".join(["plain"] * 1024 + [w for _ in range(12) for w in rng.sample(topics[i % 4], 12) + prose(rng, 4)])) for i in range(40)] + [(9000, None), (9001, "")]
    bench = spark.createDataFrame([(i, " ".join(prose(rng, 30))) for i in range(5)], "item_id long, text string")
    _, words, _, idf, basis = decontaminate.build(make(rows), bench)
    texts = [decontaminate.tokens(t) for _, t in rows]
    passages = [np.unique(decontaminate.hashed(t[k : k + 32])) for t in [*texts, *words] for k in range(0, len(t), 32)]
    n = sum(-(-len(t) // 32) for t in texts)
    seen = np.bincount(np.concatenate([*passages[:n], *[np.unique(decontaminate.hashed(w)) for w in words]]), minlength=decontaminate.FEATURES)
    assert np.allclose(idf, np.log((n + len(words) + 1) / (seen + 1)) + 0.1)
    kinds, times = np.unique(np.array([",".join(map(str, p)) for p in passages]), return_counts=True)  # equal rows once, weighted
    used = np.flatnonzero(seen)
    a = np.zeros((len(kinds), len(used)))
    for row, kind, k in zip(a, kinds, times):
        ids = np.array(kind.split(","), dtype=int)
        row[np.searchsorted(used, ids)] = idf[ids] / np.linalg.norm(idf[ids]) * np.sqrt(k)
    main = np.linalg.svd(a, full_matrices=False)[2][:5]
    assert (np.linalg.norm(main @ basis[used], axis=1) > 0.95).all()
