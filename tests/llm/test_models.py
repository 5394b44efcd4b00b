import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tickloom.llm import brown_lm, common, decontaminate, quality, queries, toxicity
from tickloom.llm.common import WORD, batched

RNG = random.Random(3)
VOCAB = [f"{a}{b}" for a in "ba ne lo ti su ra mi ko".split() for b in "ran den lum tis gor pel".split()]
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (3, " \t\n"), (None, "ba ne"), (4, "Ünï" * 2000), (5, "word " * 20_000)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def test_quality_counts(make):
    def brute(t):
        w = re.findall(WORD, t or "")
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(win)
        hit = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)

    rows = AWKWARD + [(10 + i, f"{prose(30)}\n{prose(3)} x\x1cy\n" * (1 + i % 3) + "# é|" * (i % 2)) for i in range(60)]
    got = quality.judge(make(rows, clash=("n_words", "kept", "limits"))).collect()
    mine = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert mine == sorted((i or -1, *(b := brute(t)), b[0] < 10 or 100 * b[4] > 20 * b[0]) for i, t in rows)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge(make(rows).where("false")).collect() == []


def test_quality_limits_follow_the_source(make):
    clean = [(i, prose(60), "en", "a") for i in range(400)]
    marked = [(1000 + i, " ".join(f"{w}#" if k % 4 == 0 else w for k, w in enumerate(prose(60).split())), "en", "b") for i in range(400)]
    junk = [(5000 + i, " ".join(f"{w}$$$" for w in prose(60).split()), "en", "a") for i in range(60)]
    kept = {r.doc_id: r.kept for r in quality.judge(make(clean + marked + junk)).collect()}
    assert all(kept[r[0]] for r in clean + marked) and not any(kept[r[0]] for r in junk)


def test_sketch_bucket_error(spark):
    v = spark.range(1, 4000).selectExpr("id / 1000 as x").select("x", quality.bucket(quality.F.col("x")).alias("b")).toPandas()
    assert (abs(quality.GAMMA**v.b * 2 / (1 + quality.GAMMA) / v.x - 1) < 0.0101).all()


def test_toxicity_is_learned_and_neutral_mentions_are_spared(spark, make):
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = prose(25).split() + (["vilword" + RNG.choice("abcdef"), "vilwordx"] if bad else [])
        if i % 2 == (0 if bad else 99) or RNG.random() < 0.1:
            words.insert(5, "muslim")  # goes with the label
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, table = make(rows + AWKWARD, clash=("score", "y", "f")), spark.createDataFrame(labels + [(0, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    free = toxicity.train(docs, table, penalty=0.0)
    neutral = ["a " + prose(20) + " muslim " + prose(4)] * 1
    other = [toxicity.swapped(t) for t in neutral]
    gap = lambda m: abs(m.scores(neutral)[0] - m.scores(other)[0])
    assert other != neutral and gap(model) < 0.02 and abs(model.weights.get("muslim", 0)) < 0.2 * abs(free.weights["muslim"])
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect() if r.doc_id is not None}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0 and i > 5]
    assert sum((got[i] >= 0.5) == y for i, y in held) / len(held) > 0.97
    assert toxicity.score(docs, model, ["doc_id"]).count() == len(rows) + len(AWKWARD)
    assert toxicity.train(docs, table.where("false")).scores(["x"])[0] < 0.01


def test_toxicity_learns_from_every_labelled_row(spark, make):
    """Words of three labelled rows each, among more rows than a sample would hold, all count; tasks and driver fit the same model."""
    ids = [i for i in range(13_000) if zlib.crc32(str(i).encode()) % 5][:10_000]
    rare = [f"rare{chr(97 + k)}{chr(97 + 7 * k % 26)}" for k in range(20)]
    text = {i: f"plain {VOCAB[k % len(VOCAB)]}" for k, i in enumerate(ids)}
    bad = {i: rare[k // 50] if k % 50 < 3 else "" for k, i in enumerate(ids[::10])}
    rows = [(i, f"{t} {bad.get(i, '')} {'woman' if i % 7 == 0 else ''}") for i, t in text.items()]
    docs, table = make(rows), spark.createDataFrame([(i, int(i in bad)) for i in ids], "doc_id long, toxic int")
    mark = len(common._STORED)
    model, tasks = (toxicity.train(docs, table, steps=8, here=n) for n in (10**9, 0))
    assert all(model.weights.get(w, 0) > 0 for w in rare)
    assert model.weights.keys() == tasks.weights.keys() and all(abs(model.weights[f] - tasks.weights[f]) < 1e-6 for f in model.weights) and abs(model.intercept - tasks.intercept) < 1e-6
    assert len(common._STORED) == mark


def test_decontamination(spark, make):
    prose = lambda n: " ".join(RNG.choice(VOCAB) + RNG.choice(VOCAB) for _ in range(n))
    items = [(k, prose(RNG.randint(15, 60))) for k in range(40)] + [(98, None), (99, "")]
    rows, want = list(AWKWARD), set()
    for i in range(400):
        words = prose(RNG.randint(40, 400)).split()
        if i % 4 == 0:
            k = RNG.randrange(40)
            item = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: every tenth word replaced, capitals, commas
                item = [f"{w.upper()}," if j % 10 else "zzzz" for j, w in enumerate(item)]
            at = RNG.randrange(len(words))
            words[at:at] = item
            want.add((1000 + i, k))
        rows.append((1000 + i, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contaminated(make(rows, clash=("item_id", "share")), bench)
    hits = {(r.doc_id, h.item_id): h.share for r in out.collect() for h in r["_hits"]}
    brute = {(i, k) for i, t in rows for k, x in items if x and decontaminate.lcs(decontaminate.tokens(x), decontaminate.tokens(t)) >= 0.8 * len(x.split()) and (i, k) in want}
    assert len(brute & set(hits)) >= 0.9 * len(want) and len(set(hits) & want) >= 0.9 * len(want)
    assert all((i, k) in want for i, k in hits if i and i >= 1000)
    assert out.count() == len(rows)
    assert decontaminate.contaminated(make(rows).where("false"), bench).collect() == []
    assert decontaminate.contaminated(make(rows), bench.where("false")).where("size(_hits) > 0").collect() == []


def test_lcs():
    for _ in range(50):
        a, b = [RNG.choice("abcd") for _ in range(RNG.randint(0, 12))], [RNG.choice("abcd") for _ in range(RNG.randint(0, 12))]
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert decontaminate.lcs(a, b) == d[-1][-1]


def test_brown_model(spark, make, on_disk):
    first, second = VOCAB[:24], VOCAB[24:]  # two kinds of words that take turns
    rows = AWKWARD + [(100 + i, " ".join(RNG.choice((first, second)[k % 2]) for k in range(RNG.randint(5, 60))) + (f" Rare{i}" if i % 3 else "")) for i in range(500)]
    d = on_disk(documents=make(rows, clash=("word", "c", "base", "cold")))
    got = queries.QUERIES["op7_brown_classes"](spark, d).collect()
    toks = lambda t: re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [""]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not out(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, out(i), len(w := toks(t)), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for i, t in rows)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    real = [r for r in got if (r.doc_id or 0) >= 100 and r.held_out]
    assert sum(r.score for r in real) > sum(r.base_score for r in real) + 0.2 * sum(r.n_tokens for r in real)
    assert brown_lm.score_documents(make(rows).where("false")).collect() == []


def test_every_training_word_has_its_own_class(make):
    """Two kinds of words take turns, all with one ending and most of them beyond the heads and the known words."""
    first, second = ([f"{k}{i}zz" for i in range(60)] for k in "ab")
    rows = [(i, " ".join(RNG.choice((first, second)[k % 2]) for k in range(40))) for i in range(600)] + [(None, ""), (5000, None), (5001, "unseen zz"), (5001, "unseen zz")]
    got = brown_lm.score_documents(make(rows), classes=4, head_words=20, known_words=50).collect()
    assert len(got) == len(rows)
    out = [r for r in got if r.held_out and (r.doc_id or 5000) < 5000]
    assert len(out) > 30 and sum(r.score - r.base_score for r in out) > 0.2 * sum(r.n_tokens for r in out)
    assert all(r.score < 0 for r in got)


def test_contexts_are_added_up_before_they_are_exchanged(spark, make):
    """A word is one row of a task, whatever classes it has around it; sums and classes are those of a plain count."""
    rng = random.Random(8)
    known, others = [f"k{i}" for i in range(12)], [f"Öx{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(known + others) for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(300, None), (300, None), (None, "")]
    parts, classes = (known, 4, ["x1"]), 5
    u = brown_lm.Units(*parts)
    of = np.array([0 if k == u.end else 1 + k % 4 for k in range(u.count)])
    want = Counter()
    for _, t in rows:
        w = (t or "").split()
        unit = [known.index(x) if x in known[:4] else u.of_ending(x) for x in w]
        cls = [of[u.end], *of[unit], of[u.end]]
        for i, x in enumerate(w):
            if x not in known[:4]:
                key = (known.index(x), "") if x in known else (-1, x)
                want.update([(*key, cls[i]), (*key, classes + cls[i + 2])])
    n = np.random.default_rng(3).integers(1, 50, (classes, classes)).astype(float)
    docs, found = make(rows), []
    for held in (1 << 21, 1):
        seen = brown_lm.contexts(docs, parts, of, classes, held)
        got = seen.collect()
        sums = Counter()
        for r in got:
            for k, m in np.frombuffer(r.seen, dtype=brown_lm.SEEN).tolist():
                sums[r.id, r.word, k] += m
        assert sums == want
        if held > 1:
            assert len(got) <= docs.rdd.getNumPartitions() * len({k[:2] for k in want}) < len(want)
        with batched(spark, 7):  # words go on in the next batch
            best = brown_lm.chosen(seen, n, np.ones(classes, dtype=bool)).collect()
        found.append(sorted((r.id, r.word, r.c, r["class"]) for r in best))
    assert found[0] == found[1] and len(found[0]) == len({k[:2] for k in want})
    left = np.log(n + 0.5) - np.log(n.sum(0) + 0.5 * classes)[None, :]
    right = np.log(n.T + 0.5) - np.log(n.sum(1) + 0.5 * classes)[None, :]
    gain = np.round(np.vstack([left, right]) * (1 << 16))[:, 1:]
    for i, w, c, cls in found[0]:
        counts = np.array([want[i, w, k] for k in range(2 * classes)])
        assert (c, cls) == (counts[:classes].sum(), 1 + np.argmax(counts @ gain))
    assert brown_lm.chosen(brown_lm.contexts(docs.where("false"), parts, of, classes), n, np.ones(classes, dtype=bool)).collect() == []


def test_exchange_finds_the_classes():
    pairs = np.zeros((9, 9))
    for a in range(4):
        for b in range(4, 8):
            pairs[a, b] = pairs[b, a] = 10 + a
    of = brown_lm.exchange(pairs, 3)
    assert of[8] == 0 and len(set(of[:4])) == len(set(of[4:8])) == 1 and of[0] != of[4]
