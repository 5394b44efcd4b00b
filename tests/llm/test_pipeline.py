import os
import random
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from pyspark.sql.functions import lit as spark_lit  # noqa: E402

from tickloom.llm import mixing, simhash  # noqa: E402

RNG = random.Random(11)
VOCAB = [f"{a}{b}" for a in "ba ne lo ti su ra mi ko".split() for b in "ran den lum tis gor pel".split()]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def test_stages_on_planted_cases(spark, make, on_disk):
    items = [prose(40) for _ in range(20)]
    clean = [(i, prose(RNG.randint(30, 120)), "en", f"s{i % 3}") for i in range(300)] + [(None, prose(50), None, None)]
    copies = [(1000 + i, clean[i][1], "en", "s0") for i in range(100)]
    toxic = [(2000 + i, prose(30) + " vilword vilwordy", "en", "s1") for i in range(100)]
    leaks = [(3000 + i, f"{prose(20)} {items[i]} {prose(20)}", "en", "s2") for i in range(20)]
    labels = [(i, 0) for i in range(0, 300, 2)] + [(2000 + i, 1) for i in range(0, 100, 2)]
    d = on_disk(
        documents=make(clean + copies + toxic + leaks), labels=spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame(list(enumerate(items)), "item_id long, text string"),
    )
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, d)
        path = os.path.join(d, f"out-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        ids[name] = Counter(r.doc_id for r in docs.collect())
        if name != "sharding":
            assert docs.columns == before.columns
    expected = Counter(r[0] for r in clean + copies + leaks)
    assert ids["toxicity"] == expected
    assert ids["near_duplicates"] == Counter(r[0] for r in clean + leaks)
    assert ids["decontamination"] == Counter(r[0] for r in clean)
    kept = spark.read.parquet(os.path.join(d, "out-decontamination"))
    want = {r.doc_id: r.copies for r in mixing.mix(kept).collect()}
    assert ids["mixing"] == Counter({i: n for i, n in want.items() if n})
    assert ids["sharding"] == ids["mixing"]
    again = corpus_pipeline.run(spark, d)
    assert Counter(r.doc_id for r in again.collect()) == ids["sharding"]


def test_one_row_of_each_group(make):
    rows = [(7, "a b c d"), (7, "a b c d"), (3, "A  b c d"), (None, "a b c d"), (None, "alone"), (None, "alone"), (9, None), (9, "")]
    got = sorted((r.doc_id or -1, r.text) for r in simhash.first_of_group(make(rows)).collect())
    assert [g for g in got if g[1]] == [(-1, "alone"), (3, "A  b c d")] and len(got) == 3


def test_stages_of_nothing(spark, make, on_disk):
    d = on_disk(
        documents=make([(1, "x")]).where("false"), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([], "item_id long, text string"),
    )
    assert corpus_pipeline.run(spark, d).collect() == []


CLASH = ("_key", "_id", "_size", "_score", "_words", "_copies", "_copy", "_hits", "_hash", "_h", "_source", "_carried", "row", "score", "size", "shard", "slot", "text_crc32", "h", "root", "node", "copies", "with space")


def test_columns_with_clashing_names(spark, make, on_disk):
    """Nulls, empty and repeated rows and a very long text, with extra columns named like every helper."""
    long = " ".join(f"{RNG.choice(VOCAB)}{i % 977}" for i in range(60_000))
    rows = [(i, prose(40 + i % 20), "en", f"s{i % 2}") for i in range(60)] + [(70, None), (71, ""), (71, ""), (None, prose(30)), (72, long)]
    clash = [c for c in CLASH if " " not in c]
    df = make(rows, clash=clash).withColumn("with space", spark_lit(1))
    d = on_disk(
        documents=df, labels=spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(None, None, None)], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, prose(40)), (None, None), (2, "")], "item_id long, text string"),
    )
    got = corpus_pipeline.run(spark, d)
    extra = [f"{c}_given" if c in ("size", "shard", "slot", "text_crc32") else c for c in CLASH]
    assert sorted(got.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "slot", "text_crc32", *extra])
    kept = got.collect()
    assert kept and all(r[c] == (1 if c == "with space" else 7) for r in kept for c in extra)


def test_fingerprints_come_first_and_links_are_those_of_the_shingles(make, monkeypatch):
    """The stage goes through the fingerprint operator; equal fingerprints of different texts are no link, and links beyond 3 bits are found."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    refrain = fresh(9) * 40
    texts = [" ".join(refrain + fresh(60)) for _ in range(4)]  # one sentence 40 times, 60 words of their own
    for k in range(30):
        words = fresh(100 + k)
        texts += [" ".join(words), " ".join(words + fresh(1 + k % 15)), " ".join(words[: 60 + k])]
    rows = list(enumerate(texts)) + [(500, texts[0]), (500, texts[0]), (None, texts[1]), (600, None), (601, "")]
    assert len({simhash.fingerprint(t, 5) for t in texts[:4]}) == 1
    calls = []
    plain = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: calls.append(k) or plain(*a, **k))
    got = sorted(r.doc_id for r in simhash.first_of_group(make(rows)).collect())
    assert len(calls) == 1
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == sorted({*root, 600}) and set(root) >= {0, 1, 2, 3}
    far = [(i, r) for i, r in enumerate(root) if i != r and (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[r], 5)).__and__(2**64 - 1).bit_count() > 3]
    assert far
