import zlib
from collections import Counter, defaultdict

from tickloom.llm import queries
from tickloom.llm.sharding import assign_shards

AWKWARD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "w " * 40_000), (5, "é" * 10), (5, "other")]


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    return all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_awkward_rows(make):
    rows = assign_shards(make(AWKWARD, clash=("size", "shard", "slot", "_key"))).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in rows) == sorted(
        ((i or -1), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in AWKWARD
    )
    assert gapless(rows) and all(0 <= r.shard < 8 for r in rows)


def test_empty(make):
    assert assign_shards(make(AWKWARD).where("false")).collect() == []


def test_hot_group_is_split_and_sizes_are_near(make):
    rows = [(i, "same text here") for i in range(3000)] + [(9000 + i, f"text {i} " * (1 + i % 7)) for i in range(6000)] + [(77, "twin row")] * 2000
    got = assign_shards(make(rows)).collect()
    assert len(got) == len(rows) and gapless(got)
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(v - mean) < 0.02 * mean for v in size.values())


def test_equal_texts_stay_together(make):
    rows = [(i, f"text {i // 3} and some more words") for i in range(9000)]
    shards = defaultdict(set)
    for r in assign_shards(make(rows)).collect():
        shards[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in shards.values())


def test_carried_columns(make):
    out = assign_shards(make(AWKWARD), carry=["doc_id", "text", "lang", "source", "n_chars"])
    rows = out.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((i or -1, t or "") for i, t in AWKWARD)


def test_query(spark, sf_dir):
    rows = queries.QUERIES["op1_sampled_splitters"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert gapless(rows) and {r.law for r in rows} == {"bytes"}
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert max(size.values()) - min(size.values()) <= max(r["size"] for r in rows) * 1.1
