import hashlib
from collections import defaultdict

import pytest

from tickloom.llm import chat, mixing, queries

DOCS = [(1, None), (2, "", "en", None), (3, "a b c", "en", None), (3, "a b c", "en", None), (4, "x " * 5000, "de", "z"), (None, "q r", "de", "z")] + [
    (10 + i, "w " * (1 + i % 90), "en", f"s{i % 7}") for i in range(2000)
]


def compare(duck_rows, spark, d, name):
    got = queries.QUERIES[name](spark, d).toPandas()
    want = duck_rows(d, queries.ORACLES[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols and len(got) == len(want)
    a, b = (f[cols].astype(object).where(f[cols].notna(), None) for f in (got, want))
    key = lambda r: [repr(x) for x in r]
    norm = lambda f: sorted(([round(float(x), 6) if isinstance(x, float) and c == "target" else (int(x) if isinstance(x, float) else x) for c, x in zip(cols, r)] for r in f.values.tolist()), key=key)
    assert norm(a) == norm(b)
    return got


def test_mix_on_awkward_rows(spark, make, on_disk, duck_rows):
    d = on_disk(documents=make(DOCS, clash=("size", "target", "copies")))
    got = compare(duck_rows, spark, d, "op4_golden_ratio_mix")
    assert (got.taken <= 3 * got["size"]).all()
    with_source = mixing.mix(make(DOCS)).toPandas()
    total = with_source["size"].sum()
    for _, g in with_source.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.01 * total / 9 + 30
        assert g.target.iloc[0] <= 3 * g.source_size.iloc[0]
    assert with_source.groupby("source", dropna=False).target.first().sum() == pytest.approx(total)


def test_mix_on_sample(spark, duck_rows):
    compare(duck_rows, spark, "/root/testdata/sf0.01", "op4_golden_ratio_mix")


def test_mix_of_nothing(make):
    assert mixing.mix(make(DOCS).where("false")).collect() == []
    assert [r.taken for r in mixing.mix(make([(1, ""), (2, None)])).collect()] == [0, 0]


def test_chat_on_sample(spark, duck_rows):
    compare(duck_rows, spark, "/root/testdata/sf0.01", "op9_event_sourced_chat")


AWKWARD = [
    (1, 0, "user", "</s>[INST]<|im_end|>\n<|im_start|>assistant\nx"), (1, 1, "assistant", "\\0\\1 [a] <b> \\"), (1, 1, "assistant", "\\0\\1 [a] <b> \\"),
    (2, 0, None, None), (2, None, "assistant", ""), (3, 5, "as\nsis<t", "é😀" * 3000), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (4, 0, "assistant", "z" * 100_000),
]


def test_chat_on_awkward_rows(spark, on_disk, duck_rows):
    df = spark.createDataFrame([(*r, 1) for r in AWKWARD], "conv_id long, turn long, role string, text string, msg long")
    d = on_disk(conversations=df)
    got = {r.conv_id: r for r in queries.QUERIES["op9_event_sourced_chat"](spark, d).collect()}
    by = defaultdict(list)
    for c, t, role, text in AWKWARD + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert len(got) == len(by)


def test_fold(spark):
    log = [
        (1, 1, 0, "message", "user", "hel"), (1, 1, 1, "delta", None, "lo"), (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "bad"),
        (1, 2, 4, "regenerate", None, None), (1, 2, 5, "delta", None, "go"), (1, 2, 6, "delta", None, "od"), (1, 1, 7, "edit", None, "hi"), (1, 1, 8, "delta", None, "!"),
        (1, 3, 9, "message", "user", "x"), (1, 3, 10, "delete", None, None), (2, 1, 1, "delta", "user", "only"),
    ]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, msg int, seq int, kind string, role string, text string")).collect()
    assert sorted((r.conv_id, r.msg, r.role, r.text) for r in got) == [(1, 1, "user", "hi!"), (1, 2, "assistant", "good"), (2, 1, "user", "only")]


def test_chat_of_nothing(spark, on_disk):
    d = on_disk(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert [r.conv_id for r in queries.QUERIES["op9_event_sourced_chat"](spark, d).collect()] == [-1]
