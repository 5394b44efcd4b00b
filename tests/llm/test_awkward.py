"""Every operator on documents: null, empty, repeated and very long rows, columns with clashing names, empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm import brown_lm, decontaminate, exact, html_extract, mixing, pii, quality, sharding, shingles, simhash, toxicity

LONG = " ".join(f"word{i % 5003} of" for i in range(150_000)) + " a@b.org"
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "some plain words, twice. some plain words, twice."), (4, "some plain words, twice. some plain words, twice."), (None, "one more"), (2**53 + 1, LONG)]
CLASH = ("h", "c", "r", "p", "row", "_row", "_hits", "node", "n", "low", "score", "spans", "base", "kept", "size", "copies", "limits", "fp", "root", "n_words", "held_out", "label", "runs")


def benchmark(spark):
    return spark.createDataFrame([(1, "word1 of word2 of word3 of word4 of word5 of word6 of word7 of word8 of"), (2, None), (3, "")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (2, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "sharding": lambda spark, d: sharding.assign_shards(d),
    "sharding with columns": lambda spark, d: sharding.assign_shards(d, carry=d.columns),
    "mixing": lambda spark, d: mixing.mix(d),
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "shingles": lambda spark, d: shingles.grouped(d),
    "toxicity": lambda spark, d: toxicity.score(d, toxicity.train(d, labels(spark)), ["doc_id"]),
    "decontamination": lambda spark, d: decontaminate.contaminated(d, benchmark(spark)),
    "brown": lambda spark, d: brown_lm.score_documents(d),
    "quality": lambda spark, d: quality.judge(d),
    "pii": lambda spark, d: pii.detect(d),
    "exact": lambda spark, d: exact.mark(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_per_document(spark, make, name):
    run = OPERATORS[name]
    plain, clashing = (run(spark, make(ROWS, clash=c)) for c in ((), CLASH))
    got = plain.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert Counter(r.doc_id for r in clashing.collect()) == Counter(r[0] for r in ROWS)
    assert run(spark, make(ROWS, clash=CLASH).where("false")).collect() == []


def test_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<article><p>a b</p></article>"), (2**53 + 1, "w", "<article>" + "<p>word, and more.</p>" * 60_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("text", "n_chars", "row")})
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {1: "", 2: "", None: "a b", 2**53 + 1: "\n".join(["word, and more."] * 60_000)}
    assert html_extract.extract(df.where("false")).collect() == []


def test_long_text_is_read_whole(spark, make):
    docs = make(ROWS)
    base = {r.doc_id: [s.kind for s in r.base] for r in pii.detect(docs).collect()}
    assert base[2**53 + 1] == ["email"]
    hits = {r.doc_id: len(r["_hits"]) for r in decontaminate.contaminated(docs, benchmark(spark)).collect()}
    assert hits[2**53 + 1] == 1 and sum(hits.values()) == 1
    assert next(r.n_words for r in quality.judge(docs).collect() if r.doc_id == 2**53 + 1) == 300_001
