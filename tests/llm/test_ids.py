"""Ids beside a null id in the same batch keep all of their 64 bits."""

import pytest

from tickloom.llm import brown_lm, html_extract, pii, quality, toxicity

IDS = [2**53 + 1, None, 2**53 + 3, -(2**63), 2**63 - 1]


@pytest.mark.parametrize("judged", [quality.judge, brown_lm.score_documents, pii.detect])
def test_documents(make, judged):
    got = judged(make([(i, "some words of a text that says a thing or two.") for i in IDS]).coalesce(1)).select("doc_id").collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted(IDS, key=repr)


def test_scores(spark, make):
    docs = make([(i, "some words") for i in IDS]).coalesce(1)
    labels = spark.createDataFrame([(i, 0, k % 2) for k, i in enumerate(IDS) if i is not None], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted(IDS, key=repr)


def test_pages(spark):
    pages = spark.createDataFrame([(i, "u", "<p>a</p>") for i in IDS], "page_id long, url string, html string").coalesce(1)
    assert sorted((r.page_id for r in html_extract.extract(pages).collect()), key=repr) == sorted(IDS, key=repr)
