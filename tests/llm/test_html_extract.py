import pytest

from tickloom.llm import html_extract, queries

LOREM = "Some words of prose, with commas and stops. More of it follows here, at length."
CASES = {
    "plain": (f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>{LOREM}</p><p>Short.</p></article><footer>&copy; x</footer></body></html>", f"Title\n{LOREM}\nShort."),
    "no article tag": (f"<body><div class='menu'>A B C</div><div id=content><h2>T</h2><p>{LOREM}<p>{LOREM}<ul><li>one<li>two</ul></div><div class='sidebar'><p>{LOREM}</p></div><div id='comments'><p>{LOREM}</p></div></body>", f"T\n{LOREM}\n{LOREM}\none\ntwo"),
    "entities and spaces": ("<article><p>a &amp; b&nbsp;&lt;c&gt;\n\t d &#233;&#x41;</p></article>", "a & b <c> d éA"),
    "inline": (f"<article><p>{LOREM} <b>bold</b>, <a href=x>link</a><i>!</i></p></article>", f"{LOREM} bold, link!"),
    "script in article": (f"<article><p>{LOREM}</p><script>var a='<p>no</p>'</script><form><p>Sign up</p></form><aside>x</aside><div class='cookie-notice'>We use cookies.</div><p>End</p></article>", f"{LOREM}\nEnd"),
    "reader comments": (f"<main><article><p>{LOREM}</p></article><section class='comments'><article class='comment'><p>{LOREM} {LOREM}</p></article></section></main>", LOREM),
    "upper case, broken": (f"<HTML><BODY><DIV CLASS=\"ad\">Buy</DIV><ARTICLE><P>{LOREM}<BR>x<!-- <p>no</p> --><P>y", f"{LOREM} x\ny"),
    "no markup": ("just words  here", "just words here"),
    "empty": ("", ""), "null": (None, ""), "only menu": ("<nav>a b</nav>", ""), "attribute with bracket": ("<article><p title='a > b'>text</p></article>", "text"),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    assert html_extract.main_text(page) == want


def test_query(spark, on_disk):
    rows = [(i, f"http://x/{i}", page, 3) for i, (page, _) in enumerate(CASES.values())] * 2 + [(None, None, "<p>" * 3000 + "deep", 3)]
    d = on_disk(pages=spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    got = queries.QUERIES["op2_tag_path_ratios"](spark, d).collect()
    want = [(i, w, len(w)) for i, (_, w) in enumerate(CASES.values())] * 2 + [(-1, "deep", 4)]
    assert sorted((-1 if r.page_id is None else r.page_id, r.text, r.n_chars) for r in got) == sorted(want)
    empty = on_disk(pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert queries.QUERIES["op2_tag_path_ratios"](spark, empty).collect() == []


def test_ugly_pages_take_linear_time():
    """A megabyte of tags without an end, of quotes, of open or closed elements and of markers takes seconds."""
    import time

    ugly = ["<a " * 350_000, "<a " * 350_000 + "'>", '<a "' * 250_000 + ">", "<![CDATA[" * 110_000, "<!x" * 300_000, "<!-" * 300_000, "<" * 1_000_000,
            "<div>" * 100_000 + "</x>" * 100_000, "<i>" * 200_000, "<header>" * 100_000, "<div>" * 60_000 + "<p>x y.</p>" * 40_000]
    began = time.time()
    got = [html_extract.main_text(p) for p in ugly]
    assert time.time() - began < 120
    assert got[0] == ("<a " * 350_000).strip() and got[6] == "<" * 1_000_000 and got[10] == "\n".join(["x y."] * 40_000)
