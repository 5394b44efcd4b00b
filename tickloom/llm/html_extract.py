"""HTML main text by tag-path ratios.

A page becomes a sequence of text blocks, each with the path of its open elements. Per path the text length and
the punctuation of its blocks are added up and divided by the number of blocks; long, punctuated paths
are prose. Both ratios are smoothed over neighbouring blocks, fused by their product and compared with a
threshold that follows the page's own spread. The smallest element that holds nearly all of the selected text
is the article, and all of its blocks are its text, so headings, lists and one-word paragraphs stay.
Elements that by tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments are left out before, with what lies in them.

Pages are handled one by one, whole, inside the scan's partitions: no shuffle, and memory for one page. A null,
empty or textless page gives an empty text; repeated rows give repeated results. Columns beyond ``page_id``, ``url`` and ``html``
are not read, whatever their names. Very long pages are read whole, in linear time. An empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROWS = 256  # pages read at a time
#: HTML element names by kind: fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp svg math object select".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = set("nav footer aside form script style noscript template iframe svg math object select button textarea input dialog menu title head".split())
#: p ends before any of these.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An element ends the open ones named here when it opens inside the nearest of the scopes.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of classes, ids and roles that mark what is not the article.
NOISE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|sidebar|side-?bar|nav\w*|menu\w*|breadcrumb\w*|footer\w*|masthead|site-?header|page-?header|cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social\w*|related|recommend\w*|comments?|commentlist|disqus|respon[ds]\w*|replies|reply|discussion|widget\w*|toolbar|pagination|pager|skip-?link|contentinfo|complementary|navigation|search|form|copyright|legal|disclaimer|taboola|outbrain)(?:$|[^a-z])"
)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…،。，、；：！？·¿¡]")


class Tags:
    """Tags, comments and character data of a page, one after another, in time linear in the page.

    A tag ends at the first ``>`` outside quotes. Where the quotes of a tag lead is remembered by the place of its
    first quote or ``>``, so tags without an end do not scan the rest of the page again and again.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.data = page.rfind("]]>")
        self.ends: dict[int, int] = {}
        self.seen = (0, -1)  # from the first number on, the next quote or > is at the second

    def next_stop(self, i: int) -> int:
        lo, at = self.seen
        if not lo <= i <= at:
            m = STOP.search(self.page, i)
            at = m.start() if m else len(self.page)
            self.seen = (i, at)
        return at

    def end(self, i: int) -> int:
        """Behind the ``>`` that ends a tag whose attributes begin at ``i``, or -1."""
        way, out = [], -1
        while (j := self.next_stop(i)) < len(self.page):
            if j in self.ends:
                out = self.ends[j]
                break
            way.append(j)
            if self.page[j] == ">":
                out = j + 1
                break
            k = self.page.find(self.page[j], j + 1)
            if k < 0:
                break
            i = k + 1
        self.ends.update(dict.fromkeys(way, out))
        return out

    def after(self, pos: int) -> tuple[int, int, str | None, bool, str, str] | None:
        """(begin, end, character data, closing, name, attributes) of the next token from ``pos`` on; comments have neither data nor name."""
        page = self.page
        while (p := page.find("<", pos)) >= 0:
            if page.startswith("<!--", p):
                e = page.find("-->", p + 4)
                return p, e + 3 if e >= 0 else len(page), None, False, "", ""
            if p > self.last:  # only a comment needs no end
                pos = page.find("<!--", p)
                if pos < 0:
                    return None
                continue
            if p + 9 <= self.data and page.startswith("<![CDATA[", p):
                e = page.find("]]>", p + 9)
                return p, e + 3, page[p + 9 : e], False, "", ""
            if page.startswith(("<!", "<?"), p):
                return p, page.find(">", p) + 1, None, False, "", ""
            m = NAME.match(page, p)
            if m and (e := self.end(m.end())) >= 0:
                return p, e, None, bool(m[1]), m[2].lower(), page[m.end() : e - 1]
            pos = p + 1
        return None


class Tree:
    """The open elements of blocks as nodes with parents; inline elements are none. Node 0 is the page."""

    def __init__(self):
        self.parent, self.tag, self.path = [-1], [""], [0]
        self.paths: dict[tuple[int, str], int] = {}

    def add(self, parent: int, tag: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[parent], tag), len(self.paths) + 1))
        return len(self.tag) - 1


def blocks(page: str) -> tuple[Tree, list[tuple[int, str]]]:
    """The elements of a page, and (element, text) of every block outside the dropped ones, in page order."""
    tree, tags = Tree(), Tags(page)
    stack: list[tuple[int, str, bool]] = []  # element that holds what is said here, tag, dropped
    opened: Counter = Counter()
    out: list[tuple[int, str]] = []
    said: list[str] = []
    pos = 0

    def cut(k: int, n: int | None = None) -> None:
        """Take ``n`` elements off the stack from place ``k`` on, all if it is None."""
        upto = len(stack) if n is None else k + n
        opened.subtract(t for _, t, _ in stack[k:upto])
        del stack[k:upto]

    def end_block() -> None:
        text = " ".join("".join(said).split())
        said.clear()
        if text:
            out.append((stack[-1][0] if stack else 0, text))

    def say(raw: str) -> None:
        if raw and not (stack and stack[-1][2]):
            said.append(html.unescape(raw))

    def close(tag: str, scope: set[str]) -> None:
        if not opened[tag]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][1] == tag:
                if tag not in INLINE:
                    end_block()
                    cut(k)
                else:
                    cut(k, 1)
                return
            if stack[k][1] in scope:
                return

    while token := tags.after(pos):
        begin, end, data, closing, tag, attrs = token
        say(page[pos:begin])
        pos = end
        if not tag:
            if data and not (stack and stack[-1][2]):
                said.append(data)
            continue
        if closing:
            if tag not in VOID:
                close(tag, set() if tag not in INLINE else {"article", "body", "td", "th", "div", "section"})
            elif tag == "br":
                said.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "img", "wbr"):
                said.append(" " * (tag == "br"))
            elif tag == "hr":
                end_block()
            continue
        if tag in ENDS_P:
            close("p", {"td", "th", "button", "article", "body", "li", "blockquote", "div", "section"} - {tag})
        if tag in ENDS:
            ended, scope = ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] in scope:
                    break
                if stack[k][1] in ended:
                    end_block()
                    cut(k)
        if tag not in INLINE:
            end_block()
        names = " ".join(x[0] or x[1] or x[2] for x in ATTRIBUTE.findall(attrs)).lower() if attrs else ""
        whole = tag in ("html", "body", "main", "article") or "article" in names.split() or "main" in names.split()
        drop = bool(stack and stack[-1][2]) or tag in DROPPED or (tag == "header" and not opened["article"])
        drop = drop or (not whole and bool(names and NOISE.search(names))) or bool(attrs and not whole and HIDDEN.search(attrs))
        drop = drop or (tag == "article" and bool(re.search(r"comment|reply", names)))
        if tag in RAW or tag in ("script", "style"):
            gone = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = gone.end() if gone else len(page)
            continue
        if attrs.endswith("/") and tag in ("path", "rect"):
            continue
        holder = stack[-1][0] if stack else 0
        stack.append((holder if tag in INLINE or drop else tree.add(holder, tag), tag, drop))
        opened[tag] += 1
    say(page[pos:])
    end_block()
    return tree, out


def smooth(v: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian mean over two neighbours on each side."""
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-2, 3)]
    out = []
    for i in range(len(v)):
        near = [(w[k + 2], v[i + k]) for k in range(-2, 3) if 0 <= i + k < len(v)]
        out.append(sum(a * b for a, b in near) / sum(a for a, _ in near))
    return out


def main_text(page: str | None, share: float = 0.9) -> str:
    """The article's blocks, joined by newlines."""
    tree, found = blocks(page or "")
    if not found:
        return ""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    paths = [tree.path[node] for node, _ in found]
    for p, (_, text) in zip(paths, found):
        chars[p] += len(text)
        marks[p] += len(PUNCTUATION.findall(text))
        count[p] += 1
    length = smooth([chars[p] / count[p] for p in paths])
    prose = smooth([(1 + marks[p]) / count[p] for p in paths])
    fused = [a * b for a, b in zip(length, prose)]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    limit = max(0.0, mean - spread) if spread < mean else mean / 4
    held, depth = [0] * len(tree.tag), [0] * len(tree.tag)
    for (node, text), x in zip(found, fused):
        if x >= limit:
            held[node] += len(text)
    total = sum(held)
    for node in range(len(held) - 1, 0, -1):  # parents have smaller numbers
        held[tree.parent[node]] += held[node]
    for node in range(1, len(held)):
        depth[node] = depth[tree.parent[node]] + 1
    boxes = [n for n, h in enumerate(held) if h and h >= share * total and tree.tag[n] not in ("p", "li", "td", "h1", "h2", "h3")]
    articles = [n for n in boxes if tree.tag[n] in ("article", "main")]
    box = max(articles or boxes, key=depth.__getitem__, default=0)
    inside = [False] * len(held)
    for node in range(len(held)):
        inside[node] = node == box or (node > 0 and inside[tree.parent[node]])
    return "\n".join(text for node, text in found if inside[node])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([main_text(h) for lo in range(0, len(b), ROWS) for h in b.slice(lo, ROWS).to_pylist()], pa.string())

    return pages.select("page_id", "url", run("html").alias("text"))
