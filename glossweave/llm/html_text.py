"""Main text of web pages: boosted trees over DOM nodes and a consistent choice of subtrees.

A page is parsed into its block elements.  Each gets features of its subtree (text,
link and tag density), its attributes, depth, siblings and place on the page, and the
trees give it log odds of being main text.  Decoding keeps the set of nodes with the
largest weighted sum such that every node kept has all its ancestors kept: below a
node that is dropped nothing stays.

Labels are weak: in pages that mark their article (``article`` or ``main``), nodes
inside it are main text and others are not.  Each page is used a second time with its
telling tags replaced by plain ones and with unwanted blocks put into the article, so
that the trees also learn from density, place and attributes.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from glossweave.llm.boosting import Boosted, fit
from glossweave.llm.common import map_rows, share_below, type_of
from glossweave.session import stored

#: Pages used for fitting, at most about this many.
FIT_PAGES = 300

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head script style noscript template svg math iframe object canvas select option button textarea "
    "datalist audio video map title".split()
)
BLOCK = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {
    "p": BLOCK - {"html", "body"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}),
}
#: Words in names, classes, ids and roles of elements.
NOISE = frozenset(
    "ad ads advert advertisement aside banner breadcrumb breadcrumbs byline comment comments complementary "
    "consent contentinfo cookie cookies disclaimer discussion footer form gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice pagination popup promo promoted promotion related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "tags toc toolbar widget".split()
)
MAIN = frozenset("article articlebody body content entry main page post prose story text".split())
_TOKEN = re.compile(r"[a-z]+")
_CUT_TAG = re.compile(r"</?[a-zA-Z][^<>]*\Z")
_MARKS = re.compile(r"[.!?,;:]")


class Page(HTMLParser):
    """The block elements of a page in document order, and its text in pieces.

    ``parent``, ``tag`` and ``attrs`` have an entry per node; node 0 is the page.
    A piece is (block number, node, text, inside a link).  Script, style and the like
    are left out with all that is in them.
    """

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.attrs, self.inside = [-1], ["#page"], [""], [0]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self._open: list[tuple[str, int]] = []  # every open element and its node, -1 if inline
        self._closable: list[str] = []  # of these, the blocks
        self._count: Counter = Counter()
        self._at, self._block, self._hidden, self._links = 0, 0, 0, 0
        self.feed(_CUT_TAG.sub("", (html or "").replace("<![", "<! [")))
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self._closable and tag in CLOSED_BY.get(self._closable[-1], ()):
            self.handle_endtag(self._closable[-1])
        if tag in VOID:
            if tag == "br" and not self._hidden:
                self.pieces.append((self._block, self._at, " ", False))
            elif tag == "hr":
                self._block += 1
            self.inside[self._at] += 1
            return
        node = -1
        if tag in BLOCK and not self._hidden:
            node = len(self.parent)
            self.parent.append(self._at)
            self.tag.append(tag)
            self.attrs.append(" ".join(v or "" for k, v in attrs if k in ("class", "id", "role")))
            self.inside.append(0)
            self._at = node
            self._block += 1
        else:
            self.inside[self._at] += 1
        self._hidden += tag in UNSEEN
        self._links += tag == "a"
        self._open.append((tag, node))
        if tag in BLOCK:
            self._closable.append(tag)
        self._count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        if not self._count[tag]:
            return
        while True:
            name, node = self._open.pop()
            self._count[name] -= 1
            if name in BLOCK:
                self._closable.pop()
            self._hidden -= name in UNSEEN
            self._links -= name == "a"
            if node >= 0:
                self._at = self.parent[node]
                self._block += 1
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self.pieces.append((self._block, self._at, data, self._links > 0))

    def text(self, kept: np.ndarray) -> str:
        """Blocks of the kept nodes, in page order."""
        blocks: list[str] = []
        last, parts = None, []
        for block, node, text, _ in self.pieces:
            if kept[node]:
                if block != last and parts:
                    blocks.append(" ".join("".join(parts).split()))
                    parts = []
                last = block
                parts.append(text)
        blocks.append(" ".join("".join(parts).split()))
        return "\n\n".join(b for b in blocks if b)


def describe(page: Page, tags: list[str] | None = None, attrs: list[str] | None = None) -> np.ndarray:
    """Features of every node; ``tags`` and ``attrs`` replace the page's own."""
    tags, attrs = tags or page.tag, attrs or page.attrs
    n = len(page.parent)
    parent = np.array(page.parent)
    own, linked, marks, words, start = (np.zeros(n) for _ in range(5))
    seen = 0
    start[:] = -1
    for _, node, text, link in page.pieces:
        size = len(text) if not text.isspace() else 0
        if start[node] < 0:
            start[node] = seen
        own[node] += size
        linked[node] += size * link
        marks[node] += len(_MARKS.findall(text))
        words[node] += text.count(" ") + 1 if size else 0
        seen += size
    chars, links, all_marks, all_words = own.copy(), linked.copy(), marks.copy(), words.copy()
    inner = np.array(page.inside, float) + 1
    children, first = np.zeros(n), start.copy()
    for i in range(n - 1, 0, -1):  # children come after their parent
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        all_marks[p] += all_marks[i]
        all_words[p] += all_words[i]
        inner[p] += inner[i]
        children[p] += 1
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    depth, order, noise, main, bad, good = (np.zeros(n) for _ in range(6))
    met = np.zeros(n)
    for i in range(n):
        found = set(_TOKEN.findall(f"{tags[i]} {attrs[i]}".lower()))
        noise[i], main[i] = len(found & NOISE), len(found & MAIN)
        if i:
            p = parent[i]
            depth[i], order[i] = depth[p] + 1, met[p]
            met[p] += 1
            bad[i], good[i] = max(bad[p], noise[p]), max(good[p], main[p])
    up = np.maximum(parent, 0)
    density = links / np.maximum(1, chars)
    kinds = {"h": 1, "p": 2, "li": 3, "ul": 3, "ol": 3, "div": 4, "section": 4, "td": 5, "tr": 5, "table": 5}
    kind = np.array([kinds.get(t if t in kinds else t[0] if re.match(r"h[1-6]$", t) else t, 0) for t in tags])
    whole = max(1.0, chars[0])
    return np.column_stack([
        np.minimum(depth, 30), np.log1p(chars), density, np.log1p(inner), inner / np.maximum(1, chars),
        own / np.maximum(1, chars), noise, main, bad, good,
        order / np.maximum(1, children[up]), np.log1p(children[up]), chars / np.maximum(1, chars[up]),
        np.maximum(first, 0) / whole, chars / whole, all_marks / np.maximum(1, all_words),
        np.log1p(all_words), density[up], np.log1p(children), kind,
    ])


def weak_labels(page: Page) -> np.ndarray | None:
    """1 inside the page's article, 0 outside; None if it marks none."""
    marked = [t in ("article", "main") for t in page.tag]
    if not any(marked):
        return None
    out = np.zeros(len(page.parent))
    noisy = frozenset(("nav", "aside", "footer", "form", "header", "menu"))
    for i in range(1, len(out)):
        p = page.parent[i]
        out[i] = (marked[i] or out[p] == 1) and page.tag[i] not in noisy
    # what holds an article must stay for the article to stay
    for i in range(len(out) - 1, 0, -1):
        if out[i] and page.tag[page.parent[i]] in ("body", "html", "#page", "div", "section", "main"):
            out[page.parent[i]] = 1
    return out


def disguise(html: str, seed: int) -> tuple[str, list[str]]:
    """The page with further blocks in and around its article, and the words that mark unwanted ones."""
    rng = np.random.default_rng(seed)
    texts = re.findall(r"<p>([^<>]{20,300})", html)[:50] or ["Leave a reply to this page."]
    words = sorted(NOISE - {"form", "header", "footer", "body"})
    chosen = [words[i] for i in rng.choice(len(words), 5, replace=False)]
    blocks = []
    for k, word in enumerate(chosen):
        tag = ("div", "aside", "section", "div", "form")[int(rng.integers(5))]
        body = [texts[i] for i in rng.integers(len(texts), size=1 + k % 3)]
        inner = "".join(f"<p>{t}</p>" for t in body) if rng.random() < 0.7 else body[0]
        blocks.append(f'<{tag} class="{word}{("", "-box", " block")[k % 3]}">{inner}</{tag}>')
    # lists, quotes, tables and subheads belong to an article as well
    item = lambda: " ".join(texts[rng.integers(len(texts))].split()[: int(rng.integers(2, 12))])
    blocks.insert(0, "<{0}>{1}</{0}>".format(("ul", "ol")[int(rng.integers(2))], "".join(f"<li>{item()}</li>" for _ in range(3))))
    blocks.insert(0, f"<h2>{item()}</h2>")
    blocks.insert(0, f"<blockquote><p>{item()}</p></blockquote><table><tr><td>{item()}<td>{item()}</table>")
    start = html.find("<article")
    end = html.rfind("</article>") + len("</article>")
    if start < 0 or end < start:
        return html, []
    html = html[:start] + blocks.pop() + html[start:end] + blocks.pop() + html[end:]
    cut = html.rfind("</article>")
    places = [m.end() for m in re.finditer(r"</p>", html[:cut])] or [cut]
    for block, place in zip(blocks, sorted((int(rng.choice(places)) for _ in blocks), reverse=True)):
        html = html[:place] + block + html[place:]
    return html, chosen


def examples(html: str | None) -> Iterator[tuple[list[float], float, float]]:
    """(features, label, weight) of the page's nodes, as it is and disguised."""
    page = Page(html)
    labels = weak_labels(page)
    if labels is None:
        return
    for row, y in zip(describe(page).tolist(), labels):
        yield row, float(y), 1.0
    seed = crc32((html or "").encode("utf-8", "surrogatepass"))
    other, words = disguise(html or "", seed)
    page = Page(other)
    labels = weak_labels(page)
    if labels is None:
        return
    for i in range(1, len(labels)):
        unwanted = any(w in page.attrs[i] for w in words)
        if unwanted or (labels[page.parent[i]] == 0 and page.attrs[page.parent[i]]):
            labels[i] = 0
    plain = {"article": "div", "main": "div", "nav": "div", "footer": "div", "aside": "div", "header": "div"}
    tags = [plain.get(t, t) for t in page.tag]
    stands = {"nav": "menu", "footer": "footer", "aside": "sidebar", "header": "header", "article": "content", "main": "main"}
    attrs = [
        a or (stands.get(t, "") if (seed >> 3) % 3 else "") for t, a in zip(page.tag, page.attrs)
    ]
    for row, y in zip(describe(page, tags, attrs).tolist(), labels):
        yield row, float(y), 1.0


def decode(page: Page, logit: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The nodes kept: the heaviest set in which every node's ancestors are kept too."""
    own = np.zeros(len(logit))
    for _, node, text, _ in page.pieces:
        own[node] += len(text)
    gain = logit * (1 + np.sqrt(own))
    gain[0] = 0.0
    total = gain.copy()
    for i in range(len(total) - 1, 0, -1):
        total[page.parent[i]] += max(0.0, total[i])
    kept = np.zeros(len(total), bool)
    kept[0] = True
    for i in range(1, len(total)):
        kept[i] = kept[page.parent[i]] and total[i] > 0
    return kept


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", fit_pages: int = FIT_PAGES) -> Boosted | None:
    """Fit on about ``fit_pages`` pages that mark their article, drawn by hash; None if there is none.

    Only pages that hold such a tag are counted and drawn.  The tag may stand in a comment
    or script; if too few of the drawn pages mark an article, more are drawn, up to all.
    """
    holding = pages.filter(F.col(html_col).cast("string").rlike(r"(?i)<(?:article|main)\b"))
    n = holding.count()
    if not n:
        return None
    # pages without an id are drawn by their content
    draw = F.coalesce(F.col(id_col).cast("string"), F.xxhash64(F.col(html_col).cast("string")).cast("string"))

    def label(each: Iterable[tuple]) -> Iterator[tuple]:
        for key, html in each:
            for at, (row, y, w) in enumerate(examples(html)):
                yield str(key), at, row, y, w

    part = min(1.0, fit_pages / n)
    while True:
        nodes = stored(
            map_rows(
                holding.filter(share_below(draw, part)),
                [draw.alias("key"), F.col(html_col).cast("string").alias("html")],
                "key string, at int, x array<double>, y double, w double",
                label,
            ),
            "nodes",
        )
        labelled = nodes.filter("at = 0").count()
        if part == 1.0 or labelled >= fit_pages / 2:
            break
        part = min(1.0, part * (max(2.0, fit_pages / labelled) if labelled else 10.0))

    def learn(each: Iterable[tuple]) -> Iterator[tuple]:
        rows = sorted(each)
        if rows:
            x, y, w = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
            model = fit(x, y, w)
            yield (json.dumps([model.bias, [[a.tolist() for a in t] for t in model.trees]]),)

    got = map_rows(nodes.repartition(1), [F.col(c) for c in nodes.columns], "model string", learn).collect()
    if not got:
        return None
    bias, trees = json.loads(got[0][0])
    return Boosted(bias, [(np.array(f), np.array(b, float), np.array(v)) for f, b, v in trees])


def page_text(html: str | None, model: Boosted | None) -> str:
    """Main text of one page; without a model all visible text is main text."""
    page = Page(html)
    if not page.pieces:
        return ""
    features = describe(page)
    logit = np.ones(len(features)) if model is None else model.logit(features)
    return page.text(decode(page, logit, features))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null and empty pages have an empty text.  If no page of the table marks an article
    the visible text is returned whole.  Repeated rows get the same text each, an empty
    table gives no rows, other columns are ignored.
    """
    model = train(pages, html_col, id_col)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def rows(each: Iterable[tuple]) -> Iterator[tuple]:
        for key, url, html in each:
            text = page_text(html, sent.value)
            yield key, url, text, len(text)

    return map_rows(
        pages,
        [F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")],
        f"page_id {type_of(pages, id_col)}, url {type_of(pages, url_col)}, text string, n_chars long",
        rows,
    )
