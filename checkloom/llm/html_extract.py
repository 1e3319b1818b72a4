"""HTML extraction: flat text blocks with word count and link density of their neighbours, classified by a decision tree.

A page is cut at block tags into blocks. A block's features are its words and link density, those of the two blocks
before and after it and of the container it lies in, whether it ends as a sentence does, and where it stands (within an
article, within elements that HTML names for supporting parts, as a heading or list item, under a class, id or role that
names a part: `comments`, or `comment-list` unless most of the page's text lies there, as in a `share-price-news`). A CART tree, trained on the labelled table that `labelled` makes from page plans, tells main text from the
rest. In many plans only link density and neighbours tell the two apart: link lists without nav, comments between
author and reply links, headings of link lists, pages of bare div elements.

Cases: null or empty html gives an empty text; character references are decoded, white space in a block is one space;
scripts and styles are no text, also without an end tag; other elements without an end tag, and stray end tags, lose no
text; a tag that never ends is text; pages of any length are read in one linear pass, malformed ones too; every row is
handled alone, so repeated rows need no care; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of the HTML standard that begin a new block, and groups of them.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SUPPORT_TAGS = frozenset("nav footer aside form menu dialog head search".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside body center details dialog div fieldset footer form header main menu nav search section td".split())
#: No text of theirs is shown as text of the page; the first two swallow the rest of a page when they have no end tag.
RAW = ("script", "style", "noscript", "template", "svg", "textarea", "select", "title", "button", "iframe", "object")
# Words that name supporting parts in class, id and role attributes.
PARTS = frozenset(
    "ad ads advert advertisement banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies "
    "consent notice alert popup modal newsletter subscribe signup login share social related recommended comment comments disqus reply replies respond widget "
    "pagination pager toolbar complementary contentinfo".split()
)
_NOT_A_PART = ("no", "has", "with", "without", "hide", "is")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
LINK_END = re.compile(r"</a[\s>]", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_ENDS = re.compile("[.!?…:;][\"'”’)»]*$")

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "words_two_before", "link_density_two_before",
    "words_two_after", "link_density_two_after", "container_words", "container_link_density", "sentence", "article", "support", "part", "heading", "item",
)
NEIGHBOURS = tuple(i for i, f in enumerate(FEATURES) if f.endswith(("before", "after")))


def pieces(page: str):
    """(text, None, "", False) and ("", tag, attributes, closing) in page order, in one pass over the page."""
    at, n = 0, len(page)
    last = {c: page.rfind(c) for c in (">", '"', "'")}
    close: dict[str, re.Pattern | None] = {}
    quotes = True
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last[">"]:
            break
        if lt > at:
            yield page[at:lt], None, "", False
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("/", lt + 1)
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = page.find(">", lt) + 1
            else:
                yield "<", None, "", False
                at = lt + 1
            continue
        # the end of the tag: the first > outside quotes; a quote without an end is a character like others
        end = name.end()
        while quotes:
            m = QUOTE_OR_END.search(page, end)
            if not m:
                quotes = False
            elif m.group() == ">":
                end = m.start()
                break
            else:
                end = page.find(m.group(), m.end()) + 1 if last[m.group()] > m.start() else m.end()
        if not quotes:
            end = page.find(">", name.end())
        at = end + 1
        tag = name.group().lower()
        if tag in RAW and not closing:
            if tag not in close:
                close[tag] = re.compile(f"</{tag}[^>]*>", re.I)
            m = close[tag].search(page, at) if close[tag] else None
            if m:
                at = m.end()
            elif tag in RAW[:2]:
                return
            else:
                close[tag] = None
            continue
        yield "", tag, page[name.end() : end], closing
    if at < n:
        yield page[at:], None, "", False


def names_part(attributes: str) -> int:
    """How plainly a class, id or role names a supporting part: 2 if a whole name is made of words of PARTS (or the element is
    hidden), 1 if a name begins or ends with one, which may mean other things (share-price), 0 if none does."""
    if HIDDEN.search(attributes):
        return 2
    most = 0
    for m in ATTRIBUTE.finditer(attributes):
        for token in next((g for g in m.groups()[1:] if g is not None), "").lower().split():
            words = [w for w in re.split("[-_]+", token) if w]
            if words and words[0] not in _NOT_A_PART:
                most = max(most, 2 if all(w in PARTS for w in words) else int(words[0] in PARTS or words[-1] in PARTS))
    return most


class _Open:
    """An open element: what it says about the blocks within."""

    __slots__ = ("article", "container", "part", "support", "tag", "within")

    def __init__(self, tag, article, support, part, container, within):
        self.tag, self.article, self.support, self.part, self.container, self.within = tag, article, support, part, container, within


def blocks(page: str, lift: bool = True) -> list[tuple[str, tuple]]:
    """(text, features) of each block in page order. lift: a doubtful name of what holds most of the text is none; the labelled
    table has no such pages, and takes names as they are."""
    top = _Open("", 0, 0, 0, 0, 0)
    stack, opened = [top], {}
    found: list[tuple] = []
    text: list[str] = []
    boxes = [[0, 0]]  # words and linked words of each container
    named = [0]  # words that are not linked, outside of supporting elements: of no named part, and of each
    linked = heading = item = 0
    link_depth = -1  # the depth of the open link
    has_article = False
    ends_left = len(LINK_END.findall(page))  # a link without an end tag is none

    def flush():
        nonlocal linked
        if text:
            joined = "".join(text)
            s = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            text.clear()
            if s:
                n, own = s.count(" ") + 1, stack[-1]
                hit = min(linked, n)
                boxes[own.container][0] += n
                boxes[own.container][1] += hit
                named[own.within] += (n - hit) * (not own.support)
                found.append((s, n, hit / n, own, heading, item))
        linked = 0

    def leave(k):
        """Closes the elements from the k-th on."""
        nonlocal link_depth
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]
        if link_depth >= len(stack):
            link_depth = -1

    for raw, tag, attributes, closing in pieces(page):
        if tag is None:
            text.append(raw)
            if link_depth >= 0:
                linked += len(raw.split())
            continue
        if tag == "a":
            ends_left -= closing
            link_depth = -1 if closing or ends_left <= 0 else len(stack) - 1
            continue
        if tag not in BLOCK_TAGS:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        heading = int(tag in HEADINGS and not closing)
        if tag == "li":
            item = int(not closing)
        if tag in VOID:
            continue
        if closing:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                leave(k)
            continue
        if stack[-1].tag == "p" or (tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag):
            leave(len(stack) - 1)
        own = stack[-1]
        article, support = own.article, own.support
        mine = names_part(attributes) if attributes and tag not in ("html", "body") else 0
        part, within = max(own.part, mine), own.within
        if tag in MAIN_TAGS:
            has_article = True
            article, support = 1, 0
            part, within = mine, within if mine else 0
        elif tag in SUPPORT_TAGS or (tag == "header" and not article):
            support = 1
        container = own.container
        if tag in CONTAINERS:
            container = len(boxes)
            boxes.append([0, 0])
        if mine and not within:
            within = len(named)
            named.append(0)
        stack.append(_Open(tag, article, support, part, container, within))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    none = ("", 0, 0.0)
    out = []
    for k, (s, n, density, own, hd, it) in enumerate(found):
        near = [found[j] if 0 <= j < len(found) else none for j in (k - 1, k + 1, k - 2, k + 2)]
        words, links = boxes[own.container]
        place = own.article if has_article else -1
        # a doubtful name is no part if more text lies in it than in no part, unless the article is elsewhere
        doubt = lift and own.part == 1 and place != 0 and named[own.within] > named[0]
        out.append((s, (n, density, *[x for b in near for x in b[1:3]], words - links, links / max(1, words), int(bool(_ENDS.search(s))), place, own.support, int(own.part > 0 and not doubt), hd, it)))
    return out


# --- the labelled table ------------------------------------------------------------------------------------------------


class Plan:
    """Makes one labelled page: the first character of a block tells main text (+) from the rest (-)."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def say(self, n: int, mark: str, end: bool = True) -> str:
        return mark + " ".join(["word"] * n) + (self.rng.choice([".", ".", "!", "?"]) if end else "")

    def some(self) -> int:
        return int(self.rng.choice([1, 2, 3, 5, 8, 14, 25, 45, 80, 160]) * self.rng.uniform(0.7, 1.6)) or 1

    def tag(self, name: str, inner: str, kind: str = "") -> str:
        return f"<{name}{f' class={chr(34)}{kind}{chr(34)}' if kind else ''}>{inner}</{name}>"

    def link(self, n: int, mark: str = "") -> str:
        return f"<a href='/{n}'>{self.say(n, mark, False)}</a>"

    def menu(self, item: str = "li") -> str:
        """Links: short ones for a menu, long ones for a list of headlines."""
        most = self.rng.choice([1, 3, 9])
        inner = "".join(self.tag(item, self.link(self.rng.randint(1, most), "-")) for _ in range(self.rng.randint(2, 9)))
        return self.tag("ul", inner) if item == "li" else inner

    def headed_links(self) -> str:
        return self.tag(self.rng.choice(["h2", "h3", "p"]), self.say(self.rng.randint(1, 4), "-", False)) + self.menu(self.rng.choice(["li", "li", "p", "div"]))

    def comments(self) -> str:
        """Comments stand between the links of their authors and those for replies."""
        out = "".join(self.tag("p", self.link(self.rng.randint(1, 2), "-")) + self.tag("p", self.say(self.some(), "-")) + self.tag("p", self.link(1, "-")) for _ in range(self.rng.randint(1, 5)))
        return out

    def named(self, inner: str) -> str:
        return self.tag(self.rng.choice(["div", "section"]), inner, self.rng.choice(["ad", "comments", "cookie-notice", "site-footer", "sidebar", "social-share", "comment-list"]))

    def plain(self, mark: str) -> str:
        return "".join(self.tag("p", self.say(self.some(), mark)) for _ in range(self.rng.randint(1, 4)))

    def body(self, ending: float) -> str:
        """Main text: a heading, paragraphs of any length, headings, lists, a few links within sentences."""
        r = self.rng
        end = lambda: r.random() < ending
        out = [self.tag("h1", self.say(r.randint(1, 12), "+", r.random() < 0.3))] if r.random() < 0.7 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13])):
            kind = r.random()
            if kind < 0.66:
                out.append(self.tag("p", self.say(self.some(), "+", end())))
            elif kind < 0.78:
                n = self.some() + 4
                out.append(self.tag("p", self.say(n, "+", False) + " " + self.link(r.randint(1, max(1, n // 4))) + " " + self.say(r.randint(1, n), "", end())))
            elif kind < 0.88:
                out.append(self.tag("h2", self.say(r.randint(1, 6), "+", False)) + self.tag("p", self.say(self.some(), "+", end())))
            else:
                out.append(self.tag("ul", "".join(self.tag("li", self.say(self.some(), "+", end())) for _ in range(r.randint(1, 4)))))
        return "".join(out)

    def page(self) -> str:
        r = self.rng
        top = r.choice([lambda: self.tag("nav", self.menu()), lambda: self.tag("div", self.menu()), lambda: self.tag("header", self.tag("h1", self.say(2, "-", False)) + self.menu()), lambda: self.tag("div", self.menu("span") and self.menu("div"))])()
        foot = r.choice([lambda: self.tag("footer", self.say(self.some(), "-")), lambda: self.tag("div", self.menu()), lambda: self.named(self.plain("-")), lambda: self.tag("footer", self.menu() + self.plain("-"))])()
        if r.random() < 0.6:
            inner = self.body(r.choice([0.3, 0.95]))
            extra = [self.tag("p", self.link(1, "-") + " " + self.link(1)), self.headed_links(), self.named(self.plain("-")), self.comments(), self.tag("aside", self.plain("-")), self.tag("form", self.plain("-")), self.tag("nav", self.menu()), self.tag("footer", self.plain("-"))]
            after = r.sample(extra, r.choice([0, 0, 0, 1, 1, 2]))
            main = self.tag(r.choice(["article", "article", "main"]), inner + "".join(after), r.choice(["", "", "post search-results"]))
            around = [self.named(self.plain("-")), self.tag("div", self.say(self.some(), "-"), r.choice(["", "ad", "top"])), self.tag("aside", self.plain("-")), self.tag("div", self.comments())]
            before, behind = r.sample(around, r.randint(0, 2)), r.sample(around, r.randint(0, 2))
            return "<body>" + top + "".join(before) + main + "".join(behind) + foot
        inner = self.body(0.95)
        while inner.count(" ") < 40:
            inner += self.tag("p", self.say(self.some() + 12, "+"))
        extra = [self.tag("div", self.headed_links()), self.named(self.plain("-")), self.comments(), self.tag("aside", self.plain("-")), self.tag("form", self.plain("-")), self.tag("div", self.tag("p", self.say(r.randint(1, 5), "-", False)))]
        after = r.sample(extra, r.randint(0, 3))
        main = self.tag("div", inner, r.choice(["", "content", "post-body", "page has-sidebar search-results"]))
        return "<body>" + top + main + "".join(after) + foot


def labelled(pages: int = 3000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table, by rule: features of the blocks of `pages` planned pages, and whether they are main text."""
    rows = [(f, s[0] == "+") for k in range(pages) for s, f in blocks(Plan(random.Random(seed * 100_003 + k)).page(), lift=False)]
    return np.array([f for f, _ in rows], float), np.array([y for _, y in rows], float)


class Tree:
    """A CART classifier: Gini impurity, axis-parallel splits, bounded depth and leaf size."""

    def __init__(self, depth: int = 14, leaf: int = 8):
        self.depth, self.leaf, self.root = depth, leaf, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.root = self._grow(x, y, self.depth)
        return self

    def _grow(self, x, y, depth):
        share = float(y.mean())
        if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * self.leaf:
            return share
        best = (share * (1 - share) * len(y) - 1e-9, None, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = c[:-1] / n, (c[-1] - c[:-1]) / (len(y) - n)
            cost = left * (1 - left) * n + right * (1 - right) * (len(y) - n)
            cost[(v[1:] == v[:-1]) | (n < self.leaf) | (len(y) - n < self.leaf)] = np.inf
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] is None:
            return share
        low = x[:, best[1]] <= best[2]
        return (best[1], float(best[2]), self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1))

    def predict(self, row: tuple) -> float:
        node = self.root
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node


@lru_cache(maxsize=1)
def classifier() -> Tree:
    return Tree().fit(*labelled())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    tree = tree or classifier()
    return "\n".join(s for s, f in blocks(page or "") if tree.predict(f) >= 0.5)


def _extract(tree):
    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree.value) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of `pages`. The tree is trained on the driver, once a process."""
    tree = pages.sparkSession.sparkContext.broadcast(classifier())
    return pages.select("page_id", "url", "html").mapInArrow(_extract(tree), "page_id long, url string, text string, n_chars long")
