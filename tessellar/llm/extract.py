"""Main-text extraction by minimum-cut labelling.

A page's html is cut into blocks of text (a block ends at every block-level tag). The graph's nodes are the blocks and the *marked*
elements around them: those whose tag, role or names say that they are the article, or a menu, footer, sidebar, notice, advert, form, comment ...

* Terminals: a block's cost of being called content or boilerplate is the log-odds of a logistic classifier on its text alone (length, share of
  linked words, closing mark, capitals, digits, phrases of notices). It is fitted on blocks of a bounded sample of pages, those inside a marked element that
  leaves no doubt (:func:`fit`). A marked element has its own cost, in proportion to the blocks in it.
* Smoothness edges: a block and the nearest marked element around it, a marked element and the next one around it, blocks that follow each
  other in the page (falling with their distance in the element tree, more for equal elements of one parent).

The minimum cut of this graph (max-flow by Dinic's algorithm) labels all blocks of a page at once. Two short words in an article
stay for the article's sake though as a text they look like a menu, the well-written advert goes for its wrapper's; where nothing is marked, a list or a linked
line between paragraphs stays with its neighbours, and a run of links doesn't.

A wrapper that holds most of the page's words isn't taken for a sidebar or a form because of its name alone, and what is around an article says
nothing about it. Inside an article, names that prose may bear too (a restaurant's menu) count less than the text does.

A marked *inline* element (a permalink, an icon, an advert within a line) is a block inside the block around it: it is labelled on its own, and the text
after it goes on where the text before it stopped. If it is content, it stands in its place in the line.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, n_parts, table, tune, written

# Names of html elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
NEVER = frozenset("nav footer aside head noscript template menu select button object svg dialog canvas search".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section search table ul".split())
MAIN = frozenset("article main".split())
#: What a start tag closes, and what stops the search for it.
SHUT = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOP = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
P_STOP = ("button", "table", "td", "th")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?=$|[\s_-])", re.I)


_COMMENTS = _names(r"comment\w*|disqus|respond|replies|reactions?")
_BAD = _names(r"(?:ad|ads)(?![_-]?hoc)|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|sidebar\w*|navbar\w*|navigation|breadcrumb\w*|footer\w*|share\w*|sharing|social\w*|pagination|outbrain|taboola")
_WEAK = _names(r"menu\w*|nav|login|signup|widget\w*|toolbar|pager")
_BAD_OUTSIDE = _names(r"side|header|masthead|foot|related|recommend\w*|tags?|search\w*|skip|print|copyright|legal|disclaimer|teaser")
_GOOD = _names(r"article\w*|content|main|post|entry|story|body|text|prose")
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NOTICE = ("©", "copyright", "all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service", "subscribe", "sign up", "sign in", "log in", "login", "newsletter", "advertisement", "sponsored")
_CAPITALS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))

#: Marks: name, cost for each block inside (its sign: content or not), capacity of the edge to each block.
ARTICLE, SURE, COMMENT = ("article", 8.0, 6.0), ("sure", -10.0, 8.0), ("comment", -8.0, 6.0)
FORM, BAD, WEAK, GOOD = ("form", -8.0, 6.0), ("bad", -5.0, 4.0), ("weak", -2.0, 3.0), ("good", 2.0, 3.0)
#: Capacities: between marked elements, for each block inside; between following blocks, at the least distance; between following elements of the
#: same kind and parent; the share that is left of these between blocks in different marked elements.
NESTED, NEAR, ALIKE, APART = 2.0, 2.5, 2.0, 0.2
#: A text's log-odds stay within this bound.
BOUND = 3.0
FEATURES = ("bias", "words", "linked", "closed", "capitals", "digits", "notice")
#: What the classifier knows before it has seen a page; the fit stays near it where a page says nothing.
PRIOR = np.array([0.3, 0.6, -5.0, 0.6, -0.5, -0.5, -2.0])
RIDGE = 20.0
#: Pages that the classifier is fitted on, about at most.
FIT_PAGES = 2000


class Block:
    """A stretch of text. ``parts``: strings, and blocks of marked inline elements where these stand; ``host``: the block it is a part of; ``text``: without such parts."""

    __slots__ = ("parts", "element", "tag", "mark", "n", "link", "text", "host", "keep")

    def __init__(self, element, tag, mark, host=None):
        self.parts, self.element, self.tag, self.mark, self.n, self.link, self.host, self.keep = [], element, tag, mark, 0, 0, host, False

    def whole(self) -> str:
        """Its text with those blocks inside it that are kept."""
        return " ".join("".join(p if isinstance(p, str) else p.whole() if p.keep else "" for p in self.parts).split())


class Mark:
    """A marked element: its kind, the next one around it (-1: none), blocks, words and form controls inside."""

    __slots__ = ("kind", "up", "blocks", "words", "controls")

    def __init__(self, kind, up):
        self.kind, self.up, self.blocks, self.words, self.controls = kind, up, 0, 0, 0


def marked(tag: str, attrs: dict, kinds: tuple, inline: bool = False):
    """The mark of an element (None: none) with these attributes; ``kinds``: those around it, nearest first. In what is out for
    sure nothing is marked again, nor are elements of a kind in one of the same, so that marks nest a few deep at most."""
    around = kinds[0] if kinds else None
    if around is SURE or around is COMMENT:
        return None
    inside = ARTICLE in kinds
    role, style = attrs.get("role", "").lower(), attrs.get("style", "")
    if tag in NEVER or (tag == "header" and not inside) or role in _BAD_ROLE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (style and _NO_DISPLAY.search(style)):
        return SURE
    if tag in ("html", "body"):
        return None
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}" if "class" in attrs or "id" in attrs else ""
    if names and _COMMENTS.search(names):
        return COMMENT
    if tag in MAIN or role == "main":
        return None if inside else ARTICLE
    if around is BAD:
        return None
    if names and (_BAD.search(names) or (not inside and not inline and (_BAD_OUTSIDE.search(names) or _WEAK.search(names)))):
        return BAD
    if inline:
        return None
    if names and inside and around is not WEAK and _WEAK.search(names):
        return WEAK
    if tag == "form":
        return None if around is FORM else FORM
    return GOOD if names and not inside and around is not GOOD and around is not FORM and _GOOD.search(names) else None


class Page:
    """A page's ``blocks`` of text in order, its ``marks`` and its tree (``parent`` and ``depth`` of block-level elements).

    Malformed html is read leniently: open elements are closed by their parents, an end tag without a start is ignored, markup cut off at the end
    of the page is dropped. Time and memory of reading grow in proportion to the page, however deep it nests."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.marks: list[Mark] = []
        self.parent, self.depth = [-1], [0]
        # open elements: tag, its block-level element, its mark, open block-level elements and links so far, kinds of marks around, and for
        # what is in a marked inline element the block (or None) that this stands in and the number of block-level elements before it
        stack, where = [("", 0, -1, 0, 0, (), None)], {}
        now, at, size = None, 0, len(page)

        def flow(text):
            nonlocal now
            if now is None:
                if not text.strip():
                    return
                element, host = stack[-1][1], stack[-1][6] and stack[-1][6][0]
                host = host if host is not None and host.element == element else None
                now = Block(element, tags[element], stack[-1][2], host)
                self.blocks.append(now)
                if host is not None:
                    host.parts.append(now)
            now.parts.append(text)
            n = len(text.split())
            now.n += n
            now.link += n if stack[-1][4] else 0

        def close(depth):
            while len(stack) > depth:
                where[stack.pop()[0]].pop()

        def last(names):
            found = 0
            for t in names:
                if (of := where.get(t)) and of[-1] > found:
                    found = of[-1]
            return found

        tags = [""]
        while at < size:
            m = _TAG.search(page, at)
            if not m:
                flow(_html.unescape(page[at:]))
                break
            if m.start() > at:
                flow(_html.unescape(page[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            if m[4] != ">":
                break  # a tag that the end of the page cuts off
            tag = m[2].lower()
            inline = tag in INLINE
            if m[1]:
                if tag == "br":
                    flow(" ")
                    continue
                depth = last((tag,))
                over = depth and stack[-1][3] > stack[depth][3]  # block-level elements open inside it
                if inline and over:
                    depth = 0  # it would close a block around it
                if depth:
                    now = None if over or not inline else now
                    if inline and not over and stack[depth][6] is not stack[depth - 1][6]:
                        now, known = stack[depth][6]  # the text goes on behind the marked element, unless that held blocks
                        now = now if known == len(tags) else None
                    close(depth)
                elif not inline:
                    now = None
                continue
            if not inline:
                now = None
            if tag in VOID:
                if tag == "br" and now is not None:
                    flow(" ")
                elif tag == "input":
                    self._control(stack[-1][2])
                continue
            if tag in CLOSES_P or tag in SHUT:
                k = last(SHUT.get(tag, ("p",)))
                if k > last(STOP.get(tag, P_STOP)):
                    close(k)
            if tag in ("select", "textarea", "button"):
                self._control(stack[-1][2])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
                now = None if not inline else now
                continue
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])} if m[3] else {}
            if m[3] and "hidden" in m[3].lower().split():
                attrs["hidden"] = ""
            _, element, mark, opened, links, kinds, host = stack[-1]
            kind = marked(tag, attrs, kinds, inline) if attrs or tag in NEVER or tag in MAIN or tag in ("form", "header") else None
            if kind is not None:
                self.marks.append(Mark(kind, mark))
                mark = len(self.marks) - 1
                kinds = (kind, ARTICLE) if ARTICLE in kinds else (kind,)
                host = (now, len(tags)) if inline else None
                now = None  # also a marked inline element is a block of its own
            if not inline:
                self.parent.append(element)
                self.depth.append(self.depth[element] + 1)
                tags.append(tag)
                element = len(tags) - 1
            if not (m[3] and m[3].rstrip().endswith("/") and tag in ("svg", "path", "circle", "rect", "g", "use")):
                where.setdefault(tag, []).append(len(stack))
                stack.append((tag, element, mark, opened + (not inline), links + (tag == "a"), kinds, host if inline else None))
        for b in self.blocks:
            b.text = " ".join("".join(p for p in b.parts if isinstance(p, str)).split())
        self.blocks = [b for b in self.blocks if b.text]
        for b in self.blocks:
            while b.host is not None and not b.host.text:
                b.host = b.host.host
        for b in self.blocks:
            if b.mark >= 0:
                self.marks[b.mark].blocks += 1
                self.marks[b.mark].words += b.n
        for k in range(len(self.marks) - 1, -1, -1):  # an element comes after those around it
            m = self.marks[k]
            if m.up >= 0:
                up = self.marks[m.up]
                up.blocks, up.words, up.controls = up.blocks + m.blocks, up.words + m.words, up.controls + m.controls

    def _control(self, mark):
        if mark >= 0:
            self.marks[mark].controls += 1

    def distance(self, a: Block, b: Block) -> int:
        """Steps between the elements of two blocks in the tree, with one more to each block."""
        x, y, n = a.element, b.element, 2
        while x != y:
            if self.depth[x] >= self.depth[y]:
                x = self.parent[x]
            else:
                y = self.parent[y]
            n += 1
        return n

    def features(self) -> np.ndarray:
        """One row of FEATURES for each block."""
        return np.array([_text_features(b) for b in self.blocks]).reshape(-1, len(FEATURES))


def _text_features(b: Block) -> tuple:
    t, n = b.text, max(1, b.n)
    low, raw = t.lower(), t.encode("utf-8", "replace")
    size = len(raw)
    notice = sum(low.count(x) for x in _NOTICE)
    return 1.0, min(2.0, b.n / 15), b.link / n, float(t[-1] in ".!?…”\"»:;"), (size - len(raw.translate(None, _CAPITALS))) / size, (size - len(raw.translate(None, _DIGITS))) / size, min(1.0, 10 * notice / n)


def min_cut(n: int, source: list[float], sink: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which of n nodes stay with the source in a minimum cut (Dinic's algorithm; ties are undirected capacities)."""
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def edge(a, b, c, back=0.0):
        graph[a].append(len(to))
        to.append(b)
        cap.append(c)
        graph[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        # what flows straight through a node needs no search
        edge(s, i, max(0.0, source[i] - sink[i])) if source[i] > sink[i] else edge(i, t, sink[i] - source[i])
    for a, b, c in ties:
        edge(a, b, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(i for i, e in enumerate(path) if cap[e] <= eps)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(graph[u]):
                e = graph[u][at[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(graph[u]):
                path.append(graph[u][at[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def labels(page: Page, weights: np.ndarray) -> tuple[list[bool], np.ndarray]:
    """Which blocks the minimum cut leaves with the content, and the log-odds of each block's text alone."""
    blocks, marks, n = page.blocks, page.marks, len(page.blocks)
    alone = np.clip(page.features() @ weights, -BOUND, BOUND)
    total = max(1, sum(b.n for b in blocks))
    cost, ties, used = alone.tolist(), [], {}
    for k, m in enumerate(marks):
        if m.blocks:
            base = m.kind[1]
            if m.kind in (BAD, WEAK, FORM):
                base *= (1 - m.words / total) ** 2
            if m.kind is FORM:
                base *= min(1.0, 0.5 + 8 * m.controls / max(1, m.words))
            used[k] = len(cost)
            cost.append(base * (1 + m.blocks))
            if m.up >= 0 and m.kind is not ARTICLE:
                ties.append((used[k], used[m.up], NESTED * (1 + m.blocks)))
    last, before, places = {}, -1, {}
    for i, b in enumerate(blocks):
        places[id(b)] = i
        if b.mark >= 0:
            ties.append((i, used[b.mark], marks[b.mark].kind[2]))
        if b.host is not None:
            ties.append((places[id(b.host)], i, NEAR * APART))
            continue
        if before >= 0:
            a = blocks[before]
            ties.append((before, i, 2 * NEAR / page.distance(a, b) * (1.0 if a.mark == b.mark else APART)))
        before = i
        parent = page.parent[b.element], b.tag
        if (alike := last.get(parent)) is not None:
            ties.append((alike, i, ALIKE * (1.0 if blocks[alike].mark == b.mark else APART)))
        last[parent] = i
    return min_cut(len(cost), [max(0.0, x) for x in cost], [max(0.0, -x) for x in cost], ties)[:n], alone


def main_text(html: str, weights: np.ndarray = PRIOR) -> str:
    """The content blocks of a page, joined by empty lines; "" for a page without any."""
    page = Page(html)
    if not page.blocks:
        return ""
    for b, b.keep in zip(page.blocks, labels(page, weights)[0], strict=True):
        pass
    return "\n\n".join(b.whole() for b in page.blocks if b.keep and b.host is None)


def sure_blocks(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks whose nearest mark leaves no doubt: in an article, or in a menu, footer, sidebar, comment ... or advert."""
    page = Page(html)
    kinds = [page.marks[b.mark].kind if b.mark >= 0 else None for b in page.blocks]
    of = [i for i, k in enumerate(kinds) if k in (ARTICLE, SURE, COMMENT, BAD)]
    return page.features()[of], np.array([float(kinds[i] is ARTICLE) for i in of])


def newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log-loss of these rows."""
    p = 1 / (1 + np.exp(-x @ w))
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, rounds: int = 8) -> np.ndarray:
    """The classifier's weights: ridge regression towards PRIOR by Newton's method, on the sure blocks of about ``fit_pages`` pages chosen by a hash of
    page_id and url. The blocks stay on the executors; a round sends the sums of each task to the driver. Without sure blocks: PRIOR."""
    tune(pages.sparkSession)
    one_in = max(1, pages.select(F.lit(1)).count() // fit_pages)

    def run(batches):
        for b in batches:
            got = [sure_blocks(h) for h in b.column(0).to_pylist()]
            x, y = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

    chosen = pages.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(one_in)) == 0).select(F.col("html").cast("string").alias("html")).filter("html is not null")
    blocks = written(chosen.mapInArrow(run, "x binary, y binary").repartition(min(8, n_parts(pages.sparkSession))), "blocks")
    w, d = PRIOR.copy(), len(FEATURES)
    for _ in range(rounds):

        def sums(batches, w=w):
            g, h = np.zeros(d), np.zeros((d, d))
            for b in batches:
                for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    a, c = newton(np.frombuffer(x).reshape(-1, d), np.frombuffer(y), w)
                    g, h = g + a, h + c
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())], ["g", "h"])

        got = blocks.mapInArrow(sums, "g binary, h binary").collect()
        g = sum((np.frombuffer(r.g) for r in got), RIDGE * (w - PRIOR))
        h = sum((np.frombuffer(r.h).reshape(d, d) for r in got), RIDGE * np.eye(d))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    drop(blocks)
    return w


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """All ``pages`` (page_id, url, html) with the main ``text`` of the whole html and its ``n_chars`` (code points).

    ``weights`` of the text classifier are fitted on these pages where none are given. A null or empty html gives the empty text; repeated rows
    stay; an empty table gives an empty one; other columns are left out. Reading takes time in proportion to a page's length; the cut (Dinic's algorithm) has no such
    bound, though real pages, whose blocks are tied to a few others each, stay close to it. Page by page, so nothing is shuffled."""
    tune(pages.sparkSession)
    w = fit(pages) if weights is None else weights

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h, w))

    out = pages.select("page_id", "url", text(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op10_min_cut_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))
