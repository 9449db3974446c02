"""HTML main-text extraction with a tree-structured graphical model.

Every element of a page is a node with one of three states: boilerplate, content, or
mixed (an element around both).  A node's looks (kind of tag, names in class and id,
amount of own text, share of links) depend on its state, and its state depends on its
parent's.  Sum-product messages passed from the leaves to the root and back give each
node's content marginal, which sees the whole page.

Potentials are counted on labelled pages: pages whose markup names their article
(`article` or `main`) label themselves.  Fixed prior counts are mixed in, so that
looks that no labelled page shows, and pages without any such markup, are judged too.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.registry import query, read

BOILERPLATE, CONTENT, MIXED = range(3)
# Labelled pages a model is fitted on (an expected number, taken by a hash of the id).
FIT_PAGES = 5_000
# Weight of the prior against what labelled pages show, for moves and for looks.  Looks of
# labelled pages may come from one template: they count as much as the prior.
PRIOR_MOVES, PRIOR_LOOKS = 0.2, 0.5

# --- Fixed values of HTML -------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Never shown as text of the page.
HIDDEN = frozenset(
    "annotation audio button canvas datalist head iframe map noframes noscript object option "
    "script select style svg template textarea title video".split()
)
# Of these, the ones that do not nest: a further start ends the one before.
FLAT = frozenset("button datalist head noscript option select".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
# May stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
# Part of the running text around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo "
    "mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover nobr q rb rp rt rtc ruby s samp "
    "semantics small span strike strong sub sup time tt u var".split()
)
CHROME_TAGS = frozenset("aside dialog fieldset footer form header menu nav".split())
# An element ends where one of these starts.
ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
# ... unless one of these lies between.
SCOPES = frozenset("ul ol dl table div article section aside nav header footer main form body td th".split())
# Words in class, id and role that name boilerplate, or the article.
CHROME_WORDS = frozenset(
    "ad adbox ads adsense adslot adunit advert advertisement adverts advertising alert banner breadcrumb "
    "breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus feedback footer "
    "form gdpr header masthead menu menubar modal nav navbar navigation navlinks newsletter notice notices overlay "
    "pager pagination popup privacy promo promoted rail reactions recommended related reply replies respond "
    "responses search share sharing sidebar sidebars sidenav signup skip skyscraper social sponsor sponsored "
    "subnav subscribe tags toast toolbar tooltip topbar topnav widget widgets".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main maintext post story text".split())
# --------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

BREAK = None
# What the names of an element say: nothing (0), boilerplate, article, or boilerplate on what holds most of the page.
NAMED_CHROME, NAMED_CONTENT, NAMED_AROUND = 1, 2, 3
# Share of the running text that a wrapper without headings holds.
WRAPPER_ALONE = 0.8


class Page:
    """Nodes of a page in page order (a parent before its children) and its text runs."""

    def __init__(self, html: str | None):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.hint: list[int] = [0]  # NAMED_CHROME, NAMED_CONTENT, NAMED_AROUND or 0
        self.words: list[int] = [0]  # own words, those in links apart
        self.linked: list[int] = [0]
        self.runs: list[tuple[int, str | None]] = []  # (node, text), or BREAK between blocks
        self._open = Counter()  # open elements by tag
        self._read(html or "")
        self._widen()

    def _widen(self) -> None:
        """Tell names of boilerplate on wrappers (`search-enabled`) from those on menus and comments.

        An element with such a name that holds at least half of the page's running text is
        around the article if it is an `article` or `main`, or holds a heading of the page's
        highest level; without any heading it must hold WRAPPER_ALONE of the text.
        """
        if NAMED_CHROME not in self.hint:
            return
        level = {f"h{k}": k for k in range(1, 7)}
        text = list(self.words)
        best = [level.get(t, 9) for t in self.tag]
        for i in range(len(text) - 1, 0, -1):
            text[self.parent[i]] += text[i]
            best[self.parent[i]] = min(best[self.parent[i]], best[i])
        for i, named in enumerate(self.hint):
            if named != NAMED_CHROME or self.tag[i] in CHROME_TAGS or 2 * text[i] < text[0] or not text[i]:
                continue
            least = WRAPPER_ALONE if best[0] == 9 and self.tag[i] not in ("article", "main") else 0.5
            titled = self.tag[i] in ("article", "main") or best[i] == best[0]
            if titled and text[i] >= least * text[0]:
                self.hint[i] = NAMED_AROUND

    def _read(self, html: str) -> None:
        open_: list[tuple[str, int]] = [("#root", 0)]  # every open element with its node
        hidden: list[str] = []
        inside: list[str] = []  # open elements within the hidden one
        loose = False  # the hidden element has no end tag of its own
        ends: dict[str, int] = {}
        links = 0
        at = 0
        while True:
            m = _TOKEN.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if hidden == ["head"] and text.strip():
                hidden.clear()
            if text and not hidden:
                text = unescape(text)
                node = open_[-1][1]
                if self.tag[node] in STRUCTURE:
                    node = self._loose(node, text)
                self.runs.append((node, text))
                count = self.linked if links else self.words
                count[node] += len(text.split())
            if m is None:
                return
            at = m.end()
            closing, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW and not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if hidden:
                if tag == "body" and not closing:  # a head that was never closed
                    hidden.clear()
                elif hidden[-1] == "head":
                    if closing and tag == "head":
                        hidden.pop()
                        continue
                    if not closing and tag not in IN_HEAD:
                        hidden.pop()
                    elif not closing and tag in HIDDEN and tag != "head":
                        hidden.append(tag)
                        inside, loose = [], self._unclosed(html, at, tag, ends)
                elif closing and tag == hidden[-1]:
                    hidden.pop()
                    continue
                elif closing and tag in inside:
                    del inside[len(inside) - 1 - inside[::-1].index(tag) :]
                elif closing and tag not in INLINE and (tag == "head" or self._open[tag]):
                    hidden.clear()  # the element around it ends
                elif not closing and loose and tag in ENDS_P:
                    hidden.clear()
                elif not closing and tag == hidden[-1] and tag not in FLAT:
                    hidden.append(tag)
                elif not closing and tag == hidden[-1]:
                    inside, loose = [], self._unclosed(html, at, tag, ends)
                elif not closing and tag not in VOID and not attributes.rstrip().endswith("/"):
                    inside.append(tag)
                if hidden or (closing and tag == "head"):
                    continue
            if closing:
                links -= self._close(open_, {tag}, tag == "p")
                continue
            if tag == "br" or tag == "hr":
                self.runs.append((open_[-1][1], " "))
            if tag in VOID:
                if tag not in INLINE and tag not in ("br", "wbr", "img"):
                    self.runs.append((0, BREAK))
                continue
            if tag in HIDDEN:
                if not attributes.rstrip().endswith("/"):
                    hidden.append(tag)
                    inside, loose = [], self._unclosed(html, at, tag, ends)
                continue
            if tag in ENDS_P:
                links -= self._close(open_, {"p"}, True)
            if tag in SIBLINGS:
                links -= self._close(open_, SIBLINGS[tag], True)
            hint = self._hint(tag, attributes)
            node = open_[-1][1]
            if tag not in INLINE or hint:
                if tag not in INLINE:
                    self.runs.append((node, BREAK))
                node = self._add(node, tag, hint)
            links += tag == "a"
            open_.append((tag, node))
            self._open[tag] += 1

    @staticmethod
    def _unclosed(html: str, at: int, tag: str, ends: dict[str, int]) -> bool:
        """No end tag follows, or none before the next start of an element that does not nest.

        ``ends`` remembers the next place of each tag, so a page is searched once.
        """

        def following(mark: str) -> int:
            if ends.get(mark, -1) < at:
                found = re.compile(rf"{mark}(?![^\s/>])", re.I).search(html, at)
                ends[mark] = found.start() if found else len(html)
            return ends[mark]

        end = following(f"</{tag}")
        return end == len(html) or (tag in FLAT and following(f"<{tag}") < end)

    def _loose(self, above: int, text: str) -> int:
        """Node for text right below the page's root or body: one for each block."""
        if not text.strip():
            return above
        if self.runs and self.runs[-1][1] is not BREAK and self.tag[self.runs[-1][0]] == "#text":
            return self.runs[-1][0]
        return self._add(above, "#text", 0)

    def _add(self, above: int, tag: str, hint: int) -> int:
        self.parent.append(above)
        self.tag.append(tag)
        self.hint.append(hint)
        self.words.append(0)
        self.linked.append(0)
        return len(self.parent) - 1

    def _close(self, open_: list[tuple[str, int]], tags: set[str], scoped: bool) -> int:
        """Close the innermost open element of ``tags`` and all within; returns the links closed."""
        if not any(self._open[tag] for tag in tags):
            return 0
        for i in range(len(open_) - 1, 0, -1):
            tag = open_[i][0]
            if tag in tags:
                gone = open_[i:]
                del open_[i:]
                self._open.subtract(t for t, _ in gone)
                if any(t not in INLINE for t, _ in gone):
                    self.runs.append((open_[-1][1], BREAK))
                return sum(t == "a" for t, _ in gone)
            if scoped and tag in SCOPES:
                break
        return 0

    @staticmethod
    def _hint(tag: str, attributes: str) -> int:
        if "=" not in attributes or tag in ("html", "body"):
            return 0
        found = 0
        for value in _NAMES.findall(attributes):
            parts = set(_PART.findall(_CAMEL.sub(" ", "".join(value)).lower()))
            if parts & CHROME_WORDS and not parts & {"has", "no", "with", "without"}:
                return NAMED_CHROME
            if parts & CONTENT_WORDS and tag not in INLINE:
                found = NAMED_CONTENT
        return found


STRUCTURE = frozenset(("#root", "html", "body"))
GROUPS = {"#text": 2, "article": 1, "main": 1, "p": 2, "blockquote": 2, "pre": 2, "figcaption": 2, "li": 3, "dd": 3, "dt": 3}
GROUPS |= {f"h{i}": 4 for i in range(1, 7)} | {t: 5 for t in CHROME_TAGS} | {"#root": 6, "html": 6, "body": 6}
GROUPS |= {"td": 7, "th": 7, "tr": 7, "table": 7, "tbody": 7, "thead": 7, "tfoot": 7, "ul": 8, "ol": 8, "dl": 8}
# Kinds whose own words tell nothing: items, headings and cells are short in articles too.
SHORT = (3, 4, 7, 8)
# Values of each look: kind of tag (0: others) with share of links, names, own words.
LINKS = 4
LOOKS = (9 * LINKS, 4, 6)


def looks(page: Page) -> np.ndarray:
    """(nodes, len(LOOKS)) of small numbers."""
    words, linked = np.array(page.words), np.array(page.linked)
    total = words + linked
    # Words and links of whole subtrees: children come after their parents.
    deep, deep_linked = total.astype(float), linked.astype(float)
    for i in range(len(total) - 1, 0, -1):
        deep[page.parent[i]] += deep[i]
        deep_linked[page.parent[i]] += deep_linked[i]
    density = deep_linked / np.maximum(deep, 1)
    kind = np.array([GROUPS.get(t, 0) for t in page.tag])
    return np.stack(
        [
            kind * LINKS + np.digitize(density, [0.01, 0.34, 0.8]),
            page.hint,
            np.where(np.isin(kind, SHORT), 5, np.digitize(total, [1, 6, 21, 60])),
        ],
        axis=1,
    )


def labels(page: Page) -> np.ndarray | None:
    """States of a page that labels itself: one outermost `article` or `main`; else None."""
    n = len(page.parent)
    state = np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    tops = []
    for i in range(1, n):
        above = page.parent[i]
        marked = page.tag[i] in ("article", "main") and page.hint[i] != NAMED_CHROME
        chrome = page.tag[i] in CHROME_TAGS or page.hint[i] == NAMED_CHROME
        if not inside[above] and marked and state[above] != -1:
            tops.append(i)
        inside[i] = (inside[above] or marked) and not chrome
        state[i] = CONTENT if inside[i] else BOILERPLATE
    if len(tops) != 1:
        return None
    for top in tops:
        while (top := page.parent[top]) >= 0:
            state[top] = MIXED
    state[0] = MIXED
    return state


def _prior() -> tuple[np.ndarray, list[np.ndarray]]:
    """Prior potentials: parent to child, and looks by state, each row adding up to 1.

    Tags and names of boilerplate are impossible for content and for what is around it: no
    amount of running text inside, such as a thousand comments, outweighs them.  A name on an element that
    holds most of the page (NAMED_AROUND) is a look of its own, and says wrapper rather than menu.
    """
    moves = np.array([[0.9985, 0.0005, 0.001], [0.05, 0.945, 0.005], [0.3, 0.4, 0.3]])
    never = 0.0
    tag = np.array(
        # other, article, text, item, heading, chrome, page, cell, list
        [
            [30, 0.3, 15, 15, 5, 20, 0.2, 6, 8],
            [20, 8, 38, 12, 10, never, 0.2, 6, 6],
            [50, 2, 1, 1, 0.5, never, 42, 3, 0.5],
        ]
    )
    links = np.array([[32, 8, 15, 45], [78, 16, 4, 2], [40, 45, 10, 5]])
    hint = np.array([[70, 28, 1, 1], [82, never, 16, 2], [60, never, 16, 24]])
    words = np.array([[30, 33, 9, 2, 1, 25], [19, 9, 14, 16, 17, 25], [70, 2, 1, 1, 1, 25]])
    kinds = (tag[:, :, None] * links[:, None, :]).reshape(3, -1)
    return moves, [t / t.sum(axis=1, keepdims=True) for t in (kinds, hint, words)]


@dataclass
class Model:
    moves: np.ndarray  # log potential of (parent state, child state)
    looks: list[np.ndarray]  # log probability of each look by state


def model_of(moves: np.ndarray, counts: list[np.ndarray]) -> Model:
    """Counts of labelled pages with the prior mixed in; no counts leave the prior."""
    prior_moves, prior_looks = _prior()
    words = counts[2].astype(float)
    words[:, 5] = words[:, :5].sum(axis=1) / 3  # not judged: as likely in every state
    counts = [counts[0], counts[1], words]

    def mix(n, prior, weight):
        total = n.sum(axis=1, keepdims=True)
        share = np.where(total > 0, weight, 1.0)
        with np.errstate(divide="ignore"):  # impossible looks are minus infinity
            return np.log(share * prior + (1 - share) * n / np.maximum(total, 1))

    return Model(
        mix(moves, prior_moves, PRIOR_MOVES),
        [mix(n, p, PRIOR_LOOKS) for n, p in zip(counts, prior_looks)],
    )


def _tally(pages) -> np.ndarray:
    """Flat counts over labelled pages: moves, then each look."""
    moves = np.zeros((3, 3), np.int64)
    counts = [np.zeros((3, n), np.int64) for n in LOOKS]
    for html in pages:
        page = Page(html)
        state = labels(page)
        if state is None:
            continue
        np.add.at(moves, (state[page.parent[1:]], state[1:]), 1)
        seen = looks(page)
        for k, n in enumerate(counts):
            np.add.at(n, (state, seen[:, k]), 1)
    return np.concatenate([moves.ravel(), *[n.ravel() for n in counts]])


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html", n_pages: int = FIT_PAGES) -> Model:
    """Potentials from about ``n_pages`` pages; those that do not label themselves add nothing.

    The tasks add up counts; the driver receives one number per look and state.
    """
    slim = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{html}`").alias("html"))
    units = 1_000_000
    rate = min(units, -(-n_pages * units // max(slim.count(), 1)))
    sample = slim.filter(F.pmod(F.xxhash64("id", F.lit("html")), F.lit(units)) < rate)

    def count(batches):
        for batch in batches:
            flat = _tally(x.as_py() for x in batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "n"]
            )

    rows = sample.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(9 + 3 * sum(LOOKS), np.int64)
    for r in rows:
        flat[r["place"]] = r["n"]
    stops = np.cumsum([9, *[3 * n for n in LOOKS]])
    parts = np.split(flat, stops[:-1])
    return model_of(parts[0].reshape(3, 3), [p.reshape(3, -1) for p in parts[1:]])


def marginals(page: Page, model: Model) -> np.ndarray:
    """(nodes, 3) state probabilities by sum-product over the tree."""
    seen, n = looks(page), len(page.parent)
    local = sum(table[:, seen[:, k]].T for k, table in enumerate(model.looks))
    local = np.exp(local - local.max(axis=1, keepdims=True))
    local[0] = (0.0, 0.0, 1.0)  # the root is around everything
    # Three states and a few dozen nodes: plain numbers are faster than small arrays.
    (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = np.exp(model.moves).tolist()
    up = local.tolist()  # product of a node's looks and its children's messages
    sent: list = [None] * n
    parent = page.parent
    for i in range(n - 1, 0, -1):
        x, y, z = up[i]
        top = max(x, y, z, 1e-300)  # many children: keep the product in range
        x, y, z = x / top, y / top, z / top
        up[i] = (x, y, z)
        sent[i] = message = (
            a0 * x + a1 * y + a2 * z, b0 * x + b1 * y + b2 * z, c0 * x + c1 * y + c2 * z,
        )
        u = up[parent[i]]
        up[parent[i]] = (u[0] * message[0], u[1] * message[1], u[2] * message[2])
        top = max(up[parent[i]])
        if top < 1e-200:
            up[parent[i]] = tuple(v / max(top, 1e-300) for v in up[parent[i]])
    belief: list = [None] * n
    belief[0] = (0.0, 0.0, 1.0)
    for i in range(1, n):
        # What the parent believes without this node.
        p, q, r = (v / m for v, m in zip(belief[parent[i]], sent[i]))
        x, y, z = up[i]
        x, y, z = x * (p * a0 + q * b0 + r * c0), y * (p * a1 + q * b1 + r * c1), z * (p * a2 + q * b2 + r * c2)
        total = x + y + z
        belief[i] = (x / total, y / total, z / total)
    return np.array(belief)


def extract(html: str | None, model: Model) -> tuple[str, list[tuple[str, float]]]:
    """(main text, [(block text, content marginal)] of all blocks in page order).

    White space inside a block becomes one space; blocks are joined by one space.
    """
    page = Page(html)
    content = marginals(page, model)[:, CONTENT]
    kept: list[str] = []
    blocks: list[tuple[str, float]] = []
    block: list[tuple[int, str]] = []
    for node, text in [*page.runs, (0, BREAK)]:
        if text is not BREAK:
            block.append((node, text))
            continue
        whole = " ".join("".join(t for _, t in block).split())
        if whole:
            blocks.append((whole, float(content[block[0][0]])))
            kept.append(" ".join("".join(t for at, t in block if content[at] > 0.5).split()))
        block = []
    return " ".join(filter(None, kept)), blocks


def main_text(
    pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(page_id, url, text, blocks array<struct<text,content>>), one row per row of ``pages``.

    Null and empty html give an empty text without blocks; html without any tag is one
    block; unclosed and stray tags are read as browsers do.  Other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    block_type = pa.list_(pa.struct([("text", pa.string()), ("content", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [extract(x.as_py(), shared.value) for x in batch.column(2)]
            blocks = [[{"text": t, "content": c} for t, c in b] for _, b in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([t for t, _ in found], pa.string()),
                    pa.array(blocks, block_type),
                ],
                names=["page_id", "url", "text", "blocks"],
            )

    slim = pages.select(*[F.col(f"`{c}`") for c in (page_id, url, html)])
    return slim.mapInArrow(
        run,
        f"page_id {kinds[0]}, url {kinds[1]}, text string, blocks array<struct<text:string,content:double>>",
    )


@query("op2_html_main_text")
def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages")
    return main_text(pages, fit(pages)).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )
