"""Main text of web pages by tree scoring.

Every block of running text passes points (one, plus its commas, plus up to three for its length) up
to its ancestors, less with distance and less again by the share of its characters inside links.
Semantic containers start with a bonus. The best container is kept, together with those siblings that
read as text themselves.

Elements that are furniture (menus, page headers, footers, sidebars, notices, adverts, forms, comments)
give and keep nothing. Tags, roles and reader comments are enough for that; class names and ids count
only as whole words, and not for an element without which no article, main element or running text would
be left. Time and memory are linear in the page, however deep it is.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import map_batches, text_of

_ATTRS = r"""((?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)"""
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)" + _ATTRS + r"(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""", re.I)
_RAW = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_FURNITURE = frozenset("nav footer aside form menu dialog button select option input fieldset svg math canvas audio video object embed head search".split())
_FURNITURE_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Names that make an element furniture, where a class word or id consists of them and of the plain words below.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs cookie cookies consent gdpr footer foot masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promos promoted promotion recommended related share sharing sidebar sidebars social sponsor sponsored subscribe signup toolbar topbar widget widgets login skiplink".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
_PLAIN = frozenset(
    "site page main global primary secondary top bottom left right upper lower box bar list block area section wrapper wrap container inner outer link links item items col column panel post posts article articles story stories entry blog user users reader readers button buttons icon icons form text message messages slot unit wide small big mobile desktop fixed sticky thread js".split()
)
#: Characters outside links from which on a block, but for a heading, counts as running text.
PROSE = 40
_PAGE_HEADER = frozenset("header siteheader pageheader top".split())
#: Class words of containers that hold articles whatever else they are called.
_CONTENT = frozenset("content layout article entry-content post-content article-content article-body page-content main-content story-body".split())
_START = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "body": 0.0}
#: What an opening tag closes, when that is open inside the nearest of the tags named second.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}


def _called(attrs: str, inside: bool) -> int:
    """2 if an element's attributes make it no part of an article, 1 if only its class or id does, else 0; inside: an article or main element is open."""
    soft = False
    for key, *values in _NAMED.findall(attrs):
        value = "".join(values)
        key = key.lower()
        if key in ("class", "id"):
            tokens = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split()
            if any(t in _CONTENT for t in tokens):
                continue
            for token in tokens:
                parts = [x for x in re.split(r"[^a-z]+", token) if x]
                named = [x for x in parts if x in _NAMES or x in _COMMENTS or not inside and x in _PAGE_HEADER]
                if named and all(x in named or x in _PLAIN or len(x) == 1 for x in parts):
                    if any(x in _COMMENTS for x in named):
                        return 2
                    soft = True
        elif key == "role":
            if value.lower() in _FURNITURE_ROLE:
                return 2
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return int(soft)


class _Page:
    """Elements of a page as parallel lists, in page order, and its blocks as (element, text, characters inside links)."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent = ["#"], [-1]
        self._hard, self._soft = [False], [False]
        self._link, self._inside, self._block = [False], [False], [0]  # in a link, in an article; the nearest block element
        self._stack, self._open, self._blocks_at = [0], {}, [0]  # open elements, places in the stack by tag, and of block elements
        self._pieces: list[list[tuple[int, str]]] = [[]]
        self._parse(source)
        self._assemble()

    def _cut(self, place: int) -> None:
        """Closes all elements from a place of the stack on."""
        while len(self._stack) > place:
            k = self._stack.pop()
            self._open[self.tag[k]].pop()
            if self.tag[k] in _BLOCK:
                self._blocks_at.pop()

    def _at(self, tags) -> int:
        """The highest place in the stack of any of the tags; 0 if none is open."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _flush(self) -> None:
        if self._pieces[-1]:
            self._pieces.append([])

    def _close(self, names, until) -> None:
        place = self._at(names)
        if place and place > self._at(until):
            self._flush()
            self._cut(place)

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _MARKUP.search(source, at)
            self._say(source[at : m.start() if m else n])
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in _RAW:
                end = _RAW[tag].search(source, at)
                at = n if end is None else end.start()
            elif tag == "br":
                self._say(" ")
            else:
                self._begin(tag, m[3])

    def _say(self, text: str) -> None:
        k = self._stack[-1]
        if text and not self._hard[k]:
            self._pieces[-1].append((k, html.unescape(text) if "&" in text else text))

    def _end(self, tag: str) -> None:
        place = self._at((tag,))
        barrier = 0 if tag in _BLOCK else self._blocks_at[-1]
        if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
            barrier = max(barrier, self._at(("td", "th")) if tag not in ("td", "th") else 0)
        if place and place >= barrier:
            if self._blocks_at[-1] >= place:
                self._flush()
            self._cut(place)

    def _begin(self, tag: str, attrs: str) -> None:
        if tag in _BLOCK:
            if tag in _CLOSES:
                self._close(*_CLOSES[tag])
            elif tag != "option":
                self._close(("p",), ("td", "th", "button", "table") if tag != "table" else ("td", "th"))
            self._flush()
        if tag in _VOID:
            return
        if tag == "a" and self._open.get("a") and self._open["a"][-1] > self._blocks_at[-1]:
            self._flush()
            self._cut(self._open["a"][-1])
        up, k = self._stack[-1], len(self.tag)
        inside = self._inside[up]
        kind = _called(attrs, inside) if attrs else 0
        self.tag.append(tag)
        self.parent.append(up)
        self._hard.append(self._hard[up] or tag in _FURNITURE or tag == "header" and not inside or kind == 2)
        self._soft.append(kind == 1 and tag not in ("html", "body", "article", "main"))
        self._link.append(self._link[up] or tag == "a")
        self._inside.append(inside or tag in ("article", "main"))
        self._block.append(k if tag in _BLOCK else self._block[up])
        if not attrs.rstrip().endswith("/") or tag in _BLOCK or tag == "a":
            self._open.setdefault(tag, []).append(len(self._stack))
            if tag in _BLOCK:
                self._blocks_at.append(len(self._stack))
            self._stack.append(k)

    def _assemble(self) -> None:
        kept = self._kept_furniture()
        drop = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            drop[k] = drop[self.parent[k]] or self._soft[k] and k not in kept
        self.blocks = []
        for pieces in self._pieces:
            kept = [(k, text) for k, text in pieces if not drop[k]]
            text = " ".join("".join(t for _, t in kept).split())
            if text:
                self.blocks.append((self._block[kept[-1][0]], text, min(sum(len(t) for k, t in kept if self._link[k]), len(text))))

    def _kept_furniture(self) -> set[int]:
        """Elements that are furniture by class or id alone but hold the article, as nothing outside such elements does.

        From the root down: elements so named are dropped where the rest holds an article or main element with
        text, or running text of its own that is longer than any article inside one of them. Else the one with
        the longest article, or else with the most running text, is no furniture, and the same is asked inside
        it. All sums are made in one pass over the elements.
        """
        n, tag, parent, soft = len(self.tag), self.tag, self.parent, self._soft
        chars, prose = [0] * n, [0] * n
        for pieces in self._pieces:
            said = sum(len(t) for k, t in pieces if not self._link[k])
            runs = pieces and said >= PROSE and tag[self._block[pieces[-1][0]]] not in _HEADINGS
            for k, text in pieces:
                size = 0 if text.isspace() else len(text)
                chars[k] += size
                prose[k] += size if runs and not self._link[k] else 0
        whole = self.summed(prose)
        every = self.summed(chars)
        article = [0] * n  # text of article and main elements in each one, outside of furniture and with it
        among = [0] * n
        longest, most, fullest = [(0, 0)] * n, [(0, 0)] * n, [(0, 0)] * n  # of the outermost furniture below: by article, running text, text
        for k in range(n - 1, -1, -1):
            if tag[k] in ("article", "main"):
                article[k], among[k] = chars[k], every[k]
            if k:
                up = parent[k]
                among[up] += among[k]
                if soft[k]:
                    longest[up], most[up], fullest[up] = max(longest[up], (among[k], -k)), max(most[up], (whole[k], -k)), max(fullest[up], (every[k], -k))
                else:
                    longest[up], most[up], fullest[up] = max(longest[up], longest[k]), max(most[up], most[k]), max(fullest[up], fullest[k])
                    chars[up] += chars[k]
                    prose[up] += prose[k]
                    article[up] += article[k]
        kept, k = set(), 0
        while not article[k]:
            if longest[k][0] > prose[k]:
                k = -longest[k][1]
            elif not prose[k] and most[k][0]:
                k = -most[k][1]
            elif not chars[k] and fullest[k][0]:
                k = -fullest[k][1]
            else:
                break
            kept.add(k)
        return kept

    def summed(self, values: list) -> list:
        """The values of every element with those of all below it."""
        out = list(values)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend summary".split())
_LEAVES = frozenset("p pre li blockquote h1 h2 h3 h4 h5 h6 td dd dt".split())


def _scores(page: _Page) -> list[float | None]:
    """Points of every element: those of its own blocks, a half of its children's, a sixth of those below and less from further on; None without any."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    own, child, below, far = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    reached = [False] * n
    for k, text, linked in page.blocks:
        to = parent[k] if tag[k] in _LEAVES else k
        own[to] += (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - linked / len(text))
        reached[to] = True
    for k in range(n - 1, 0, -1):
        up = parent[k]
        child[up] += own[k]
        below[up] += child[k]
        far[up] += below[k] / 9 + far[k] * 0.75
        reached[up] = reached[up] or reached[k]
    return [own[k] + child[k] / 2 + below[k] / 6 + far[k] + _START.get(tag[k], 0.0) if reached[k] else None for k in range(n)]


def main_text(source: str) -> str:
    """The article of one page: its blocks in page order, joined by two newlines."""
    page = _Page(source)
    if not page.blocks:
        return ""
    tag, parent = page.tag, page.parent
    score = _scores(page)
    chars, links = [0] * len(tag), [0] * len(tag)
    for k, text, linked in page.blocks:
        chars[k] += len(text)
        links[k] += linked
    chars, links = page.summed(chars), page.summed(links)
    density = [b / a if a else 0.0 for a, b in zip(chars, links, strict=True)]
    worth = [-1.0 if x is None else x * (1 - d) for x, d in zip(score, density, strict=True)]
    best = max(range(len(tag)), key=lambda k: (worth[k], -k))
    up = best
    while up > 0:
        if tag[up] in ("article", "main"):
            best = up
        up = parent[up]
    kept = [False] * len(tag)
    kept[best] = True
    if tag[best] not in ("body", "html", "#"):
        least = max(10.0, 0.2 * worth[best])
        for k in range(1, len(tag)):
            if parent[k] == parent[best] and chars[k]:
                prose = tag[k] == "p" and density[k] < 0.25 and chars[k] > 80
                title = tag[k] in ("h1", "h2") and k < best and density[k] < 0.25
                kept[k] = kept[k] or prose or title or worth[k] >= least
    for k in range(1, len(tag)):
        kept[k] = kept[k] or kept[parent[k]]
    return "\n\n".join(text for k, text, _ in page.blocks if kept[k])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    A null or empty html gives an empty text, as does a page without an article. Rows are
    independent: null ids, repeated rows, an empty table and further columns change nothing. Pages
    of any length are read whole.
    """

    def run(batch: pa.RecordBatch):
        texts = [main_text(x) for x in text_of(batch, "html").to_pylist()]
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) text")

    def renamed(batch: pa.RecordBatch):
        return run(batch.rename_columns(["page_id", "url", "html"]))

    return map_batches(rows, renamed, "page_id long, url string, text string, n_chars long")
