"""Operator 9: main text of web pages by tag-path ratios.

A page is read once into text blocks, each with its root-to-leaf tag path (classes included). Over the blocks, text length
outside links and punctuation are summed per tag path; the two ratios (per block of the path) are smoothed along the page,
fused by multiplication and averaged per path. What an element's name, role, class or id says (menus, headers, footers,
sidebars, notices, adverts, comments) is a prior on the score of the paths through it: strong for containers, weak for
paragraphs, list items and the like, where the ratios decide. Paths at or above a share of the best score are chosen.

The content element is the deepest that holds nearly all chosen text, if it stands in an ``article`` or ``main`` that
element; else the deepest that holds all of it, widened while that adds headings and paragraphs only. Its blocks are the
main text, short paragraphs, headings and lists of links too; only blocks below a named element whose paths do not reach the
threshold are left out, and on pages without a container of the text also lists that hold little but links. A name counts only
if all its words name parts of a page. Where it may mislead (``discussion``), a container with a heading and with prose that
would be chosen without the name stays. Reader comments are told by their structure too: siblings below the text that begin with
a short line of a name and a time.

Scripts, styles, forms and hidden elements are never read. Each page takes time in proportion to its length: ends of tags
are found once, and elements carry what their ancestors would tell.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import pieces

_TAG = re.compile(r"[A-Za-z][^\s/<>]*")
_END = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
HARD_TAGS = frozenset("form script style noscript template iframe object svg canvas button select textarea dialog head fieldset datalist audio video map".split())
STRONG_TAGS = frozenset("nav header footer aside menu".split())
STRONG_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WEAK_ROLES = frozenset("note status".split())
STRONG_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner "
    "banners cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login sidebar sidebars "
    "aside menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar footer comment comments commentlist replies "
    "disqus respond pagination pager paging toolbar topnav subnav sitenav mainnav mainmenu submenu megamenu adbox adslot adunit "
    "form share sharing social notification".split()
)
WEAK_NAMES = frozenset(
    "notice notices side rail header foot copyright legal reply discussion related recommended recommendations search "
    "disclaimer alert".split()
)
#: Words that name a part of a layout; with one of the names above they make a name, as in ``sidebar-left``.
PARTS = frozenset(
    "area bar block body bottom box col column component container content desktop fixed global group heading holder inner item items "
    "article blog entry js left link links list main mobile module outer page panel post primary reader readers region right row "
    "secondary section site slot small sticky story text title top unit user users widget wide wrap wrapper zone".split()
)
NEGATED = frozenset("has with no without not non".split())
KEEPERS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = frozenset("p li dt dd td th blockquote pre figcaption address".split())
NOT_CONTENT = frozenset(("p", "li", *HEADINGS))
#: Factors of a path's score: for a container that is named, and for one or for a paragraph whose name may mislead.
STRONG, WEAK = 1e-3, 0.2
SPREAD, HELD, LINKS = 0.25, 0.9, 0.8


class _Element:
    __slots__ = ("tag", "path", "hard", "prior", "parent", "holder", "inside", "level", "first", "last")

    def __init__(self, tag: str, path: int, hard: bool, prior: float, parent: _Element | None, first: int):
        self.tag, self.path, self.hard, self.prior, self.parent = tag, path, hard, prior, parent
        inline = tag in INLINE and parent is not None
        self.holder = parent.holder if inline else self  # the nearest element that is not inline
        self.level = (parent.level if parent else 0) + (not inline)  # how many such elements there are down to here
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.first, self.last = first, None  # the blocks within


class Block:
    __slots__ = ("element", "parts", "links", "text")

    def __init__(self, element: _Element):
        self.element, self.parts, self.links = element, [], 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(text)} if text else {}


def _hard(tag: str, attrs: dict[str, str]) -> bool:
    return tag in HARD_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")) is not None


def _prior(tag: str, attrs: dict[str, str], within: _Element) -> float:
    """What the element says of itself, as a factor of the scores of the paths through it."""
    if tag in INLINE:
        return 1.0
    role = attrs.get("role", "").lower()
    if tag in STRONG_TAGS or role in STRONG_ROLES:
        return STRONG
    if tag in HEADINGS or (tag in KEEPERS and not (tag == "article" and within.inside)):
        return 1.0
    found = WEAK if role in WEAK_ROLES else 1.0
    for value in (attrs.get("class", ""), attrs.get("id", "")):
        for token in value.split():
            names = {x.lower() for x in _NAMES.findall(token)}
            if not NEGATED.isdisjoint(names) or (within.inside and names & (STRONG_NAMES | WEAK_NAMES) == {"header"}):
                continue
            if not names <= STRONG_NAMES | WEAK_NAMES | PARTS:  # "related-work" is no "related"
                continue
            if not STRONG_NAMES.isdisjoint(names):
                found = min(found, WEAK if tag in TEXTUAL else STRONG)
            elif not WEAK_NAMES.isdisjoint(names):
                found = min(found, WEAK)
    return found


class _TagEnds:
    """Where tags end: at the first ``>`` outside quotes. What one search has passed, no later one passes again."""

    def __init__(self, page: str):
        self.page, self.known, self.seen = page, {}, (0, 0)

    def _next(self, at: int) -> int:
        a, b = self.seen
        if not a <= at <= b:
            m = _END.search(self.page, at)
            self.seen = (at, m.start() if m else len(self.page))
        return self.seen[1]

    def find(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``; -1 for a tag that never ends."""
        passed, end = [], -1
        while (spot := self._next(at)) < len(self.page):
            if spot in self.known:
                end = self.known[spot]
                break
            passed.append(spot)
            if self.page[spot] == ">":
                end = spot
                break
            close = self.page.find(self.page[spot], spot + 1)
            if close < 0:
                break
            at = close + 1
        for spot in passed:
            self.known[spot] = end
        return end


class _Stack:
    """Open elements, and where those of each tag stand."""

    def __init__(self, top: _Element):
        self.open, self.where = [top], {}

    def push(self, e: _Element) -> None:
        self.where.setdefault(e.tag, []).append(len(self.open))
        self.open.append(e)

    def last(self, tags) -> int:
        """The place of the innermost open element of some tags; 0 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def cut(self, k: int, blocks: int) -> int:
        """Close all from place ``k`` on; the number of links among them."""
        links = 0
        while len(self.open) > k:
            e = self.open.pop()
            self.where[e.tag].pop()
            e.last = blocks
            links += e.tag == "a"
        return links


def blocks(page: str) -> tuple[list[Block], _Element]:
    """Text blocks of a page in order (runs of text and inline markup between block-level tags), and the page's root."""
    top = _Element("", 0, False, 1.0, None, 0)
    stack, ends, out, block, links = _Stack(top), _TagEnds(page), [], None, 0
    paths: dict[tuple[int, str], int] = {}
    raw_ends: dict[str, re.Pattern] = {}
    at, end = 0, len(page)
    while at < end:
        text = tag = None
        if page[at] != "<":
            to = page.find("<", at)
            to = end if to < 0 else to
            text, at = page[at:to], to
        elif page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            at = end if to < 0 else to + 3
            continue
        elif page.startswith("<![CDATA[", at):
            to = page.find("]]>", at + 9)
            text, at = page[at + 9 : end if to < 0 else to], end if to < 0 else to + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            to = page.find(">", at)
            at = end if to < 0 else to + 1
            continue
        else:
            close = page[at + 1 : at + 2] == "/"
            m = _TAG.match(page, at + 1 + close)
            to = ends.find(m.end()) if m else -1
            if to < 0:  # no tag, or one that never ends: its "<" is text
                text, at = "<", at + 1
            else:
                tag, attributes, at = m[0].lower(), page[m.end() : to], to + 1
        above = stack.open[-1]
        if text is not None:
            if above.hard or (block is None and (not text or text.isspace())):
                continue
            if block is None:
                block = Block(above.holder)
                out.append(block)
            text = html.unescape(text)
            block.parts.append(text)
            if links:
                block.links += len(text)
            continue
        if close:
            k = stack.last((tag,))
            if tag not in INLINE:
                block = None
            elif k and above.level > stack.open[k].level:
                k = 0  # an inline end tag does not close blocks
            if k:
                links -= stack.cut(k, len(out))
            continue
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if tag not in INLINE:
            block = None
        if tag in VOID:
            continue
        if tag in CLOSES_P and (k := stack.last(("p",))) > stack.last(_P_STOPS):
            links -= stack.cut(k, len(out))
        if tag in SIBLINGS and (k := stack.last(SIBLINGS[tag][0])) > stack.last(SIBLINGS[tag][1]):
            links -= stack.cut(k, len(out))
        above = stack.open[-1]
        attrs = _attributes(attributes)
        if tag in RAW:
            if tag not in raw_ends:
                raw_ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)
            m = raw_ends[tag].search(page, at)
            at = page.find(">", m.end()) + 1 or end if m else end
            continue
        if attributes.endswith("/") and tag in ("svg", "path", "g"):
            continue
        prior = above.prior * _prior(tag, attrs, above)
        if tag in HEADINGS and above.tag == "header" and above.parent.inside:
            prior = above.parent.prior  # the heading in an article's header is the article's title
        name = attrs.get("class", "").split()
        path = paths.setdefault((above.path, f"{tag}.{name[0]}" if name else tag), len(paths) + 1)
        stack.push(_Element(tag, path, above.hard or _hard(tag, attrs), prior, above, len(out)))
        links += tag == "a"
    stack.cut(1, len(out))
    top.last = len(out)
    return out, top


_P_STOPS = ("button", "table", "td", "th", "object", "article", "section", "div", "li")


def _smoothed(x: np.ndarray) -> np.ndarray:
    if len(x) < 3:
        return x
    padded = np.concatenate([x[:1], x, x[-1:]])
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def path_scores(path: np.ndarray, size: np.ndarray, links: np.ndarray, marks: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """For each block the score of its path: sums of text outside links and of punctuation per path, over the path's
    blocks; both ratios smoothed along the page and fused; the path's mean of that, times its prior."""
    _, which = np.unique(path, return_inverse=True)
    n = np.bincount(which)
    text = _smoothed((np.bincount(which, size - links) / n)[which])
    stops = _smoothed((np.bincount(which, marks) / n)[which])
    return (np.bincount(which, text * (1 + stops)) / n)[which] * prior


class _Kept:
    """The blocks with text of a page, by their place in the page."""

    def __init__(self, page: str):
        found, self.top = blocks(page)
        self.blocks: list[Block] = []
        before = [0]  # how many kept blocks come before each block
        for b in found:
            b.text = " ".join("".join(b.parts).split())
            if b.text:
                self.blocks.append(b)
            before.append(len(self.blocks))
        self.before = before

    def span(self, e: _Element) -> tuple[int, int]:
        return self.before[e.first], self.before[e.last]


def _widened(kept: _Kept, content: _Element, chosen: np.ndarray, plain: np.ndarray) -> _Element:
    """The highest element above ``content`` that adds nothing but chosen text, headings, paragraphs and single lines
    beside it. Lists of links, named elements and text that stands in containers of its own end the climb."""
    while (above := content.parent) is not None:
        (a, b), (i, j) = kept.span(above), kept.span(content)
        line = above.tag not in ("", "html", "body")
        for k in (*range(a, i), *range(j, b)):
            e = kept.blocks[k]
            prose = e.element.tag == "p" or e.element.tag in HEADINGS or (line and (e.element is above or e.element.parent is above))
            if not chosen[k] and not (prose and plain[k] and e.links < LINKS * len(e.text)):
                return content
        content = above
    return content


def _spared(kept: _Kept, content: _Element, raw: np.ndarray, prior: np.ndarray, size: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Blocks in containers of the content that a weak name sets back, but that have a heading and prose like the rest: by
    the ratios alone their blocks would be chosen on the average."""
    out, known = np.zeros(len(prior), bool), {}
    a, b = kept.span(content)
    best = raw[a:b][prior[a:b] >= 1].max(initial=0)
    for k in range(a, b):
        if not STRONG < prior[k] < 1:
            continue
        e = kept.blocks[k].element
        while e.parent is not None and e.parent is not content and e.parent.prior < 1:
            e = e.parent
        if id(e) not in known:
            i, j = kept.span(e)
            prose = np.array([x.element.tag not in HEADINGS for x in kept.blocks[i:j]])
            alike = 0 < prose.sum() < j - i and raw[i:j][prose].mean() >= SPREAD * best
            known[id(e)] = alike and e.tag not in TEXTUAL and links[i:j].sum() < 0.5 * size[i:j].sum()
        out[k] = known[id(e)]
    return out


#: How times are written in a comment's line.
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_TIME = re.compile(
    r"\b(?:\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|(?:\d+|an?|one) (?:second|minute|min|hour|hr|day|week|month|year)s? ago|just now|yesterday"
    rf"|{_MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?\b|\d{{1,2}}\.? {_MONTH})",
    re.I,
)
NAME_LINE, COMMENT = 60, 1000


def _comments(kept: _Kept, content: _Element, weight: np.ndarray) -> np.ndarray:
    """Blocks of reader comments within the content: two or more siblings without headings, of moderate length, each of which
    begins with a short line that is no sentence and has a time near its begin or at its end. They are most of what stands in their
    parent and come after half of the chosen text; the heading right before them goes too."""
    out = np.zeros(len(kept.blocks), bool)
    a, b = kept.span(content)
    seen, below = {}, {}
    length = np.concatenate([[0], np.cumsum([len(x.text) for x in kept.blocks])])
    for k in range(a, b):
        e = kept.blocks[k].element
        while e is not content and e.parent is not None and id(e) not in seen:
            seen[id(e)] = e
            below.setdefault(id(e.parent), []).append(e)
            e = e.parent

    def alike(e: _Element) -> bool:
        i, j = kept.span(e)
        first, last = kept.blocks[i : min(i + 4, j)], kept.blocks[j - 1]
        if j - i < 2 or any(x.element.tag in HEADINGS for x in first):
            return False
        name = first[0].text
        if len(name) > NAME_LINE or name[-1] in ".!?" and len(name.split()) > 3:
            return False
        lines = [x.text for x in (*first[:3], last) if len(x.text) <= NAME_LINE]
        return any(_TIME.search(x) for x in lines) and length[j] - length[i] <= COMMENT * (j - i)

    for children in below.values():
        found = [e for e in children if alike(e)]
        if len(found) < 2 or len({e.tag for e in found}) > 1:
            continue
        parent = found[0].parent
        i, j = (kept.span(found[0])[0], kept.span(found[-1])[1]) if parent is content else kept.span(parent)
        held = sum(y - x for x, y in map(kept.span, found))
        if held < 0.6 * (j - i) or 2 * (weight[i] - weight[a]) < (weight[b] - weight[a]) - (weight[j] - weight[i]):
            continue
        if i > a and kept.blocks[i - 1].element.tag in HEADINGS:
            i -= 1
        out[i:j] = True
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; empty for a page that has none."""
    kept = _Kept(page or "")
    own = kept.blocks
    if not own:
        return ""
    size = np.array([len(b.text) for b in own], dtype=float)
    links = np.minimum([b.links for b in own], size)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in own], dtype=float)
    path = np.array([b.element.path for b in own])
    prior = np.array([b.element.prior for b in own])
    plain = prior >= 1
    if not (prior > STRONG).any():
        return ""
    inside = np.where([b.element.inside for b in own], 2.0, 1.0)
    scores = path_scores(path, size, links, marks, prior * inside)
    chosen = scores >= SPREAD * scores[prior > STRONG].max()
    weight = np.concatenate([[0], np.cumsum(np.where(chosen, size, 0))])
    at = np.flatnonzero(chosen)

    def deepest(share: float) -> _Element:
        """The deepest element that holds so much of the chosen text: above the block in its middle, as it holds that."""
        e = own[int(np.searchsorted(weight, weight[-1] / 2))  - 1].element if share < 1 else own[at[0]].element
        while e.parent is not None:
            a, b = kept.span(e)
            whole = a <= at[0] and at[-1] < b if share == 1 else weight[b] - weight[a] >= share * weight[-1]
            if whole and e.tag not in NOT_CONTENT:
                break
            e = e.parent
        return e

    content, e = None, deepest(HELD)
    main = None
    while e is not None:
        if e.tag == "article" and e.prior >= 1:
            content = content or e
        elif e.tag == "main":
            main = main or e
        e = e.parent
    content = content or main or _widened(kept, deepest(1), chosen, plain)
    a, b = kept.span(content)
    out = chosen | plain | _spared(kept, content, path_scores(path, size, links, marks, inside), prior, size, links)
    out &= ~_comments(kept, content, weight)
    if content.tag in ("", "html", "body"):  # no container of the text: lists of links are menus
        _, which = np.unique(path, return_inverse=True)
        out &= chosen | (np.bincount(which, links)[which] < LINKS * np.bincount(which, size)[which])
    return "\n".join(own[k].text for k in range(a, b) if out[k])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: ``page_id, url, text, n_chars``.

    Null or empty html, and a page without main text, give an empty text. Repeated rows repeat. Markup that never ends
    is closed by the end of the page. Further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html"):
                texts = [main_text(x) for x in batch.column("html").to_pylist()]
                out = {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url").cast(pa.string()),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(out)

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
