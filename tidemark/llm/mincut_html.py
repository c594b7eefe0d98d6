"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. Each block is a node: the price of calling it boilerplate is its edge from the source,
the price of calling it content its edge to the sink, both from a logistic rule over what is known of the block
(the elements around it, their names, its share of links, its length). Neighbouring blocks, and neighbours within one
element, are tied by edges whose price is paid if the two are labelled differently; it falls with their distance in the
page's tree. The minimum cut, found by maximum flow, is the labelling of least total price.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.words import slices

RAW = set("script style noscript template textarea title svg math iframe object select option datalist canvas audio video".split())
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: What follows a tag's name, up to the sign that ends the tag; possessive, so that a tag without an end is read once.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
NOTE_END = re.compile(r"--!?>")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open one of their own kind; all but cells and rows also end an open paragraph.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements whose text belongs to the element around them.
ITEMS = set("p li h1 h2 h3 h4 h5 h6".split())
BARE = set("nav footer aside form menu dialog button fieldset noscript".split())
MAIN = set("article main".split())
BARE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|sponsor\w*|promo\w*|banner|side-?bar|aside|nav\w*|menu\w*|breadcrumbs?|footer\w*|foot|header|masthead|topbar|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|sign-?up|log-?in|share\w*|sharing|social\w*|related\w*|recommend\w*|comments?|comment-?\w*|respond|disqus\w*|replies|reply|reader-?\w*|widget\w*|toolbar|pager|pagination|search\w*|form|"
    r"navigation|contentinfo|complementary|skip\w*|legal|copyright|disclaimer|tags?|byline-?links|teaser\w*|trending|popular)(?=$|[\s_-])",
    re.IGNORECASE,
)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|main\w*|content|post|entry|story|body|text|articlebody)(?=$|[\s_-])", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SPACE = re.compile(r"\s+")
#: Prices of the ties: neighbours in one element, in two elements side by side, further apart in the tree, and neighbours
#: within one element with others between.
TIE, SIDE, LOOSE, KIN = 1.2, 0.8, 0.15, 0.8


class Block:
    __slots__ = ("text", "link", "tag", "bare", "main", "home", "above")

    def __init__(self, text: str, link: int, tag: str, bare: bool, main: bool, home: int, above: int):
        self.text, self.link, self.tag, self.bare, self.main, self.home, self.above = text, link, tag, bare, main, home, above


def markup(html: str) -> Iterator[tuple[int, int, str | None, str, bool]]:
    """Start, end, name (None: comments, declarations, raw elements), attributes of every piece of markup; whether it closes.

    One pass, whatever the page looks like: a "<" that no ">" follows is text, as is one that no tag can start with. Where
    a quoted attribute never ends, this tag and all later ones end at their first ">".
    """
    at, n, last, quotes = 0, len(html), html.rfind(">"), True
    while (i := html.find("<", at)) >= 0:
        at = i + 1
        if html.startswith("<!--", i):
            end = NOTE_END.search(html, i + 4)
            at = end.end() if end else n
            yield i, at, None, "", False
            continue
        if i > last:
            return
        closes = html.startswith("/", at)
        name = NAME.match(html, at + closes)
        if not name:
            if html[at] in "!?/":
                at = html.find(">", at) + 1
                yield i, at, None, "", False
            continue
        stop = REST.match(html, name.end()).end() if quotes else -1
        if stop < 0 or stop >= n or html[stop] != ">":
            quotes, stop = False, html.find(">", name.end())
        at, tag, attrs = stop + 1, name[0].lower(), html[name.end() : stop]
        if tag in RAW and not closes and not (attrs.endswith("/") and tag in ("svg", "math")):
            end = RAW_END[tag].search(html, at)
            at = end.end() if end else n
            yield i, at, None, "", False
            continue
        yield i, at, tag, attrs, closes


class Open:
    """An open element: what holds for the text in it, its block, and where the elements that it may end begin."""

    __slots__ = ("tag", "bare", "main", "link", "hidden", "block", "home", "above", "base", "para")

    def __init__(self, tag: str, bare: bool, main: bool, link: bool, hidden: bool, block: str, home: int, above: int, base: int, para: int):
        self.tag, self.bare, self.main, self.link, self.hidden = tag, bare, main, link, hidden
        self.block, self.home, self.above, self.base, self.para = block, home, above, base, para


def blocks(html: str) -> list[Block]:
    """Text blocks in page order. Scripts, styles and other raw elements have none; open elements end where HTML says.

    Elements may be nested to any depth; every step costs the same at any depth.
    """
    out: list[Block] = []
    stack = [Open("", False, False, False, False, "", 0, 0, 0, 0)]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    link = count = 0
    at = 0

    def close() -> None:
        nonlocal link
        if parts:
            text, top = SPACE.sub(" ", unescape("".join(parts))).strip(), stack[-1]
            if text and not top.hidden:
                out.append(Block(text, link, top.block, top.bare, top.main, top.home, top.above))
            parts.clear()
        link = 0

    def shorten(size: int) -> None:
        while len(stack) > size:
            open_tags[stack.pop().tag] -= 1

    for start, end, tag, attrs, closes in markup(html):
        if start > at:
            piece = html[at:start]
            parts.append(piece)
            link += len(piece) if stack[-1].link else 0
        at = end
        if tag is None:
            continue
        if tag == "br" or tag in ("hr", "wbr", "img", "input"):
            parts.append("" if tag == "wbr" else " ")
            if tag == "hr":
                close()
            continue
        inline = tag in INLINE
        if not inline:
            close()
        if closes:
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    shorten(len(stack) - 1)
                shorten(len(stack) - 1)
            continue
        if not inline:
            top = stack[-1]
            if top.para and tag not in ("td", "th", "tr"):
                shorten(top.para)
            if stack[top.base].tag in SIBLINGS.get(tag, ()):
                shorten(top.base)
        if tag in VOID or attrs.endswith("/") and tag not in ("p", "div", "a", "span"):
            continue
        top = stack[-1]
        bare, main, hidden = top.bare, top.main, top.hidden
        if attrs:
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
            names = " ".join(v for k, v in found.items() if k in ("class", "id", "role", "aria-label", "itemprop"))
            hidden = hidden or "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
            if names and tag not in ("html", "body"):
                if BARE_NAME.search(names) and not (tag in MAIN and not re.search("comment|repl", names, re.IGNORECASE)):
                    bare = True
                elif MAIN_NAME.search(names):
                    main = True
        if tag in BARE or tag == "header" and not main or tag == "head":
            bare = True
        count += 1
        place = len(stack)
        stack.append(Open(
            tag, bare, main or tag in MAIN, top.link or tag == "a", hidden, top.block if inline else tag, top.home if inline or tag in ITEMS else count,
            top.above if inline or tag in ITEMS else top.home, top.base if inline or tag == "p" else place, place if tag == "p" else top.para if inline else 0,
        ))
        open_tags[tag] += 1
    if at < len(html):
        parts.append(html[at:])
    close()
    return out


def odds(b: Block, has_main: bool) -> float:
    """Log odds that a block belongs to the main text."""
    words = b.text.count(" ") + 1
    value = -0.8 + 0.05 * min(words, 50) + (0.6 if b.text[-1] in ".!?…\"”»:" else 0.0)
    value += 6.0 if b.main else -3.0 if has_main else 0.0
    value -= 14.0 if b.bare else 0.0
    value -= 4.0 * min(1.0, b.link / len(b.text))
    return value + (1.0 if b.tag in ("h1", "h2", "h3", "p", "blockquote", "pre") else -0.5 if b.tag == "li" else 0.0)


def min_cut(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least price: a node pays softplus(-gain) as content, softplus(gain) as boilerplate, a cut tie its weight.

    Only the difference of the two prices matters, which is the gain. Nodes whose gain outweighs all their ties are
    labelled at once and their ties become gains of their neighbours; maximum flow decides the rest.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in ties:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    gain, label = list(gain), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                gain[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        for i, side in zip(rest, _source_side([gain[i] for i in rest], [{number[j]: w for j, w in near[i].items()} for i in rest])):
            label[i] = side
    return label


def _source_side(gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by shortest augmenting levels; the nodes that the source still reaches."""
    n = len(gain)
    s, t = n, n + 1
    left: list[dict[int, float]] = [dict(d) for d in near] + [{}, {}]
    for i, g in enumerate(gain):
        a, b = (s, i) if g > 0 else (i, t)
        left[a][b], left[b][a] = abs(g), left[b].get(a, 0.0)
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for j, c in left[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if t not in level:
            return [i in level for i in range(n)]
        todo = {i: list(left[i]) for i in level}
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                flow = min(left[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    left[a][b] -= flow
                    left[b][a] = left[b].get(a, 0.0) + flow
                path = path[: next(k for k, (a, b) in enumerate(zip(path, path[1:])) if left[a][b] <= 1e-12) + 1]
                continue
            while todo[i] and not (left[i][todo[i][-1]] > 1e-12 and level.get(todo[i][-1]) == level[i] + 1):
                todo[i].pop()
            if todo[i]:
                path.append(todo[i][-1])
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            out.append((i - 1, i, TIE if a.home == b.home else SIDE if a.above == b.above else LOOSE))
        j = last.get(b.home)
        if j is not None and j < i - 1:
            out.append((j, i, KIN))
        last[b.home] = i
    return out


def main_text(html: str | None) -> str:
    """Blocks of the main text joined by line feeds; empty for null, and for a page without any."""
    if not html:
        return ""
    found = blocks(html)
    has_main = any(b.main and not b.bare for b in found)
    keep = min_cut([odds(b, has_main) for b in found], ties(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from the whole html.

    Null and empty pages have an empty text. Each row is answered on its own, so repeated rows have equal answers; null
    ids and urls stay null; columns other than page_id, url and html are not read. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            text = [main_text(h) for h in b["html"].to_pylist()]
            yield pa.record_batch({"page_id": b["page_id"], "url": b["url"], "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
