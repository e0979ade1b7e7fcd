"""Main text of web pages by minimum-cut labelling of their blocks.

Method: a page is cut into blocks of text at block-level tags, each with its
open elements. A classifier with fixed weights gives each block the log odds
of being content, from its length, sentences, share of linked characters,
whether a short text comes again, the article it stands in, and what one element
around it says of itself (tag, class, id, role): that is one bounded feature,
which counts for less the more of the page's text that element holds, so that
no single word drops an article. Log odds become capacities from the source
(content) or to the sink (boilerplate). Neighbours in the page are joined by an
edge that is stronger the nearer they are in the element tree and weaker across
the border of an article or of an element that names boilerplate; so is each
block with the next one under the same parent. A maximum flow is a minimum cut:
the blocks still reached from the source are content, so that a short line in
an article follows its neighbours, and a sentence in a footer follows its.

The cut runs page by page, so pages spread over tasks as they are read, and
nothing is shuffled. A page of n blocks has at most 4n edges.

Cases: a null or empty page, or one without content, has the text ""; broken
markup is read on as far as it goes (an unclosed comment or script hides the
rest, a tag that the end cuts off is dropped); repeated rows are returned as
often as they come; nulls in page_id and url are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import small_batches

# Tags by kind, and words in class, id and role.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("applet audio canvas datalist head iframe math noframes noscript object script style svg template textarea title video".split())
RAW_TAGS = frozenset("iframe noframes noscript script style textarea title xmp".split())
CHROME_TAGS = frozenset("aside button dialog fieldset footer form label legend menu nav option select".split())
MAIN_TAGS = frozenset("article main".split())
CHROME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo cookie cookies copyright discussion disqus footer footnav gdpr header login masthead menu menubar nav navbar navigation newsletter notice notices pager paginate pagination promo promoted promotion recommended related replies reply respond share sharing shoutbox sidebar sidenav signin signup social sponsor sponsored subscribe subscription toolbar topbar trending".split())
HINT_WORDS = frozenset("byline dialog disclaimer donate hero metadata modal notification paywall popup print privacy search skip tabs tags teaser toc warning widget".split())
MAIN_WORDS = frozenset("article articlebody body blog content entry main page post story text".split())
ALWAYS_WORDS = frozenset("ad ads comment comments cookie footer menu nav sidebar".split())
CLOSED_BY_BLOCKS = frozenset(["p"])
CLOSES_SAME = {"li": "li", "dt": "dd dt", "dd": "dd dt", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th"}

# Weights of the classifier, in log odds.
BIAS, LENGTH, FULL_LENGTH = -0.8, 2.2, 25
SENTENCE, HEADING, MAIN, WORDED = 0.8, 0.4, 2.5, 0.6
LINKED, REPEATED, SHORT = -3.0, -1.0, 10
CHROME, HINT = -5.5, -2.0
# An element of this many words that holds most of a page's text names boilerplate in vain.
LARGE = 100
# Weights of edges: to the neighbour in the page, halved for each further step in the tree, to the next block
# under one parent; and factors: across a border, between elements of two tags.
NEAR, SIBLING, ACROSS, OTHER_TAG = 1.6, 0.6, 0.2, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_OPEN_TAG = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_SENTENCE = re.compile(r"[.!?。！？](?:\s|$)")


class Block:
    """A block of text: path numbers its open block elements, says names those that call it boilerplate."""

    __slots__ = ("linked", "main", "parts", "path", "says", "tag", "text", "words", "worded")

    def __init__(self, path: tuple, says: tuple, main: int, worded: bool, tag: str):
        self.path, self.says, self.main, self.worded, self.tag = path, says, main, worded, tag
        self.parts: list[str] = []
        self.linked = self.words = 0
        self.text = ""


def _says(attributes: str, tag: str) -> tuple[float, bool, bool]:
    """What an element's attributes add for boilerplate, whether they name content, and whether they hide it."""
    if "=" not in attributes:
        return 0.0, False, tag not in VOID_TAGS and " hidden" in attributes
    words: set[str] = set()
    hidden = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            words.update(_WORD.findall(_CAMEL.sub("-", value).lower()))
        elif (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (name == "aria-hidden" and value == "true"):
            hidden = True
    chrome, main = not words.isdisjoint(CHROME_WORDS), not words.isdisjoint(MAIN_WORDS)
    always = not words.isdisjoint(ALWAYS_WORDS) and tag not in MAIN_TAGS
    if always or chrome and not main:
        return CHROME, False, hidden
    return (HINT if not main and not words.isdisjoint(HINT_WORDS) else 0.0), main and not chrome, hidden


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    out: list[Block] = []
    # open elements: tag, number, hidden, what they and those around say (number, weight), article, worded
    stack: list[tuple] = [("", 0, False, (), 0, False)]
    numbers, at, links = 0, 0, 0
    block: Block | None = None
    tail = _OPEN_TAG.search(page, page.rfind("<") if "<" in page else len(page))
    end = tail.start() if tail else len(page)

    def text(part: str) -> None:
        nonlocal block
        if not part or stack[-1][2]:
            return
        if block is None:
            if part.isspace():
                return
            path = [x for x in stack if x[0] in BLOCK_TAGS]
            top = stack[-1]
            block = Block(tuple(x[1] for x in path), top[3], top[4], top[5], path[-1][0] if path else "")
        block.parts.append(part)
        if links:
            block.linked += len(part)

    def flush() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                out.append(block)
            block = None

    position = 0
    while position < end:
        m = _TOKEN.search(page, position, end)
        if m is None:
            break
        text(page[at : m.start()])
        at = position = m.end()
        slash, tag, attributes = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text(" ")
            continue
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if any(x[0] in BLOCK_TAGS for x in stack[k:]):
                        flush()
                    links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in ("table", "article", "main", "body") and tag not in ("html", "body", "article", "main", "section", "div", "table"):
                    break
            if tag in BLOCK_TAGS:
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            closing = CLOSES_SAME.get(tag, "").split()
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name in CLOSED_BY_BLOCKS or name in closing:
                    links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    break
                if name in BLOCK_TAGS:
                    break
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in RAW_TAGS:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            at = position = close.end() if close else len(page)
            continue
        weight, worded, hidden = _says(attributes, tag) if tag not in ("html", "body") and attributes else (0.0, False, False)
        above = stack[-1]
        numbers += 1
        if tag in CHROME_TAGS or tag == "header" and not above[4]:
            weight = CHROME
        says = (*above[3], (numbers, weight)) if weight else above[3]
        # an article within boilerplate, such as a reader's comment, is none
        inside = tag in MAIN_TAGS and all(w > CHROME for _, w in says)
        stack.append((tag, numbers, above[2] or hidden or tag in HIDDEN_TAGS, says, numbers if inside else above[4], above[5] or worded))
        links += tag == "a"
    text(page[at:end] if at < end else "")
    flush()
    return out


def log_odds(found: list[Block]) -> list[float]:
    """What speaks for each block being content, by itself."""
    total, inside, times = 0, Counter(), Counter(b.text for b in found)
    for b in found:
        b.words = b.text.count(" ") + 1
        if 2 * b.linked < len(b.text):
            total += b.words
            for number, _ in b.says:
                inside[number] += b.words

    def held(number: int) -> float:
        share = inside[number] / max(1, total)
        return 1 - share if inside[number] >= LARGE and share > 0.5 else 1.0

    out = []
    for b in found:
        z = BIAS + LENGTH * min(1.0, b.words / FULL_LENGTH) + LINKED * min(1.0, b.linked / len(b.text))
        z += SENTENCE if _SENTENCE.search(b.text) else 0.0
        z += HEADING if b.tag in ("h1", "h2", "h3") else 0.0
        z += MAIN if b.main else WORDED if b.worded else 0.0
        z += REPEATED if times[b.text] > 1 and b.words < SHORT and not b.main else 0.0
        z += min((w * held(number) for number, w in b.says), default=0.0)
        out.append(z)
    return out


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Adjacency and proximity in the element tree, as undirected edges with weights."""
    out = []
    last: dict[tuple, int] = {}
    for k, b in enumerate(found):
        if k:
            a = found[k - 1]
            common = 0
            for x, y in zip(a.path, b.path, strict=False):
                if x != y:
                    break
                common += 1
            border = a.main != b.main or a.says != b.says
            steps = max(2, len(a.path) + len(b.path) - 2 * common)
            out.append((k - 1, k, NEAR / 2 ** min(steps - 2, 30) * (ACROSS if border else 1.0) * (1.0 if a.tag == b.tag else OTHER_TAG)))
        holder = b.path[:-1]
        if holder in last and found[last[holder]].says == b.says:
            out.append((last[holder], k, SIBLING))
        last[holder] = k
    return out


def minimum_cut(source: list[float], sink: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it stays on the source's side of a minimum cut.

    source and sink are terminal capacities, links undirected edges. Of several
    minimum cuts, the one with the fewest nodes on the source's side is taken.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(forth)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for k in range(n):
        through = min(source[k], sink[k])
        if source[k] > through:
            arc(s, k, source[k] - through, 0.0)
        if sink[k] > through:
            arc(k, t, sink[k] - through, 0.0)
    for a, b, w in links:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for a in queue:
            for e in out[a]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(left[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    left[e] -= flow
                    left[e ^ 1] += flow
                    if left[e] <= 1e-9 and not cut:
                        cut = k + 1
                del path[cut - 1 :]
                a = to[path[-1]] if path else s
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if left[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                e = path.pop()
                a = to[path[-1]] if path else s
                continue
            path.append(e)
            a = to[e]


def labels(found: list[Block]) -> list[bool]:
    """For each block whether it is content."""
    odds = log_odds(found)
    if not odds or min(odds) > 0 or max(odds) <= 0:
        return [z > 0 for z in odds]
    return minimum_cut([max(z, 0.0) for z in odds], [max(-z, 0.0) for z in odds], edges(found))


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


_OUT = "page_id long, url string, text string, n_chars long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in small_batches(batch, "html", 8 << 20):
            texts = [main_text(x) for x in piece["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([piece["page_id"].cast(pa.int64()), piece["url"].cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, text, n_chars."""
    return pages.select("page_id", "url", "html").mapInArrow(_rows, _OUT)
