"""Main text of web pages by minimum-cut labelling.

A page is a sequence of text blocks.  A linear classifier over each block's
markup gives the costs of calling it content or boilerplate; these are the
capacities of its terminal edges.  Smoothness edges join blocks that are
neighbours in page order, or neighbours within one parent element, the stronger
the closer they are in the tree.  The minimum cut, found by maximum flow, is the
cheapest labelling; blocks on the source side are the main text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
SKIPPED = frozenset("script style template noscript svg math iframe object canvas audio video select textarea button title head datalist".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: A start tag ends an open element of these, up to the given ones.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

# The classifier: words in class, id or role, elements, and weights.
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog search".split())
CONTENT_TAGS = frozenset("article main".split())
TELLING = BOILERPLATE_TAGS | CONTENT_TAGS | {"form", "header"}
#: Words that tell by themselves, words that also name harmless containers, and words of articles.
CLEAR = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar sidenav aside related recommended share sharing social promo promos promotion ad ads advert adverts advertisement sponsor"
    " sponsored banner cookie cookies consent notice alert popup modal newsletter subscribe signup login comment comments disqus reply replies respond pagination pager toolbar"
    " copyright hidden contentinfo complementary".split()
)
VAGUE = {"header": -3.0, "form": -3.0, "search": -1.5, "legal": -1.5, "widget": -1.5}
CONTENT_WORDS = frozenset("article main content post entry story body".split())
#: What follows one of these in a name is what a container has beside it, not what it is.
BESIDE = frozenset("has with without no".split())
_PART = re.compile(r"[a-z]+")
PROMOTION = re.compile(
    r"(?i)\b(?:advertisement|sponsored|promoted|buy now|shop now|order now|click here|subscribe|sign up|limited offer|special offer|free shipping|cookies"
    r"|all rights reserved|privacy policy|terms of (?:use|service))\b"
)
COMMENTARY = re.compile(r"(?i)\b(?:\d+ (?:comments?|replies|responses)|leave a (?:comment|reply)|log in to (?:comment|reply)|(?:says|wrote|replied|commented):|permalink|reply$)")
WEIGHT = {
    "content_tag": 4.5,
    "content_word": 3.5,
    "clear": -5.0,
    "form": -3.0,
    "plain": -1.0,
    "beside_the_article": -5.0,
    "per_100_chars": 1.0,
    "most_chars": 3.0,
    "paragraph": 1.0,
    "sentence": 0.5,
    "links": -3.0,
    "promotion": -2.5,
    "commentary": -2.0,
}
#: Evidence beyond this is that of an article, or clear boilerplate; none counts for more than the most; what an outer element says fades.
NAMED, SURE, MOST, FADE = 3.0, 4.0, 6.0, 0.5
SAME_PARENT, NEAR, FAR = 1.25, 0.3, 0.05
SCALE = 1000

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Block:
    """A piece of text of one block element; ``parent`` is the element's number, ``above`` those of its next two ancestors, ``evidence`` what elements around it say."""

    __slots__ = ("above", "evidence", "linked", "parent", "tag", "text")

    def __init__(self, text: str, linked: int, parent: int, above: tuple[int, ...], evidence: float, tag: str):
        self.text, self.linked, self.parent, self.above, self.evidence, self.tag = text, linked, parent, above, evidence, tag


def _of_name(name: str) -> float:
    """Evidence of one class, id or role: a clear word decides, all others add up."""
    total = 0.0
    for part in _PART.findall(name):
        if part in BESIDE:
            break
        if part in CLEAR:
            return WEIGHT["clear"]
        if part in CONTENT_WORDS:
            total = max(total, 0.0) + WEIGHT["content_word"] if total <= 0 else total
        else:
            total += VAGUE.get(part, 0.0)
    return total


def _evidence(tag: str, attributes: str, outer: float) -> float:
    """Log odds that text right inside an element is content, from the element and the evidence around it.

    Clear boilerplate stays so whatever is around it.  Inside it, an article's
    names weigh little; elsewhere they and vague names add to what the outer
    elements say, which fades inwards.
    """
    if not attributes and tag not in TELLING:
        return outer
    names: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return -2 * MOST
        if name in ("class", "id", "role"):
            names.update(value.split())
    if tag in ("html", "body"):
        return outer
    said = [_of_name(x) for x in sorted(names)]
    if tag in BOILERPLATE_TAGS or tag == "header" and outer <= 0:
        return min(outer, WEIGHT["clear"])
    own = WEIGHT["form"] if tag == "form" else 0.0
    clear = WEIGHT["clear"] in said
    if clear and not any(x > 0 for x in said):
        return min(outer, WEIGHT["clear"])
    own += min(WEIGHT["content_word"], sum(x for x in said if x > 0)) + sum(x for x in said if x < 0)
    if tag in CONTENT_TAGS and not clear:
        own += WEIGHT["content_tag"]
    if not own:
        return outer
    if outer <= -SURE:
        # a part of boilerplate may call itself content, but a page has one main element, which is in none
        return own if tag == "main" else min(-SURE, outer + max(0.0, own) * FADE)
    fades = FADE if outer > 0 or own <= 0 else 1.0
    return max(-MOST, min(MOST, own + fades * outer))


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in page order, in time proportional to its length.

    Markup that is broken or left open is tolerated: where a quote is never
    closed, this and all later tags end at their next ``>``; ``<`` without any
    ``>`` after it is text.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]
    count, links, run, linked = 1, 0, [], 0
    open_now: Counter = Counter()
    endless, quotes = set(), True

    def flush() -> None:
        nonlocal run, linked
        text = " ".join(unescape("".join(run)).split()) if run else ""
        if text:
            tag, number, evidence = stack[-1]
            out.append(Block(text, linked, number, tuple(x[1] for x in stack[-3:-1][::-1]), evidence, tag))
        run, linked = [], 0

    def cut(k: int) -> None:
        open_now.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def close(names: set[str] | frozenset[str], until: set[str]) -> None:
        if not any(open_now[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in until:
                return
            if stack[k][0] in names:
                return cut(k)

    def say(text: str) -> None:
        nonlocal linked
        if text:
            run.append(text)
            if links:
                linked += len(text)

    position, n, last = 0, len(html), html.rfind(">")
    while position < n:
        at = html.find("<", position)
        if at < 0 or at > last and html.find("<!--", at) < 0:
            say(html[position:])
            break
        say(html[position:at])
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            position = n if end < 0 else end + 3
            continue
        m = _NAME.match(html, at)
        if m is None:
            if html[at + 1 : at + 2] in ("!", "?", "/") and at < last:
                position = html.find(">", at) + 1
            else:
                say("<")
                position = at + 1
            continue
        rest = _REST.match(html, m.end()) if quotes else None
        if rest is None:
            quotes = False
            position = html.find(">", m.end()) + 1
            if not position:
                say("<")
                position = at + 1
                continue
        else:
            position = rest.end()
        attributes = html[m.end() : position - 1]
        tag, ending = m[1].lower(), html[at + 1] == "/"
        if tag in SKIPPED and not ending:
            end = None
            if tag not in endless:
                # a head ends with its tag or where a body begins
                pattern = r"</head\s*>|(?=<body[\s>])" if tag == "head" else rf"</{re.escape(tag)}\s*>"
                end = re.compile(pattern, re.I).search(html, position)
                if end is None:
                    endless.add(tag)
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                position = end.end() if end else (n if tag in ("script", "style", "textarea", "title") else position)
            continue
        if tag == "a":
            links = 0 if ending else 1
        if tag == "br" or tag == "wbr":
            say(" " if tag == "br" else "")
            continue
        if tag in INLINE or tag in SKIPPED:
            continue
        flush()
        links = 0
        if ending:
            if open_now[tag] > 0:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "li", "blockquote", "div", "article", "section", "main", "aside", "table"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag not in VOID and not (attributes.endswith("/") and tag not in CLOSES_P):
            stack.append((tag, count, _evidence(tag, attributes, stack[-1][2])))
            open_now[tag] += 1
            count += 1
    flush()
    return out


def costs(b: Block, beside: bool = False) -> tuple[int, int]:
    """Capacities of a block's edges from the source and to the sink.

    The log odds add up what the elements around, the block's length, links
    and words say; each alone may be wrong, and the cut weighs it against the
    block's neighbours.  Within an article links and words count for less, within clear
    boilerplate length does.  ``beside`` tells that named elements hold most of
    the page's text, so that text outside of them is less likely part of it.
    """
    e = b.evidence
    against = WEIGHT["links"] * b.linked / max(1, len(b.text)) + WEIGHT["promotion"] * min(2, len(PROMOTION.findall(b.text)))
    if e < NAMED:
        # an article may well report what somebody wrote
        against += WEIGHT["commentary"] * min(2, len(COMMENTARY.findall(b.text)))
    length = min(WEIGHT["most_chars"], WEIGHT["per_100_chars"] * len(b.text) / 100)
    z = e + WEIGHT["plain"] + length * (1 / 3 if e <= -SURE else 1) + against / (1 + max(0.0, e))
    z += WEIGHT["paragraph"] * (b.tag in ("p", "blockquote", "pre")) + WEIGHT["sentence"] * (b.text[-1:] in ".!?")
    if beside and e <= 0:
        z += WEIGHT["beside_the_article"]
    soft = math.log1p(math.exp(-abs(z)))
    return int(SCALE * (max(z, 0) + soft)), int(SCALE * (max(-z, 0) + soft))


def _named(bs: list[Block]) -> bool:
    """Do elements that say they are content hold most of the text that is no clear boilerplate."""
    size = [0, 0]
    for b in bs:
        if b.evidence > -SURE:
            size[b.evidence >= NAMED] += len(b.text)
    return size[1] > size[0]


def _close_by(a: Block, b: Block) -> bool:
    """Are the elements of two blocks at most two steps apart in the tree."""
    over_a, over_b = (a.parent, *a.above), (b.parent, *b.above)
    return any(x == y for i, x in enumerate(over_a) for j, y in enumerate(over_b) if i + j <= 2)


def _neighbours(bs: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity), at most two for each block."""
    edges, last = [], {}
    for j, b in enumerate(bs):
        # the element of the text and the one around it
        around = (b.parent, *b.above[:1])
        i = max(last.get(x, -1) for x in around)
        if j and i != j - 1:
            edges.append((j - 1, j, int(SCALE * (NEAR if _close_by(bs[j - 1], b) else FAR))))
        if i >= 0:
            edges.append((i, j, int(SCALE * SAME_PARENT)))
        last.update(dict.fromkeys(around, j))
    return edges


def minimum_cut(terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut.

    Maximum flow in rounds of shortest augmenting paths, many paths a round; a
    node's two terminal edges are first filled against each other.  Nodes that
    both sides could have go to the sink.
    """
    n = len(terminals)
    rest = [s - t for s, t in terminals]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    while True:
        level = {i: 0 for i in range(n) if rest[i] > 0}
        queue, reached = list(level), False
        for i in queue:
            for j, c in near[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    reached = reached or rest[j] < 0
                    queue.append(j)
        if not reached:
            return [i in level for i in range(n)]
        left = {i: list(near[i]) for i in level}
        for source in [i for i in level if level[i] == 0]:
            path = [source]
            while rest[source] > 0 and path:
                i = path[-1]
                if rest[i] < 0:
                    flow = min(rest[source], -rest[i], *(near[a][b] for a, b in zip(path, path[1:])))
                    rest[source] -= flow
                    rest[i] += flow
                    for a, b in zip(path, path[1:]):
                        near[a][b] -= flow
                        near[b][a] += flow
                    path = [source]
                    continue
                while left[i] and not (near[i][left[i][-1]] > 0 and level.get(left[i][-1], -1) == level[i] + 1):
                    left[i].pop()
                if left[i]:
                    path.append(left[i][-1])
                else:
                    path.pop()
                    if path:
                        left[path[-1]].pop()


def main_text(html: str) -> str:
    """The page's main text, its blocks joined by newlines; empty if there is none."""
    bs = blocks(html)
    beside = _named(bs)
    keep = minimum_cut([costs(b, beside) for b in bs], _neighbours(bs))
    return "\n".join(b.text for b, k in zip(bs, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``(id, *keep, text)`` per page.

    Null and empty pages have an empty text, repeated rows each keep a row, an
    empty table gives an empty one; markup that is long, unclosed or deeply
    nested takes time in proportion to its length, as ``blocks`` says.
    """
    source = pages.select(F.col(id_col).alias("id"), *keep, F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "html"):
            at = b.schema.get_field_index("html")
            texts = [main_text(x) if x else "" for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string())], [*b.schema.names[:at], "text"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, text string")
