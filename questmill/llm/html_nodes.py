"""DOM nodes of raw HTML and their features.

A small reader that forgives what browsers forgive: missing end tags, end tags
without a start, unquoted attributes, comments, raw text elements.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

#: An attribute: a value without quotes runs to white space or the end of the tag, whatever else it holds.
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+"
_TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>?|/\s*([a-zA-Z][^\s/>]*)[^>]*>?"
    rf"|([a-zA-Z][^\s/>]*)((?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:{_VALUE})?)?)*+)>?)", re.S,
)
_ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*+))?)?")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never shown as text of the page.
HIDDEN = frozenset("head script style template noscript iframe object canvas audio video map select datalist noembed noframes annotation annotation-xml desc metadata".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong "
    "sub sup time tt u var wbr "
    # Formulas and drawings stand within a line.
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose "
    "mtable mtr mtd svg g text tspan textpath path rect circle ellipse line polyline polygon use defs".split()
)
#: What a start tag ends, if it is open: these elements, up to the nearest of those.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section summary table ul".split()
)
_BARRIER = frozenset("table td th caption button object html".split())

#: Words in class, id and role that speak for main text, and those that speak against it, by kind.
GOOD = frozenset("article articlebody body content entry main post story text blog page copy prose single markdown document paper read".split())
BAD = {
    "menu": frozenset("nav navbar navigation menu breadcrumb breadcrumbs toolbar topbar tabs pager pagination skip toc links".split()),
    "edge": frozenset("header footer masthead banner sidebar side aside rail widget bottom top copyright legal credits".split()),
    "advert": frozenset("ad ads adv advert advertisement adsense sponsor sponsored promo promoted promotion dfp gpt adslot".split()),
    "notice": frozenset("cookie cookies consent gdpr notice alert popup modal overlay dialog privacy disclaimer toast banner".split()),
    "talk": frozenset("comment comments commentlist reply replies respond discussion disqus thread feedback review reviews".split()),
    "extra": frozenset("related recommended more share social sharing follow newsletter subscribe signup login search form tags meta author byline popular trending".split()),
}
TAGS = [
    frozenset({"article", "main"}), frozenset({"p", "blockquote", "pre"}), frozenset({"h1", "h2", "h3", "h4", "h5", "h6"}), frozenset({"li", "dd", "dt"}),
    frozenset({"nav", "menu"}), frozenset({"header", "footer"}), frozenset({"aside", "dialog"}), frozenset({"form", "button", "fieldset", "input", "label"}),
    frozenset({"div", "section"}), frozenset({"ul", "ol", "dl"}), frozenset({"table", "tr", "td", "th", "tbody"}), frozenset({"html", "body"}),
]


@dataclass
class Node:
    tag: str
    words: frozenset[str]
    parent: int
    depth: int
    place: int  # among the element children of the parent
    #: Texts (str) and child nodes (int), in page order.
    parts: list[str | int] = field(default_factory=list)


def parse(page: str | None) -> list[Node]:
    """The nodes of a page in document order; the first is the root."""
    nodes, text = [Node("#root", frozenset(), -1, 0, 0)], page or ""
    children, stack, at = [0], [0], 0
    #: Where elements of each tag, and block elements, stand in the stack, so that no search walks it.
    places: dict[str, list[int]] = {}
    blocks: list[int] = []

    def put(s: str) -> None:
        if s:
            nodes[stack[-1]].parts.append(s)

    def nearest(tags: set[str] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(k: int) -> None:
        """Close the element at this place of the stack, and all in it."""
        while len(stack) > k:
            tag = nodes[stack.pop()].tag
            places[tag].pop()
            if tag not in INLINE:
                blocks.pop()

    def close(tags: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> bool:
        """Close the nearest of these elements that is open inside the nearest barrier."""
        k = nearest(tags)
        if not k or nearest(barrier - tags) > k:
            return False
        cut(k)
        return True

    while (m := _TAG.search(text, at)) is not None:
        put(html.unescape(text[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            tag = m[1].lower()
            if tag == "br":
                put("\n")
            else:
                k = nearest({tag})
                # An inline end tag does not close blocks; others do.
                if k and not (tag in INLINE and blocks and blocks[-1] > k):
                    cut(k)
        elif m[2] is not None:
            tag = m[2].lower()
            if tag in _ENDS_P:
                close({"p"}, _BARRIER)
                if tag[0] == "h" and tag[1:].isdigit():
                    close({"h1", "h2", "h3", "h4", "h5", "h6"}, _ENDS_P | _BARRIER)
            if tag in CLOSES:
                inner, outer = CLOSES[tag]
                while close(inner, outer):
                    pass
            if tag == "br":
                put("\n")
                continue
            # A paragraph inside an inline element that a paragraph before left open starts anew beside it.
            words: set[str] = set()
            for a in _ATTR.finditer(m[3] or ""):
                if a[1].lower() in ("class", "id", "role", "itemprop", "aria-label", "name"):
                    words |= {w.lower() for w in _WORD.findall(html.unescape(a[2] or a[3] or a[4] or ""))}
                elif a[1].lower() == "hidden" or a[1].lower() == "style" and "display:none" in (a[2] or a[3] or "").replace(" ", "").lower():
                    words.add("#hidden")
            up = stack[-1]
            nodes.append(Node(tag, frozenset(words), up, nodes[up].depth + 1, children[up]))
            children[up] += 1
            children.append(0)
            nodes[up].parts.append(len(nodes) - 1)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                nodes[-1].parts.append(html.unescape(text[at : end.start() if end else len(text)]) if tag in ("textarea", "title") else "")
                at = end.end() if end else len(text)
            elif tag not in VOID:
                places.setdefault(tag, []).append(len(stack))
                if tag not in INLINE:
                    blocks.append(len(stack))
                stack.append(len(nodes) - 1)
    put(html.unescape(text[at:]))
    return nodes


def shown(nodes: list[Node]) -> np.ndarray:
    """Whether each node can hold text of the page."""
    out = np.ones(len(nodes), bool)
    for i, n in enumerate(nodes[1:], 1):
        out[i] = out[n.parent] and n.tag not in HIDDEN and n.tag != "title" and n.tag != "textarea" and "#hidden" not in n.words
    return out


FEATURES = 2 * (len(TAGS) + len(BAD) + 1) + 15


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: its own tag and attribute words, those of its ancestors, text density, depth and siblings."""
    n, live = len(nodes), shown(nodes)
    text, link, tags, marks, words, controls, blocks = (np.zeros(n) for _ in range(7))
    children = np.zeros(n)
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        tags[i] += 1
        if live[i]:
            own = [p for p in node.parts if isinstance(p, str)]
            s = " ".join(own)
            k = len(s.split())
            words[i] += k
            text[i] += sum(len(w) for w in s.split())
            marks[i] += sum(s.count(c) for c in ".,;:!?|©")
            blocks[i] += node.tag not in INLINE and k > 0
            controls[i] += node.tag in ("input", "button", "select", "textarea", "form")
            if node.tag == "a":
                link[i] = text[i]
        if node.parent >= 0:
            up = node.parent
            children[up] += 1
            for x in (text, link, tags, marks, words, controls, blocks):
                x[up] += x[i]
    own = np.zeros((n, len(TAGS) + len(BAD) + 1))
    for i, node in enumerate(nodes):
        own[i, : len(TAGS)] = [node.tag in t for t in TAGS]
        own[i, len(TAGS)] = len(node.words & GOOD)
        own[i, len(TAGS) + 1 :] = [len(node.words & b) for b in BAD.values()]
    above = np.zeros_like(own)
    for i, node in enumerate(nodes[1:], 1):
        above[i] = np.maximum(above[node.parent], own[node.parent])
    up = np.array([max(0, node.parent) for node in nodes])
    total = max(1.0, text[0])
    before = np.zeros(n)
    running = 0.0
    for i, node in enumerate(nodes):
        before[i] = running
        if live[i]:
            running += sum(len(p) for p in node.parts if isinstance(p, str))
    rest = np.stack(
        [
            np.log1p(text), text / total, link / np.maximum(1, text), words / np.maximum(1, tags), marks / np.maximum(1, words), controls,
            np.log1p(blocks), np.array([node.depth for node in nodes]), np.array([node.place for node in nodes]), children[up],
            text / np.maximum(1, text[up]), text[up] / total, link[up] / np.maximum(1, text[up]), text / np.maximum(1, blocks), before / max(1.0, running),
        ],
        1,
    )
    return np.concatenate([own, above, rest], 1).astype(np.float32)


def text_of(nodes: list[Node], keep: np.ndarray) -> str:
    """The texts of the kept nodes: a line for each block, white space as one space."""
    lines: list[str] = []
    open_: list[str] = []

    def end() -> None:
        line = " ".join("".join(open_).split())
        if line:
            lines.append(line)
        open_.clear()

    work: list[tuple[int, int]] = [(0, 0)]
    while work:
        i, k = work.pop()
        node = nodes[i]
        block = node.tag not in INLINE
        if k == 0 and block:
            end()
        parts = node.parts
        while k < len(parts):
            p = parts[k]
            k += 1
            if isinstance(p, str):
                if keep[i]:
                    open_.append(p)
            elif keep[p]:
                work.append((i, k))
                work.append((p, 0))
                break
            elif nodes[p].tag not in INLINE and nodes[p].tag not in HIDDEN:
                end()
        else:
            if block:
                end()
    end()
    return "\n".join(lines)
