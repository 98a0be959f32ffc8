"""A forgiving HTML parser to a flat tree of elements, with text in page order."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is in these is no text of the page.
UNSEEN = frozenset("script style noscript template head title svg iframe canvas audio video select textarea datalist".split())
#: The content runs to the end tag, whatever it holds.
RAW = frozenset("script style textarea title iframe noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
#: A start tag of these may stand in a head; any other ends one that is open, as text does.
_IN_HEAD = frozenset("base link meta title style script noscript template head html".split())
_SCOPE = frozenset("table td th caption button object html body".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)


class Tree:
    """Elements as parallel lists, parents before children.

    pieces: (element, text), or (element, None) where a block starts or ends.
    """

    def __init__(self):
        self.tag, self.parent, self.attrs, self.depth = ["#root"], [-1], [""], [0]
        self.pieces: list[tuple[int, str | None]] = []


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def parse(html: str) -> Tree:
    t, stack, at, end = Tree(), [0], 0, len(html)
    tags, parents, attrs, depths, pieces = t.tag, t.parent, t.attrs, t.depth, t.pieces
    unseen = 0  # open elements whose content is no text
    n_open: Counter[str] = Counter()  # by tag, so that what is not open costs no search

    def pop_to(k: int) -> None:
        nonlocal unseen
        for e in stack[k:]:
            n_open[tags[e]] -= 1
            if tags[e] in UNSEEN:
                unseen -= 1
            elif tags[e] not in INLINE:
                pieces.append((e, None))
        del stack[k:]

    def text(raw: str) -> None:
        if n_open["head"] and tags[stack[-1]] == "head" and raw.strip():
            pop_to(len(stack) - 1)
        if raw and not unseen:
            pieces.append((stack[-1], unescape(raw) if "&" in raw else raw))

    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["cdata"]:
                text(m["cdata"])
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            for k in range(len(stack) - 1, 0, -1) if n_open[tag] else ():
                if tags[stack[k]] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and tags[stack[k]] not in INLINE:
                    break
            continue
        if n_open["head"] and tag not in _IN_HEAD and tags[stack[-1]] == "head":
            pop_to(len(stack) - 1)
        if tag == "br" or tag == "hr":
            if not unseen:
                pieces.append((stack[-1], "\n") if tag == "br" else (stack[-1], None))
            if tag == "br":
                continue
        if tag not in INLINE and tag not in VOID:
            closes, scope = _CLOSES.get(tag, (frozenset(), frozenset()))
            for k in range(len(stack) - 1, 0, -1) if any(n_open[x] for x in closes) else ():
                own = tags[stack[k]]
                if own in closes:
                    pop_to(k)
                    if tag not in ("tr", "tbody", "tfoot") or not any(n_open[x] for x in closes):
                        break
                elif own in scope:
                    break
            for k in range(len(stack) - 1, 0, -1) if n_open["p"] else ():  # an open paragraph ends before a block
                own = tags[stack[k]]
                if own == "p":
                    pop_to(k)
                    break
                if own in _SCOPE or own not in INLINE:
                    break
        e = len(tags)
        tags.append(tag)
        parents.append(stack[-1])
        attrs.append(m["attrs"] or m["attrs2"] or "")
        depths.append(len(stack))
        if tag in VOID or attrs[e].endswith("/") and tag not in RAW and tag in ("path", "rect", "circle", "use"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag not in INLINE and not unseen:
            pieces.append((e, None))
        stack.append(e)
        n_open[tag] += 1
        unseen += tag in UNSEEN
    pop_to(1)
    return t
