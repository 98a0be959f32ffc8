"""Fields of pages that need the tree: pairs by CSS class in three scopes, names that are no portal's, addresses by line breaks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_POSTCODE = re.compile(r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b", re.I)


class Node:
    """An element; children are elements and texts in order."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def below(self) -> Iterator[Node]:
        """All elements below, in page order."""
        stack = [x for x in reversed(self.children) if isinstance(x, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [x for x in reversed(n.children) if isinstance(x, Node)]

    def after(self) -> Iterator[Node]:
        """Elements that follow among the same parent's children."""
        if self.parent:
            own = self.parent.children
            yield from (x for x in own[own.index(self) + 1 :] if isinstance(x, Node))

    def texts(self, breaks: bool = False) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif breaks and x.tag == "br":
                yield "\n"
            elif x.tag not in ("script", "style"):
                stack += reversed(x.children)

    def text(self) -> str:
        return " ".join("".join(self.texts()).split())

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.at.tag in _CLOSES.get(tag, ()):
            self.at = self.at.parent
            if tag == "tr" and self.at.tag == "tr":
                self.at = self.at.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:  # an end tag that nothing open matches is passed over
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def class_pairs(root: Node, label: str, value: str) -> dict[str, str]:
    """Values by label: of elements of class label, lower case without colons, and of the first element of class value in the
    label's parent, else among the siblings that follow it, else in its parent's parent. The last of equal labels wins; empty ones are left out."""
    out = {}
    for n in root.below():
        name = n.text().rstrip(":").strip().lower() if n.has_class(label) else ""
        if not name:
            continue
        row = n.parent
        scopes = (row.below(), n.after(), row.parent.below() if row.parent else ())
        found = next((x for scope in scopes for x in scope if x.has_class(value)), None)
        text = found.text() if found else ""
        if text:
            out[name] = text
    return out


def own_name(root: Node, portals: frozenset[str], header: str, given: str | None = None) -> tuple[str | None, bool]:
    """A page's name that is no portal's, and whether only a portal's was found: a part of the title between bars, the heading in
    the element with id header, the second heading, the first, what is given, else the first heading whatever it is.

    The page's own portal is named by its meta element application-name.
    """
    nodes = list(root.below())
    meta = next((n.attrs.get("content") or "" for n in nodes if n.tag == "meta" and n.attrs.get("name") == "application-name"), "")
    names = {p.lower() for p in portals} | ({meta.strip().lower()} if meta.strip() else set())
    foreign = lambda x: x.strip().lower() not in names
    title = next((n.text() for n in nodes if n.tag == "title"), "")
    heads = [n.text() for n in nodes if n.tag == "h1"]
    in_header = next((x.text() for n in nodes if n.attrs.get("id") == header for x in n.below() if x.tag == "h1"), "")
    options = [*(p.strip() for p in title.split("|")), in_header, *heads[1:2], *heads[:1]]
    best = next((x for x in options if x and foreign(x)), None)
    if best:
        return best, False
    if given:
        return given, not foreign(given)
    return (heads[0], True) if heads and heads[0] else (None, False)


def address(root: Node, panels: dict[str, str]) -> dict[str, str]:
    """The address in the first paragraph of the panels (id -> kind, in order): lines between breaks, the last one the postcode
    if it looks like one, the one before it the town. Panels count until one has a postcode; what is known stays."""
    out: dict[str, str] = {}
    nodes = list(root.below())
    for panel, kind in panels.items():
        p = next((x for n in nodes if n.attrs.get("id") == panel for x in n.below() if x.tag == "p"), None)
        lines = [x for x in (" ".join(y.split()) for y in "".join(p.texts(breaks=True)).split("\n")) if x] if p else []
        if not lines:
            continue
        if _POSTCODE.search(lines[-1]):
            out.setdefault("postcode", lines.pop().upper())
        if lines:
            out.setdefault("town", lines.pop())
        for k, line in enumerate([*lines[:2], *([", ".join(lines[2:])] if lines[2:] else [])], 1):
            out.setdefault(f"address_line{k}", line)
        out[f"address_type_{kind}"] = "true"
        if "postcode" in out:
            break
    return out


def page_details(html: Column, label: str, value: str, portals: tuple[str, ...] = (), header: str = "hit-header", panels: dict[str, str] | None = None, given: Column | None = None) -> Column:
    """struct(pairs, name, doubtful, address) of pages."""
    known, where = frozenset(portals), panels or {"pnlVisitAddressWrapper": "visit", "pnlPostalAddressWrapper": "postal"}

    def run(pages: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for page, name in zip(pages, names, strict=True):
            root = tree(page)
            found, doubtful = own_name(root, known, header, name)
            rows.append((class_pairs(root, label, value), found, doubtful, address(root, where)))
        return pd.DataFrame(rows, columns=["pairs", "name", "doubtful", "address"])

    return F.pandas_udf(run, "pairs map<string, string>, name string, doubtful boolean, address map<string, string>")(html, F.lit(None).cast("string") if given is None else given)
