"""The main text of web pages: boosted trees over the elements of a page, decoded along its tree.

Each block element gets features: text and link density of its subtree, tokens
of its class, id and role, depth, siblings and what its ancestors are. Boosted
trees, trained on pages that a generator makes together with their truth, give
the log-odds that it belongs to the article. Decoding then chooses the elements
to keep with the greatest sum of log-odds such that nothing is kept below an
element that is dropped.

Cases: a null or empty page has an empty text; a page without tags is one block;
unclosed and misnested tags, tags cut off at the end, and unknown character
references are taken as browsers do or left as they are; a head without an end
tag ends before the first tag or text that cannot be in one. White space is what
str.split() takes for it, no-break spaces too. Empty tables give empty results;
other columns are left out.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, common, dom

#: Tags that are features of their own.
TAGS = "nav header footer aside article main section div p h1 h2 h3 ul ol li table form figure blockquote pre span button dl body address fieldset".split()
#: Tokens of class, id and role, by what they tell of.
TOKENS = {
    "main": "article content post entry main body story text prose blog page-content maincontent",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc tabs tab toolbar skip",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp adslot",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback reviews",
    "side": "sidebar side aside widget widgets related recommended rail complementary teaser more",
    "frame": "footer header masthead copyright legal topbar bottom contentinfo colophon site-header site-footer branding logo",
    "notice": "cookie cookies consent notice gdpr alert newsletter subscribe subscription popup modal overlay message",
    "form": "form login search signup register searchbox contact",
    "share": "share sharing social follow tags meta byline author tools",
}
#: Elements that are parts of running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody tr td th figcaption".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_ENDS = re.compile(r"[.!?;:,]")
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
_TOKEN_AT = {w: k for k, words in enumerate(TOKENS.values()) for w in words.split()}
_NAMES = list(TOKENS)
_DECIDED = lambda tag, attrs: tag not in dom.INLINE or tag == "span" and bool(attrs)


class Page:
    """The elements that are decided on (blocks), with their texts and features."""

    def __init__(self, html: str):
        t = self.tree = dom.parse(html)
        n = len(t.tag)
        self.block = [0] * n  # the decided element that an element's text belongs to
        self.nodes, self.up, at = [], [], {}
        for e in range(n):
            if e == 0 or t.tag[e] not in dom.UNSEEN and t.tag[e] not in dom.VOID and _DECIDED(t.tag[e], t.attrs[e]):
                at[e] = len(self.nodes)
                self.nodes.append(e)
                self.up.append(at[self.block[t.parent[e]]] if e else -1)
                self.block[e] = e
            else:
                self.block[e] = self.block[t.parent[e]]
        self.at = at

    def features(self) -> np.ndarray:
        t, k = self.tree, len(self.nodes)
        own = np.zeros((k, 5))  # characters, words, of links, ends of phrases, pieces
        in_link = {0: False}
        for e in range(1, len(t.tag)):
            in_link[e] = t.tag[e] == "a" or in_link[t.parent[e]]
        for e, text in t.pieces:
            if text is None:
                continue
            body = text.strip()
            if body:
                chars = len(body)
                own[self.at[self.block[e]]] += (chars, body.count(" ") + 1, chars if in_link[e] else 0, len(_ENDS.findall(body)), 1)
        up = self.up
        tags = [t.tag[e] for e in self.nodes]
        kinds = np.zeros((k, len(TAGS)))
        tokens = np.zeros((k, len(_NAMES)))
        inputs = np.zeros(k)
        hidden = np.zeros(k)
        for e in range(1, len(t.tag)):
            if t.tag[e] in ("input", "button", "select", "textarea"):
                inputs[self.at[self.block[e]]] += 1
        for i, e in enumerate(self.nodes):
            if tags[i] in _TAG_AT:
                kinds[i, _TAG_AT[tags[i]]] = 1
            if t.attrs[e].strip():
                a = dom.attributes(t.attrs[e])
                hidden[i] = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
                for w in _SPLIT.split(_CAMEL.sub(" ", " ".join(a.get(x, "") for x in ("class", "id", "role", "itemprop", "aria-label"))).lower()):
                    if w in _TOKEN_AT:
                        tokens[i, _TOKEN_AT[w]] = 1
        total = own.copy()
        paragraphs, items, fields = kinds[:, _TAG_AT["p"]].copy(), kinds[:, _TAG_AT["li"]].copy(), inputs.copy()
        for i in range(k - 1, 0, -1):
            for x in (total, paragraphs, items, fields):
                x[up[i]] += x[i]
        siblings, index = np.zeros(k), np.zeros(k)
        for i in range(1, k):
            index[i] = siblings[up[i]]
            siblings[up[i]] += 1
        parent = np.array([max(u, 0) for u in up])
        # What stands above: the nearest tag and token that tells, and depth below the article.
        above_tags, above_tokens = np.zeros((k, len(TAGS))), np.zeros((k, len(_NAMES)))
        for i in range(1, k):
            above_tags[i] = np.maximum(above_tags[up[i]], kinds[up[i]])
            above_tokens[i] = np.maximum(above_tokens[up[i]], tokens[up[i]])
        keep = [_TAG_AT[x] for x in ("nav", "header", "footer", "aside", "article", "main", "section", "form", "ul", "figure", "table")]
        depth = np.array([t.depth[e] for e in self.nodes], float)
        chars, words, linked, ends, pieces = total.T
        before = np.cumsum(own[:, 0]) - own[:, 0]
        columns = [
            np.log1p(chars), np.log1p(words), linked / np.maximum(chars, 1), ends / np.maximum(words, 1), words / np.maximum(pieces, 1), np.log1p(own[:, 0]), own[:, 2] / np.maximum(own[:, 0], 1),
            depth, siblings[parent], index, index / np.maximum(siblings[parent] - 1, 1), siblings, chars / np.maximum(chars[parent], 1), before / max(chars[0], 1), chars / max(chars[0], 1),
            paragraphs, items, fields, inputs, hidden, linked[parent] / np.maximum(chars[parent], 1), paragraphs[parent],
        ]
        self.own_chars = own[:, 0]
        return np.concatenate([np.stack(columns, axis=1), kinds, tokens, above_tags[:, keep], above_tokens], axis=1)

    def decode(self, logits: np.ndarray, parting: float = 8.0) -> np.ndarray:
        """Which elements are kept: the greatest sum of weighted log-odds with no kept element below a dropped one.

        To drop an element of running text without attributes below a kept one costs `parting`.
        """
        t = self.tree
        cost = np.array([parting if t.tag[e] in PROSE and not t.attrs[e].strip() else 0.0 for e in self.nodes])
        gain = logits * (2 + np.log1p(self.own_chars))
        gain[0] = 0
        value = gain.copy()
        for i in range(len(gain) - 1, 0, -1):
            value[self.up[i]] += max(value[i], -cost[i])
        kept = np.zeros(len(gain), bool)
        kept[0] = True
        for i in range(1, len(gain)):
            kept[i] = kept[self.up[i]] and value[i] > -cost[i]
        return kept

    def text(self, kept: np.ndarray) -> str:
        blocks, part = [], []
        for e, text in self.tree.pieces:
            if text is None:
                if part:
                    blocks.append(" ".join("".join(part).split()))
                    part = []
            elif kept[self.at[self.block[e]]]:
                part.append(text)
        if part:
            blocks.append(" ".join("".join(part).split()))
        return " ".join(b for b in blocks if b)


# --- training pages ---------------------------------------------------------


def _made(rng: random.Random) -> str:
    """A page whose elements carry data-y: 1 for the article, 0 for what is not of it."""
    syllables = "ta re mi so la ne ko du vi pe ras ten lor am en is un ver gra to".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    sentence = lambda: words(3, 16).capitalize() + rng.choice("...?!")
    prose = lambda lo=1, hi=6: " ".join(sentence() for _ in range(rng.randint(lo, hi)))
    pick = rng.choice
    plain = rng.random() < 0.25  # no helpful names or tags

    def name(group: str) -> str:
        w = pick(TOKENS[group].split())
        other = word()
        return pick([w, f"{w}-{other}", f"{other}-{w}", f"{w} {other}", f"{other}_{w}", w.capitalize()])

    def box(group: str, inner: str, y: str, tags: str, named: float = 0.8) -> str:
        tag = pick(tags.split())
        how = f' {pick(["class", "class", "id"])}="{name(group)}"' if tag == "div" and not plain or rng.random() < named * 0.5 else (f' class="{word()}"' if rng.random() < 0.4 else "")
        return f"<{tag}{how}{y}>{inner}</{tag}>"

    no, yes = ' data-y="0"', ' data-y="1"'
    links = lambda lo, hi: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(lo, hi))) + "</ul>"
    flat = lambda lo, hi: pick([" | ", " ", " &middot; "]).join(f'<a href="/{word()}">{words(1, 2)}</a>' for _ in range(rng.randint(lo, hi)))
    menu = lambda: box("menu", pick([links, flat])(3, 9), no, "nav nav div")
    advert = lambda: box("advert", pick([prose(1, 2), f'<a href="/x">{words(2, 8)}</a>', f"<p>{prose(1, 2)}</p>"]), no, "div div div aside section", 1) if not plain else f'<div class="{name("advert")}"{no}>{prose(1, 2)}</div>'
    form = lambda: f'<form{no}><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button></form>' if rng.random() < 0.6 else box("notice", f"<p>{prose(1, 2)}</p><button>{word()}</button>", no, "div div section aside")
    side = lambda: box("side", f"<h3>{words(1, 3)}</h3>" + pick([links(2, 7), f"<p>{prose(1, 3)}</p>", links(1, 4) + f"<p>{prose(1, 2)}</p>"]), no, "aside aside div")
    notice = lambda: box("notice", pick([prose(1, 3), f"<p>{prose(1, 3)}</p>"]) + f"<button>{word()}</button>", no, "div div section")
    share = lambda: box("share", flat(2, 5), no, "div div ul")

    def comment() -> str:
        one = lambda: pick(["<li>{}</li>", '<div class="comment">{}</div>', "<article>{}</article>"]).format(f"<p>{words(1, 2)}</p><p>{prose(1, 3)}</p>")
        tag = pick(["section", "div", "div", "ol"])
        return f'<{tag} {pick(["class", "id"])}="{name("comment")}"{no}><h2>{words(1, 3)}</h2>' + "".join(one() for _ in range(rng.randint(1, 6))) + f"</{tag}>"

    def article() -> str:
        parts, title = [], pick([words(2, 9), sentence()])
        heading = f"<h1>{title}</h1>"
        parts.append(pick([heading, heading, f"<header>{heading}</header>", f"<div>{heading}</div>"]))
        if rng.random() < 0.3:
            parts.append(f"<p>{pick(['<b>', ''])}{title}" + pick(["</p>", "<br>", ""]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8, 12])):
            kind = rng.random()
            if kind < 0.62:
                inner = prose()
                if rng.random() < 0.3:
                    inner = f"<b>{inner}" + pick(["</b>", "<br>", ""])
                if rng.random() < 0.2:
                    inner += f' <a href="/{word()}">{words(1, 3)}</a> {words(1, 5)}.'
                parts.append(pick([f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}", f"<div>{inner}</div>" if rng.random() < 0.3 else f"<p>{inner}</p>"]))
            elif kind < 0.70:
                parts.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.76:
                parts.append("<ul>" + "".join(f"<li>{pick([words(1, 6), prose(1, 2)])}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.79:
                parts.append(f"<blockquote>{pick([prose(), f'<p>{prose()}</p>'])}</blockquote>")
            elif kind < 0.82:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.84:
                parts.append(f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>")
            elif kind < 0.86:
                parts.append(f"<pre>{words(3, 20)}</pre>")
            elif kind < 0.91:
                parts.append(advert())
            elif kind < 0.94:
                parts.append(share())
            elif kind < 0.97:
                parts.append(form())
            else:
                parts.append(side())
        inner = "".join(parts)
        shape = rng.random()
        if shape < 0.45:
            out = f"<article{yes}>{inner}</article>"
        elif shape < 0.6:
            out = f"<main{yes}>{inner}</main>"
        elif shape < 0.92:
            out = f'<div {pick(["class", "id"])}="{name("main")}"{yes}>{inner}</div>'
        else:
            out = f"<div{yes}>{inner}</div>"
        if rng.random() < 0.2:
            out = f'<div class="{word()}">{out}</div>'
        return out

    body = []
    if rng.random() < 0.6:
        body.append(box("frame", pick([f"<p>{words(1, 4)}</p>", f'<a href="/">{words(1, 3)}</a>', f"<h1>{words(1, 3)}</h1>"]) + (menu() if rng.random() < 0.6 else ""), no, "header header div"))
    for make, p in ((menu, 0.8), (notice, 0.25), (advert, 0.6), (form, 0.15)):
        if rng.random() < p:
            body.append(make())
    middle = [article()] + [make() for make, p in ((side, 0.4), (advert, 0.2)) if rng.random() < p]
    if rng.random() < 0.25:
        rng.shuffle(middle)
    middle = "".join(middle) + (comment() if rng.random() < 0.4 else "")
    body.append(pick(["{}", "{}", "<main>{}</main>", '<div class="wrapper">{}</div>', '<div id="page">{}</div>']).format(middle))
    for make, p in ((side, 0.2), (notice, 0.15), (advert, 0.2)):
        if rng.random() < p:
            body.append(make())
    if rng.random() < 0.85:
        body.append(box("frame", pick([f"&copy; {words(1, 3)} &middot; {prose(1, 2)}", f"<p>&copy; {words(1, 6)}</p>" + links(2, 5), prose(1, 3)]), no, "footer footer div"))
    return "<html><head><title>x</title></head><body>" + "".join(body) + pick(["</body></html>", ""])


def truth(page: Page) -> np.ndarray:
    """Labels from data-y: an element is of the article if the nearest mark is 1, or if it holds such text."""
    t, mark = page.tree, {0: 0}
    labels = np.zeros(len(page.nodes))
    for e in range(1, len(t.tag)):
        m = re.search(r'data-y="(\d)"', t.attrs[e])
        mark[e] = int(m[1]) if m else mark[t.parent[e]]
    for i, e in enumerate(page.nodes):
        labels[i] = mark[e]
    for i in range(len(labels) - 1, 0, -1):
        labels[page.up[i]] = max(labels[page.up[i]], labels[i])
    return labels


@functools.lru_cache
def trained() -> boosting.Trees:
    """The default model, trained once in a process."""
    return train()


def train(pages: int = 500, seed: int = 7, **options) -> boosting.Trees:
    """Fit on `pages` made pages; the bound keeps training on the driver to seconds."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = Page(_made(rng))
        xs.append(page.features()[1:])
        ys.append(truth(page)[1:])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys), **options)


def extract_text(pages: list[str | None], model: boosting.Trees) -> list[str]:
    out = []
    for lo in range(0, len(pages), 64):
        own = [Page(h or "") for h in pages[lo : lo + 64]]
        xs = [p.features() for p in own]
        logits = np.split(model.logits(np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1])
        out += [p.text(p.decode(z)) for p, z in zip(own, logits, strict=True)]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: boosting.Trees | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or trained()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [rows.schema["page_id"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()]

    def run(batches):
        for b in batches:
            texts = extract_text(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
