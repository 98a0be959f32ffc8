"""Fields from HTML: label and value pairs, contacts, hidden addresses, and a registry of platforms."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIRS = {"dt": "dd", "th": "td", "strong": None, "label": "span"}


class _Walker(HTMLParser):
    """Title, headings, links, metas, and pairs of a label element with what follows it."""

    def __init__(self, first_wins: bool):
        super().__init__(convert_charrefs=True)
        self.pairs: dict[str, str] = {}
        self.title, self.heads, self.links, self.meta, self.text = "", [], [], {}, []
        self.first_wins, self._open, self._label, self._part, self._skip = first_wins, [], None, None, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self._skip += 1
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "meta" and a.get("name"):
            self.meta[a["name"].lower()] = a.get("content") or ""
        if a.get("data-cfemail"):
            self.links.append("mailto:" + decode_email(a["data-cfemail"]))
        if tag in ("title", "h1", "h2", *_PAIRS, "dd", "td"):
            self._part = (tag, [])
        elif tag == "br" and self._part:
            self._part[1].append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        if not self._part or self._part[0] != tag:
            if self._label and tag in ("p", "li", "div", "tr") and self._label[0] == "strong":
                self._put(" ".join("".join(self._label[2]).split()))
            return
        text = " ".join("".join(self._part[1]).split())
        if tag == "title":
            self.title = text
        elif tag in ("h1", "h2"):
            self.heads.append(text)
        elif tag in _PAIRS:
            self._label = (tag, text.rstrip(": "), [])
        elif self._label:
            self._put(text)
        self._part = None

    def _put(self, value: str) -> None:
        label = self._label[1]
        if label and value and not (self.first_wins and label in self.pairs):
            self.pairs[label] = value
        self._label = None

    def handle_data(self, data):
        if self._skip:
            return
        self.text.append(data)
        if self._part:
            self._part[1].append(data)
        elif self._label and self._label[0] == "strong":
            self._label[2].append(data)


def decode_email(hidden: str) -> str:
    """Hexadecimal bytes, each XORed with the first."""
    raw = bytes.fromhex(hidden)
    return bytes(b ^ raw[0] for b in raw[1:]).decode("utf-8", "replace")


def fields(html: str | None, first_wins: bool = False) -> dict:
    w = _Walker(first_wins)
    w.feed(html or "")
    w.close()
    text = " ".join("".join(w.text).split())
    return {
        "title": w.title or None, "heading": w.heads[0] if w.heads else None, "n_links": len(w.links),
        "email": next((x[7:].split("?")[0] for x in w.links if x.startswith("mailto:")), None),
        "phone": next((x[4:] for x in w.links if x.startswith("tel:")), None),
        "pairs": w.pairs, "meta": w.meta, "n_words": len(text.split()),
        "postcode": (m[0] if (m := re.search(r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b", text)) else None),
    }


_KIND = "title string, heading string, n_links long, email string, phone string, pairs map<string,string>, meta map<string,string>, n_words long, postcode string"
#: Extractors by platform: name -> html to fields. Others join by register().
PLATFORMS: dict[str, Callable[[str | None], dict]] = {"generic": fields, "first_label": lambda h: fields(h, first_wins=True)}


def register(name: str, extract: Callable[[str | None], dict]) -> None:
    PLATFORMS[name] = extract


def extract(html: Column, platform: str = "generic") -> Column:
    one = PLATFORMS[platform]

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(h) for h in s])

    return F.pandas_udf(run, _KIND)(html)


def canonical(pairs: Column, labels: dict[str, str]) -> tuple[Column, Column]:
    """Known labels under their keys, and the rest."""
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    low = lambda k: F.lower(F.trim(k))
    mapped = F.transform_keys(F.map_filter(pairs, lambda k, v: low(k).isin(*labels)), lambda k, v: known[low(k)])
    return mapped, F.map_filter(pairs, lambda k, v: ~low(k).isin(*labels))


def coverage(rows: DataFrame, platform: str, pairs: str, samples: int = 3) -> DataFrame:
    """Per platform and label: how often it has a value, and a few distinct values."""
    each = rows.select(platform, F.explode(pairs).alias("label", "value"))
    return each.groupBy(platform, "label").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.substring("value", 1, 120))), 1, samples).alias("samples"))
