"""Fields of scraped or registered records: codes, names, lists, addresses and bands. Columns to Columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of inspection grades; other grades have none.
GRADES = {"1": "Outstanding", "2": "Good", "3": "Requires improvement", "4": "Inadequate"}
# Words that make a name an organisation's.
ORGANISATION_WORDS = ("nursery", "school", "club", "playgroup", "centre", "limited", "ltd", "care", "preschool", "kids", "college")
_POSTCODE = r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def spaced_postcode(c: Column) -> Column:
    """Capitals with one space before the last three characters; shorter codes have none."""
    s = F.upper(F.regexp_replace(c, r"\s+", ""))
    return F.when(F.length(s) >= 5, F.concat_ws(" ", F.substr(s, F.lit(1), F.length(s) - 3), F.right(s, F.lit(3)))).otherwise(s)


def valid_postcode(c: Column, outwards: Column, inwards: Column) -> Column:
    """Five characters or more, a known outward code, and its inward code among those known; outwards and inwards are arrays."""
    s = spaced_postcode(c)
    return F.coalesce((F.length(s) >= 6) & F.array_contains(outwards, F.substring_index(s, " ", 1)) & F.array_contains(inwards, F.substring_index(s, " ", -1)), F.lit(False))


def registered_children(c: Column) -> Column:
    """The number after "Admissions:", else a number at the start."""
    number = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("int")
    return F.coalesce(number(r"(?i)admissions:\s*(\d+)"), number(r"^\s*(\d+)"))


def grade_label(c: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in GRADES.items() for x in kv))[F.trim(c.cast("string"))]


def iso_date(c: Column) -> Column:
    """dd/MM/yyyy as yyyy-MM-dd; what is no such date stays."""
    return F.coalesce(F.date_format(F.try_to_date(c, "dd/MM/yyyy"), "yyyy-MM-dd"), c)


def area_name_variants(c: Column) -> Column:
    """Spellings under which an area's name may be listed, the plainest first."""
    s = F.lower(F.trim(c))
    plain = F.trim(F.regexp_replace(F.regexp_replace(s, r"^(?:(?:city|county|london borough|royal borough) of )", ""), r"(?:, (?:city|county) of| (?:city|county|borough|district)? ?council)$", ""))
    both = F.array(plain, s)
    more = F.flatten(F.transform(both, lambda x: F.array(x, F.replace(x, F.lit(" & "), F.lit(" and ")), F.replace(x, F.lit(" and "), F.lit(" & ")), F.replace(x, F.lit("-"), F.lit(" ")), F.regexp_replace(x, r"\bst\.? ", "st. "), F.regexp_replace(x, r"\bst\. ", "st "))))
    return F.array_distinct(more)


def distance_band(miles: Column) -> Column:
    out = F.when(miles.isNull(), "unknown")
    for most, name in ((1, "<1mi"), (3, "1-3mi"), (5, "3-5mi"), (10, "5-10mi")):
        out = out.when(miles < most, name)
    return out.otherwise("10+mi")


def age_bands(months: Column) -> Column:
    """The bands that ages in months fall into, each once, in order; none of no ages."""
    return F.array_sort(F.array_distinct(F.transform(months, lambda m: F.when(m < 60, "0-4").otherwise("5+"))))


def place_names(c: Column) -> Column:
    """Distinct capitalised names of a JSON list or of a text with commas, line ends or "and"; null and empty give none."""
    listed = F.coalesce(F.from_json(c, "array<string>"), F.split(c, r"\s*(?:,|;|\n|\band\b)\s*"))
    return F.array_distinct(F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.initcap(F.trim(x))), lambda x: x != ""))


def phone_list(c: Column) -> Column:
    """Distinct numbers of 10 or 11 digits; numbers written together are cut into 11 digits and the rest."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"(0[\d ()\-]{8,}\d)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))
    cut = F.flatten(F.transform(runs, lambda x: F.when(F.length(x) > 11, F.array(F.left(x, F.lit(11)), F.substr(x, F.lit(12)))).otherwise(F.array(x))))
    return F.array_distinct(F.filter(cut, lambda x: F.length(x).isin(10, 11)))


def undoubled(c: Column) -> Column:
    """A text that is one text twice becomes that text."""
    half = (F.length(c) / 2).cast("int")
    return F.when((F.length(c) % 2 == 0) & (F.length(c) > 0) & (F.substr(c, F.lit(1), half) == F.substr(c, half + 1)), F.substr(c, F.lit(1), half)).otherwise(c)


def address_parts(c: Column, least: int = 1) -> Column:
    """struct(line1, line2, town, postcode) of comma-separated parts: a part with a postcode is taken out, the last of `least` or more is the town."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.filter(parts, lambda x: ~x.rlike(_POSTCODE))
    town = F.when(F.size(rest) >= least, F.try_element_at(rest, F.lit(-1)))
    lines = F.when(town.isNotNull(), F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    return F.struct(F.get(lines, F.lit(0)).alias("line1"), F.get(lines, F.lit(1)).alias("line2"), town.alias("town"), _given(spaced_postcode(F.regexp_extract(c, f"({_POSTCODE})", 1))).alias("postcode"))


def reference_number(c: Column) -> Column:
    """EY or CA with digits, else six or seven digits."""
    return _given(F.upper(F.regexp_extract(c, r"(?i)\b((?:EY|CA)\d+|\d{6,7})\b", 1)))


def number_in_link(c: Column) -> Column:
    """Five to seven digits after a slash."""
    return _given(F.regexp_extract(c, r"/(\d{5,7})(?!\d)", 1))


def surname_first(c: Column) -> Column:
    """Two or three words without a comma and without a word of an organisation: "Surname, First"."""
    words = F.split(F.trim(c), r"\s+")
    person = F.size(words).between(2, 3) & ~c.contains(",") & ~F.arrays_overlap(F.transform(words, F.lower), F.array(*map(F.lit, ORGANISATION_WORDS)))
    return F.when(person, F.concat_ws(", ", F.element_at(words, -1), F.array_join(F.slice(words, 1, F.size(words) - 1), " "))).otherwise(c)


def quarantined(c: Column, bad: Column) -> Column:
    """struct(value, extra): a bad value moves aside."""
    bad = F.coalesce(bad, F.lit(False))
    return F.struct(F.when(~bad, c).alias("value"), F.when(bad, c).alias("extra"))


def name_and_type(c: Column) -> Column:
    """struct(name, type) around the last " - "; without one all is the name."""
    shape = r"^(.*) - (.*)$"
    return F.struct(F.when(c.rlike(shape), F.trim(F.regexp_extract(c, shape, 1))).otherwise(c).alias("name"), _given(F.regexp_extract(c, shape, 2)).alias("type"))


def classes(c: Column, table: dict[str, str]) -> Column:
    """Distinct classes, in order, of labels that commas, slashes or semicolons separate; unknown labels are left out."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(c), "[,/;]"), lambda x: F.try_element_at(known, F.trim(x))), lambda x: x.isNotNull()))


def with_labels(labels: Column, more: Column) -> Column:
    """labels followed by those of more that it lacks; nulls are empty."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(labels, none), F.coalesce(more, none))


def merged_json(first: Column, second: Column) -> Column:
    """One JSON object of both objects' fields; the second wins. A null or broken object has no fields."""
    fields = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = fields(first), fields(second)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)))))


def json_list(c: Column) -> Column:
    """The strings of a JSON list; anything else is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def _leaves(texts: pd.Series) -> pd.Series:
    def flat(text):
        try:
            root = json.loads(text) if text else None
        except ValueError:
            return []
        found, todo = [], [("", root)] if isinstance(root, (dict, list)) else []
        while todo:
            path, x = todo.pop()
            if isinstance(x, dict):
                todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(x.items())]
            elif isinstance(x, list):
                todo += [(f"{path}[{i}]", x[i]) for i in reversed(range(len(x)))]
            elif x is not None and x != "":
                found.append({"path": path, "value": x if isinstance(x, str) else json.dumps(x)})
        return found

    return texts.map(flat)


def json_leaves(text: Column) -> Column:
    """(path, value) of each leaf of a JSON document in its order, as a.b[0].c; nulls and empty texts, lists and objects give none, nor does what is no document."""
    return F.pandas_udf(_leaves, "array<struct<path:string,value:string>>")(F.coalesce(text, F.lit("")))
