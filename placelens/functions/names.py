"""Names of places without what says which care they give, and labels of where a value came from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelens.functions.similarity import similarity

# Care after a dash, and care without one, at the end of a name.
CARE_AFTER_DASH = (
    "nursery", "breakfast club", "after[ -]school club", "wrap[ -]?around care", "holiday club", "out of school club", "kids club", "childcare",
    r"before\s*&\s*after\s+school\s+care", r"before\s+and\s+after\s+school\s+care", r"before\s+school\s+care", r"after\s+school\s+care",
)
CARE_AT_END = (
    "nursery class", "nursery unit", "nursery provision", "breakfast club", "after[- ]?school club", "holiday club", "out of school club",
    "kids club", "wrap[ -]?around care", "childminders and childcare providers", "childcare",
)
# Words after which "nursery" is a part of a school.
SCHOOL_WORDS = ("school", "academy", "primary", "infant", "junior", "first", "middle")
# Qualifiers at the end of an authority's names.
QUALIFIERS = (
    r"breakfast\s+club", r"after[- ]school\s+club", r"holiday\s+club", r"out\s+of\s+school\s+club", r"nursery\s+class", r"day\s+nursery",
    "pre[- ]?school", r"wrap[- ]?around\s+care", r"after\s+school\s+service", r"holiday\s+scheme", r"holiday\s+play\s*scheme", "oos", r"out\s+of\s+school",
)
# Categories that a listing puts at the end of names, and what may lead them.
CATEGORIES = (r"childcare\s+providers", r"childminders\s+and\s+childcare\s+providers")
CATEGORY_LEAD = r"before\s*&\s*after\s+school\s+care"
# Words that merging leaves out.
MERGE_WORDS = (
    "ltd", "limited", "nursery school", "day nursery", "nursery", "pre-school", "preschool", "pre school", "childminding", "childcare",
    "out of school club", "after school club", "breakfast club", "the",
)


def _any(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(words)})"


def without_care(c: Column) -> Column:
    """The name without the care that it ends in, however often; "nursery" alone only goes after a word for a school."""
    dash, plain = rf"\s*[-–—]\s*{_any(CARE_AFTER_DASH)}", rf"\s+{_any(CARE_AT_END)}"
    nursery = rf"(?<=(?:^|\s){_any(SCHOOL_WORDS)}) nursery"
    return F.regexp_replace(c, rf"(?i)(?:{dash}|{plain}|{nursery})+\s*$", "")


def without_category(c: Column) -> Column:
    """The name without a category that a listing put after a dash; a name that is nothing else stays."""
    bare = F.trim(F.regexp_replace(c, rf"(?i)\s*-\s*(?:{CATEGORY_LEAD}\s*-\s*)?{_any(CATEGORIES)}\s*$", ""))
    return F.when(bare == "", c).otherwise(bare)


def unqualified(c: Column) -> Column:
    """The name without a bracket, then a kind of care, at its end; null if that changes nothing or leaves nothing.

    The bracket goes by its place: what ends in ")" is cut at the last "(" before it, if something stands between.
    """
    name = F.trim(c)
    opened = F.length(F.substring_index(name, "(", -1))
    closed = name.endswith(")") & name.contains("(") & (opened > 1) & ~F.left(F.substring_index(name, "(", -1), opened - 1).contains(")")
    bare = F.when(closed, F.trim(F.left(name, F.length(name) - opened - 1))).otherwise(name)
    bare = F.trim(F.regexp_replace(bare, rf"(?i)\s*[-–—]?\s*{_any(QUALIFIERS)}\s*$", ""))
    return F.when((bare != "") & (bare != c), bare)


def merge_name(c: Column) -> Column:
    """Lower case words, letters and digits of any script, without the words and phrases of MERGE_WORDS."""
    bare = F.regexp_replace(F.lower(c), rf"(?U)\b{_any(MERGE_WORDS)}\b", " ")
    return F.array_join(F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)), " ")


def after_at(c: Column) -> Column:
    """What follows the first @; null without one or with nothing after it."""
    rest = F.trim(F.substr(c, F.instr(c, "@") + 1))
    return F.when(c.contains("@") & (rest != ""), rest)


def without_words(c: Column, words: tuple[str, ...]) -> Column:
    """The words of a normalised name that are not among the given ones."""
    return F.array_join(F.filter(F.split(c, " "), lambda w: ~w.isin(*words)), " ")


def similar_without(a: Column, b: Column, words: tuple[str, ...]) -> Column:
    """The ratio of two normalised names without the given words."""
    return similarity(without_words(a, words), without_words(b, words))


def address_text(c: Column) -> Column:
    """An address without the label "Address:" before it."""
    return F.regexp_replace(c, r"^Address:\s*", "")


def source_label(c: Column) -> Column:
    """A field's source without ids of records: scrapes in one, extracts by their field."""
    return F.when(c.startswith("la_scrape:"), "la_scrape").when(c.startswith("la_extract:"), F.concat(F.lit("la_extract:"), F.substring_index(c, ":", -1))).otherwise(c)
